"""Toxicity as a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause: *target*, *negation* and *reported speech* mark the words that they govern, *threat*
marks a target soon after a threatening word, and *insult* turns the marks of an insulting word into a kind of match. Each is a
table of states and classes of words (fixed lists, and for insults a learned lexicon of words and stems, each with the share of
toxic documents among those that hold it). They are composed once into one table, which a text steps through.

The weight of a match is that of the word times that of its kind, learned from the training rows, so a negated, a reported or an
isolated insult counts as much or as little as the labels say. A clause counts with its best match, a document by noisy-or over
its clauses; one without a match gets the share of toxic documents among those.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import crc_mod, mapped, slices
from actuspark.session import materialize, small_table

#: Labelled rows that the grammar is fitted on, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: A word or stem enters the lexicon if chance explains its labels with less than this probability, over all candidates together.
CHANCE = 0.01
#: Share of toxic documents among those with a word or stem, at least.
PURITY = 0.95
STEMS = (4, 5, 6, 7)
STEM_WORDS = 5
PIECE = 1 << 18

WORD, END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]")
TOKEN, NO_LETTER = re.compile(r"[^\W\d_]+|[.!?;:\n]"), re.compile(r"[\W\d_]")
# Word lists of the grammar, in English, German, French and Spanish.
TARGETS = frozenset("you your yours he she they them him her du dich dir dein ihr euch sie tu toi te vous il elle ils elles tú "
                    "usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not no never without isn aren wasn don doesn nicht kein keine nie ohne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says told wrote claimed quoted alleged sagte sagt schrieb behauptet dit disait écrit affirme dijo dice "
                    "escribió afirma".split())
THREATS = frozenset("kill hurt destroy shoot stab burn töten umbringen verletzen tuer détruire frapper matar destruir golpear".split())
REACH = 3  # words that a target or negation governs

#: Classes of words, and marks that transducers add to them.
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
AIMED, DENIED, QUOTED, MENACED = 8, 16, 32, 64
KINDS = (None, "plain", "targeted", "negated", "reported", "threat", "reported threat")


@dataclass(frozen=True)
class Transducer:
    """``steps[state][symbol]``: next state and what is written for the symbol."""

    steps: tuple[dict[int, tuple[int, int]], ...]

    def then(self, other: Transducer) -> Transducer:
        """The transducer that reads what this one writes with ``other``; its states are the reachable pairs."""
        number, todo, steps = {(0, 0): 0}, [(0, 0)], []
        while todo:
            a, b = todo.pop(0)
            row = {}
            for symbol, (a_next, written) in self.steps[a].items():
                b_next, out = other.steps[b][written]
                if (a_next, b_next) not in number:
                    number[a_next, b_next] = len(number)
                    todo.append((a_next, b_next))
                row[symbol] = number[a_next, b_next], out
            steps.append(row)
        return Transducer(tuple(steps))

    def run(self, symbols: Iterable[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            state, written = self.steps[state][symbol]
            out.append(written)
        return out


def governing(trigger: int, mark: int) -> Transducer:
    """Marks the ``REACH`` words after a word of class ``trigger``; the state is how many are left."""
    return Transducer(tuple(
        {s: (REACH if s & 7 == trigger else max(0, left - 1), s | mark if left else s) for s in range(128)} for left in range(REACH + 1)))


def reported() -> Transducer:
    """Marks all words after one of report."""
    return Transducer(({s: (int(s & 7 == REPORT), s) for s in range(128)}, {s: (1, s | QUOTED) for s in range(128)}))


def threatened() -> Transducer:
    """Marks a target within reach of a threat that is not denied; each threat once."""
    def step(left: int, s: int) -> tuple[int, int]:
        if s & 7 == THREAT and not s & DENIED:
            return REACH, s
        return (0, s | MENACED) if s & 7 == TARGET and left else (max(0, left - 1), s)

    return Transducer(tuple({s: step(left, s) for s in range(128)} for left in range(REACH + 1)))


def insulting() -> Transducer:
    """Writes the kind of match of a marked word, 0 for none."""
    def kind(s: int) -> str | None:
        if s & MENACED:
            return "reported threat" if s & QUOTED else "threat"
        if s & 7 != INSULT:
            return None
        return "reported" if s & QUOTED else "negated" if s & DENIED else "targeted" if s & AIMED else "plain"

    return Transducer(({s: (0, KINDS.index(kind(s))) for s in range(128)},))


#: The five, in the order in which they read.
CASCADE = (governing(TARGET, AIMED), governing(NEGATION, DENIED), reported(), threatened(), insulting())
COMPOSED = reduce(Transducer.then, CASCADE)


@dataclass
class Grammar:
    """Weights of the insult lexicon and of the kinds of match, and the score of a text without a match."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    kinds: dict[str, float] = field(default_factory=dict)
    threat: float = 0.0
    unmatched: float = 0.1

    def insult(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS))

    def touches(self, words: set[str]) -> bool:
        """Whether a set of words holds anything that a match needs."""
        return (not self.words.keys().isdisjoint(words) or not THREATS.isdisjoint(words)
                or any(not self.stems.keys().isdisjoint({w[:n] for w in words}) for n in STEMS if self.stems))

    def read(self, word: str) -> tuple[int, float]:
        """Class of a word and the weight of its entry."""
        if word in TARGETS:
            return TARGET, self.threat  # a threat is complete, and weighed, at its target
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        if word in THREATS:
            return THREAT, 0.0
        weight = self.insult(word)
        return (INSULT, weight) if weight else (OTHER, 0.0)

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """(kind, weight of the entry) of the matches of each clause that has some."""
        if not any(self.touches(set(WORD.findall(piece))) for piece in pieces(text)):
            return
        steps, state, found = COMPOSED.steps, 0, []
        for piece in pieces(text):  # a piece ends between words, and the state goes on
            for token in TOKEN.findall(piece):
                if END.match(token):
                    if found:
                        yield found
                    state, found = 0, []
                    continue
                symbol, weight = self.read(token)
                state, kind = steps[state][symbol]
                if kind and weight:
                    found.append((KINDS[kind], weight))
        if found:
            yield found

    def matches(self, text: str) -> Iterator[tuple[str, float]]:
        for found in self.clauses(text):
            yield from found

    def score(self, text: str) -> float:
        innocent = 1.0 - self.unmatched
        for found in self.clauses(text):
            innocent *= 1.0 - min(0.999, max(weight * self.kinds.get(kind, 1.0) for kind, weight in found))
        return 1.0 - innocent


def pieces(text: str) -> Iterator[str]:
    """A lower-cased text in pieces that end before a character that is no letter."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = NO_LETTER.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def strange(pos: int, n: int, rate: float) -> float:
    """How unlikely so many toxic documents are by chance: n times the divergence from the rate, 0 where it isn't higher."""
    p = pos / n
    if p <= rate:
        return 0.0
    return n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, held_out_mod: int, train_rows: int) -> DataFrame:
    """(text, toxic) of distinct training texts, about ``train_rows`` at most."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(crc_mod("id", held_out_mod) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / total))
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    joined = chosen.join(small_table(known, 2 * train_rows), "id").select("text", "toxic")
    return materialize(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", held_out_mod: int = 5,
        train_rows: int = TRAIN_ROWS) -> Grammar:
    """Learn the weights from the labelled rows whose crc32(id) modulo ``held_out_mod`` is not 0.

    Without labels of both kinds the lexicon stays empty. Of an id that has several labels the highest counts.
    """
    rows = training_rows(docs, labels, doc_id, text, toxic, held_out_mod, train_rows)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    rate = (total.pos + 0.1) / (total.n + 1)
    if not 0 < total.pos < total.n:
        return Grammar(unmatched=min(0.49, rate))
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word")
    counted = rows.select("toxic", word).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    counted = materialize(counted, "words")
    # Only what could pass the test is fetched: the number of such entries is bounded by the training rows.
    need = math.log(max(counted.count(), 2) / CHANCE)
    least = need / math.log(1 / rate)
    good = F.col("pos") >= F.greatest(F.lit(least), PURITY * F.col("n"))
    grammar = Grammar()
    for r in counted.where(good).collect():
        if strange(r.pos, r.n, rate) >= need:
            grammar.words[r.word] = (r.pos + rate) / (r.n + 1)
    stems = counted.select(F.explode(F.array(*[F.struct(F.when(F.length("word") >= k, F.substring("word", 1, k)).alias("stem"))
                                               for k in STEMS])).alias("s"), "n", "pos")
    stems = stems.select("s.stem", "n", "pos").where("stem is not null").groupBy("stem").agg(
        F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    for r in stems.where(good & (F.col("words") >= STEM_WORDS)).collect():
        if strange(r.pos, r.n, rate) >= 2 * need:  # a document may count for several words of a stem
            grammar.stems[r.stem] = (r.pos + rate) / (r.n + 1)
    grammar.threat = rate  # lets threats emit while the kinds are counted
    weigh(grammar, rows, rate)
    return grammar


def weigh(grammar: Grammar, rows: DataFrame, rate: float) -> None:
    """Weights of the kinds and of a text without a match, from the training documents in which each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for kind in {k for found in grammar.clauses(text) for k, _ in found} or {"none"}:
                    tally[kind][0] += 1
                    tally[kind][1] += toxic
        yield pa.RecordBatch.from_pylist([{"kind": k, "n": n, "pos": p} for k, (n, p) in tally.items()],
                                         pa.schema([("kind", pa.string()), ("n", pa.int64()), ("pos", pa.int64())]))

    found = {r.kind: (r.n, r.pos) for r in mapped(rows, run, "kind string, n long, pos long").groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    # Two fictitious documents, one of them toxic, stand for what is not known of a kind.
    share = {k: (pos + 1) / (n + 2) for k, (n, pos) in found.items()}
    plain = max((share[k] for k in ("plain", "targeted") if k in share), default=1.0)
    for kind in ("plain", "targeted", "negated", "reported"):
        grammar.kinds[kind] = min(1.0, share.get(kind, 0.5) / plain)
    grammar.threat = threat if (threat := share.get("threat", 0.0)) > 2 * rate else 0.0
    grammar.kinds["reported threat"] = min(1.0, share.get("reported threat", 0.5) / max(threat, 0.5))
    grammar.unmatched = min(0.49, share.get("none", rate))


def scored(docs: DataFrame, grammar: Grammar, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
           keep_text: bool = False) -> DataFrame:
    """``carry``, with ``keep_text`` the text, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each row.

    Null and empty texts have no match and get the score of such texts. Repeated rows come out as often as they come in, an
    empty table gives an empty result, other columns may have any names. A text's words are held in pieces of about ``PIECE``
    characters, between which the state of the grammar goes on.
    """
    base = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))
    names = [f"carry_{i}" for i in range(len(carry))] + ["text"] * keep_text
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for piece in slices(batches, "text"):
            score = [rules.score(t or "") for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(score, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in score], pa.int32())], [*names, "score", "predicted"])

    kept = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    return mapped(base, run, f"{kept}, score double, predicted int").withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
             held_out_mod: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; held out are the rows never learned from. A null id is not held out."""
    grammar = fit(docs, labels, doc_id, text, toxic, held_out_mod, train_rows)
    out = scored(docs, grammar, text, (doc_id,))
    return out.select(doc_id, F.coalesce(crc_mod(doc_id, held_out_mod) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; edge cases as in ``scored``."""
    held = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    kept = scored(held, fit(docs, labels, doc_id, text, toxic), "text", ("row",), keep_text=True).where("predicted = 0")
    return kept.select("row.*", F.col("text").alias(text)).select(docs.columns)
