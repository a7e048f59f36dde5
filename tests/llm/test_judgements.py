"""Contamination, toxicity, languages, tokens, fingerprints, URL filters and mixing on small tables."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from actuspark.llm import decontaminate, language, links, mixing, syncmers, tokencounts, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items):
    windows = []
    for item, text in items:
        w = WORD.findall(lower(text))
        windows += [(tuple(w[k:k + 13]), item) for k in range(max(1, len(w) - 12) if w else 0)]
    for doc, text in docs:
        w, names = WORD.findall(lower(text)), set()
        hit = [False] * len(w)
        for window, item in windows:
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s:s + len(window)]) == window:
                    hit[s:s + len(window)] = [True] * len(window)
                    names |= {str(item)} if item is not None else set()
        n = sum(hit)
        yield doc, (len(w), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(2)
    words = ["aß", "b", "C3", "the", "Of", "é", "zz", "q"]

    def prose(n):
        return rng.choice([" ", ",", "\n"]).join(rng.choice(words) for _ in range(n))

    items = [(i, prose(rng.randint(1, 30))) for i in range(15)] + [(99, None), (98, ""), (97, "the of"), (96, "the of"), (None, prose(15))]
    docs = [(i, prose(rng.randint(0, 60)) + (f" {rng.choice(items)[1]}! {prose(rng.randint(0, 200))}" if i % 3 == 0 else "")) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "THE OF")]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == dict(contaminated(docs, items))


def test_no_items_means_clean(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, contaminated string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_only(docs, items).count() == 2
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_grammar_kinds():
    grammar = toxicity.Grammar(words={"scum": 0.9}, stems={"lowe": 0.9}, kinds={"negated": 0.1, "reported": 0.2})
    kinds = {t: [k for k, _ in grammar.matches(t)] for t in
             ("you scum", "scum", "not scum. Loweiq", "he said: they said scum", "calm words", "Scum!")}
    assert list(kinds.values()) == [["targeted"], ["plain"], ["negated", "plain"], ["reported"], [], ["plain"]]
    assert grammar.score("not scum") < 0.5 <= grammar.score("SCUM") and grammar.score("") == pytest.approx(0.1)


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["ugly"] if i % 7 == 0 else []), *rng.choices(words, k=20)])) for i in range(500)]
    docs = spark.createDataFrame([*rows, (None, "ugly"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[i].predicted == int(i % 7 == 0) for i in range(500))
    assert 60 < sum(r.held_out for r in out.values()) < 140 and out[900].predicted == 0
    assert toxicity.drop_toxic(docs, labels).where("doc_id is null").count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = language.languages(docs).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) > 0
    edge = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "hello there you", "en"), (None, "hallo", "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.languages(edge).collect() if r.doc_id in (1, 2)} == {1: "und", 2: "und"}
    assert language.languages(edge.limit(0)).count() == 0


def test_matrix_equals_counting():
    text = "Äb cab" * 3
    want = Counter()
    low = text.lower()
    for n in (1, 2, 3):
        want[n] = len(low) - n + 1
    assert sum(len(p) for p in language.grams(text)) == sum(want.values())
    short, language.PIECE = language.PIECE, 4
    try:
        pieces = np.sort(np.concatenate(list(language.grams(text))))
    finally:
        language.PIECE = short
    assert (pieces == np.sort(np.concatenate(list(language.grams(text))))).all()


@pytest.mark.skipif(not Path(tokencounts.VOCABULARY).exists(), reason="no vocabulary")
def test_tokens_add_up(spark, monkeypatch):
    texts = ["One two. Three four!  Five\n\nsix ñandú", "", None, "x" * 50, "Ünï. ." * 30]
    content = Path(tokencounts.VOCABULARY).read_bytes()
    encoder, _ = tokencounts.encoding(content)
    found = tokencounts.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(encoder.encode_ordinary(t or ""))
        assert own[0].start == 0 and own[-1].end == len(t or "") and all(a.end == b.start for a, b in zip(own, own[1:]))
    whole = tokencounts.token_ends(texts[0] * 50, content)
    monkeypatch.setattr(tokencounts, "PIECE", 40)
    assert (tokencounts.token_ends(texts[0] * 50, content) == whole).all()


def test_allocation_rule():
    owner, crossing = tokencounts.allocate(np.array([3, 6, 10, 16]), np.array([5, 8, 9, 16]))
    assert owner.tolist() == [2, 1, 0, 1] and crossing.tolist() == [1, 2, 1, 1]


def test_syncmers_and_neighbours(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 400))) for _ in range(40)] + [None, "", "ab"]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in syncmers.neighbours(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=7).collect()}
    for i, t in rows:
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        changed = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert out[i].fingerprint == syncmers.fingerprint(t.encode()).hex()
        assert out[i].near_edited == syncmers.likeness(syncmers.fingerprint(t.encode()), syncmers.fingerprint(changed.encode()))
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    assert syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(b"new " * 20 + text)) > 0.8
    data = np.frombuffer(text[:300], np.uint8)
    at, _ = syncmers.syncmers(data)
    alone = [i for i in range(len(data) - syncmers.K + 1) if len(syncmers.syncmers(data[i:i + syncmers.K])[0])]
    assert at.tolist() == alone  # no context but the k-mer itself


def test_url_rules_and_spread(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    pages = [(1, "http://A.Example.com/en/1?x", '<a href="http://hub.org/x">'), (2, "https://www.example.com/en/", None), (3, "no url", ""),
             (4, None, None), (5, "http://bad.net/es/x", ""), (6, "http://near.org/", "<a HREF='//bad.net/es/'> <a href=http://bad.net/>"),
             (7, "http://hub.org#t", ""), (8, "http://notexample.com/en/", ""), (9, "http://x.com", "<a href='http://hub.org'>"), (9, "http://x.com", None)]
    out = links.filtered(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(pages)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("net/es/", "block")
    assert got[6] == ("near.org", "/", None, "block") and got[8][2:] == ("com/", "allow") and got[9] == ("x.com", "", None, "allow")
    assert links.filtered(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 500), ("b", "x", "s", 1000)],
                                   "domain string, language string, source string, tokens long")
    given = {(r.domain, r.language): r.given for r in mixing.budgets(leaves, None, 400, 1).collect()}
    assert given == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    given = {(r.domain, r.language): r.given for r in mixing.budgets(leaves, None, 1300, 1).collect()}
    assert given == {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 790}


@pytest.mark.parametrize("range_rows", [1000, 3])
def test_mix_takes_prefixes(spark, range_rows):
    rows = [(i, "w " * (i % 9), "en", "s0" if i % 2 else None, "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "w w", "en", None, "x")], "doc_id long, text string, lang string, source string, epoch string")
    out = mixing.mixed(docs, None, 0.75, epochs=2, range_rows=range_rows).collect()
    for leaf, share in (("s0", None), ("", None)):
        own = [r for r in out if r.source == leaf]
        total = sum(i % 9 for i, *_ , s, _ in rows if (s or "") == leaf) + (2 if leaf == "" else 0)
        budget = 0.75 * (sum(i % 9 for i in range(200)) + 2) / 2
        used = sum(r.n_tokens for r in own)
        assert budget - 1 <= used < budget + 9 and used <= 2 * total
        assert len({(r.doc_id, r.epoch) for r in own}) == len(own)
    key = sorted((r.doc_id is None, r.doc_id or 0, r.epoch) for r in out)
    again = mixing.mixed(docs.repartition(5), None, 0.75, epochs=2, range_rows=50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.epoch) for r in again) == key
    assert mixing.mixed(docs.limit(0), None, 0.5).count() == 0
