"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts for each language and hash bucket: a task counts its own rows into one matrix and sends only
cells that are not zero, and Spark sums them. The matrix of log probabilities (languages x buckets, a size fixed by its
parameters) is broadcast; a batch is scored in numpy by gathering only the columns of the n-grams that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, crc_mod, mapped, mix, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Languages that the matrix may have; more are refused.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
PIECE = 1 << 16


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a lower-cased text, in pieces; pieces overlap so that each n-gram comes once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    for at in range(0, len(points), PIECE):
        piece = points[at: at + PIECE + ORDERS[-1] - 1]
        rest = min(PIECE, len(points) - at)
        hashed = np.zeros(len(piece), U64)
        out = []
        for n in range(1, ORDERS[-1] + 1):
            hashed = hashed[: len(piece) - n + 1] * U64(0x1000193) + piece[n - 1:] + U64(n)
            if n in ORDERS:
                out.append(mix(hashed[:rest]) % U64(BUCKETS))
        yield np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages, log probabilities

    def posterior(self, text: str) -> tuple[str, float]:
        total = self.prior.copy()
        for piece in grams(text):
            total += self.weights[piece].sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Model:
    """Counts of all rows whose text and language are known; equal counts decide for the language that sorts first."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    known = [(r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [k for k, _ in known]
    if not known:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    index = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), BUCKETS), np.int64)
        for piece in slices(batches, "text"):
            for value, language in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist()):
                for part in grams(value):
                    total[index[language]] += np.bincount(part, minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row * BUCKETS + bucket, pa.int64()), pa.array(total[row, bucket])], ["cell", "n"])

    cells = mapped(rows, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * BUCKETS, smoothing)
    counts[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    sizes = np.array([n for _, n in known], np.float64)
    return Model(languages, np.log(sizes / sizes.sum()), np.ascontiguousarray(weights))


def identified(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score`` (posterior probability) of each row.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0. Repeated rows come out
    as often as they come in, an empty table gives an empty result, other columns may have any names. Long texts are scored
    in pieces.
    """
    base = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))
    names = [f"carry_{i}" for i in range(len(carry))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in slices(batches, "text"):
            lettered = pc.fill_null(pc.match_substring_regex(piece.column("text"), r"\p{L}"), False).to_pylist()
            found = [known.posterior(t) if ok and known.languages else (UNDETERMINED, 0.0)
                     for t, ok in zip(piece.column("text").to_pylist(), lettered)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "score"])

    kept = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    return mapped(base, run, f"{kept}, lang_pred string, score double").withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows never learned from; a null id is not one of them."""
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out(doc_id)), text, lang)
    return identified(docs, model, text, (doc_id,)).select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")
