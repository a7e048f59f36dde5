"""The pipeline's near-copy stage: planted near copies and near misses around a similarity of 0.8 of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from actuspark.llm.nearcopies import keep_one, shingles

SF = "/root/testdata/sf0.001"


def likeness(a, b):
    a, b = (set(shingles(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def families():
    """Bases of 300 words and variants with some words exchanged: similarities from 0.7 to 1."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    out = []
    for _ in range(24):
        base = [rng.choice(words) for _ in range(300)]
        other = list(base)
        for i in rng.sample(range(300), rng.choice([1, 3, 5, 6, 8, 10])):
            other[i] = rng.choice(words)
        out.append((" ".join(base), " ".join(other)))
    return out


def test_near_copies_go_and_near_misses_stay(spark, families):
    rows = [(10 * i + j, t, "en", "src1", len(t)) for i, pair in enumerate(families) for j, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    likely = [likeness(a, b) for a, b in families]
    assert sum(x >= 0.8 for x in likely) > 8 and sum(0.65 < x < 0.8 for x in likely) > 4
    want = sorted([10 * i for i in range(len(families))] + [10 * i + 1 for i, x in enumerate(likely) if x < 0.8])
    assert sorted(r.doc_id for r in corpus_pipeline.without_copies(spark, docs, SF).collect()) == want
    assert sorted(r.doc_id for r in keep_one(docs, tile_rows=3).collect()) == want


def test_chains_and_groups_keep_their_smallest_id(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows, now = [], list(base)
    for i in range(40):  # each like the one before, the last unlike the first
        rows.append((100 + i, " ".join(now)))
        now[5 * i:5 * i + 2] = [f"x{i}", f"y{i}"]
    docs = spark.createDataFrame([*rows, (7, "short text"), (8, "Short  text"), (9, None), (10, "")], "doc_id long, text string")
    assert likeness(rows[0][1], rows[-1][1]) < 0.2
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [7, 9, 100]
    assert keep_one(docs.limit(0)).count() == 0


def exact(rows, smallest=0.8):
    """Kept ids by all pairs of sets: one row, the one with the smallest id, of each component."""
    sets = [(i, frozenset(shingles((t or "").encode()).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if a == b or shared and shared >= smallest * (len(a) + len(b) - shared) - 1e-9:
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return sorted(i for i in root if find(i) == i)


@pytest.mark.parametrize("tile_rows", [4096, 60])
def test_a_large_family_around_the_threshold_equals_all_pairs(spark, tile_rows):
    """Hundreds of variants of one text, many pairs of which lie just above or just below 0.8; parts of the family meet in tiles."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(220)]
    rows = []
    for i in range(500):
        now = list(base)
        for at in rng.sample(range(220), rng.choice([2, 5, 8, 9, 10, 12])):
            now[at] = rng.choice(words)
        rows.append((3 * i + 1, " ".join(now)))
    rows += [(5000 + i, " ".join(rng.choice(words) for _ in range(90))) for i in range(40)] + [(6000, rows[17][1]), (6001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact(rows)
    assert 60 < len(want) < 480
    assert sorted(r.doc_id for r in keep_one(docs, tile_rows=tile_rows).collect()) == want


def test_test_tables_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == exact(rows)
