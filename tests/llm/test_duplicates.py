"""Repeated substrings, near-duplicate passages and SimHash groups against brute force, with edge rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from actuspark.llm.components import components
from actuspark.llm.passages import alike, earlier, forest, near_passages
from actuspark.llm.simhash import fingerprint, keep_one, links, near_groups
from actuspark.llm.suffixes import anchors, repeated_spans

EDGES = [None, "", "a" * 1000, "a" * 399, "a" * 401, "ab" * 400, "é" * 300]


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared, out = [prose(rng, 60, words) for _ in range(4)], []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.4 and out:
            letters = list(rng.choice(out) or "x")
            for _ in range(3):
                letters[rng.randrange(len(letters))] = rng.choice("xyz")
            out.append("".join(letters))
        else:
            text = prose(rng, rng.randint(0, 250), words)
            out.append(text + rng.choice(shared)[rng.randint(0, 50):] + prose(rng, 20, words) if kind < 0.7 else text)
    return out + EDGES


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    for x in raw:
        flags = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                flags[i:i + length] = [True] * length
        runs = sum(f and (i == 0 or not flags[i - 1]) for i, f in enumerate(flags))
        yield len(x), sum(flags), runs, hashlib.sha256(bytes(b for b, f in zip(x, flags) if not f)).hexdigest()


@pytest.mark.parametrize("length", [400, 40])
def test_repeated_spans_equal_brute_force(spark, corpus, length):
    rows = [(i, t, 1, "x") for i, t in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies int, bodies string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans(docs, threshold=length).collect()}
    assert got == dict(enumerate(removed(corpus, length)))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 500), (1, "q" * 500), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeated_spans(docs).collect())
    assert got == [(0, 0), (1, 500), (1, 500)]
    assert repeated_spans(docs.limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    inner = rng.integers(97, 123, 400, dtype=np.uint8)
    found = set()
    for pad in (0, 7, 250):
        data = np.concatenate([rng.integers(97, 123, pad, dtype=np.uint8), inner, rng.integers(97, 123, 90, dtype=np.uint8)])
        at, first, last = anchors(data, 400)
        found.add(int(at[(first <= pad) & (pad <= last)][0]) - pad)
        assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert len(found) == 1


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids, prints, radius=3):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def test_fingerprints_and_groups(spark, corpus):
    assert [fingerprint((t or "").encode()) for t in corpus] == [slow_fingerprint(t) for t in corpus]
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    want = linked(list(range(len(corpus))), [slow_fingerprint(t) for t in corpus])
    assert {r.doc_id: r.component_id for r in near_groups(docs).collect()} == want
    kept = keep_one(docs.withColumnRenamed("text", "text")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


@pytest.mark.parametrize("tile_rows", [2048, 7])
def test_tiles_lose_no_link(spark, tile_rows):
    rng = random.Random(1)
    base, prints = [rng.getrandbits(64) for _ in range(20)], set()
    while len(prints) < 400:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "simhash long")
    roots = {r.node: r.root for r in components(links(rows, 3, tile_rows)).collect()}
    groups = {}
    for i, p in enumerate(prints):
        s = int(np.uint64(p).view(np.int64))
        groups.setdefault(roots.get(s, s), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == linked(list(range(400)), prints)


def test_components_of_a_path_a_star_and_a_loop(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, None), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


def test_identical_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "x y z", None), (1, "x y z", None), (2, None, "row")], "doc_id long, text string, row string")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 2]
    assert keep_one(docs.limit(0)).count() == 0


def near_words(texts, length=50):
    stretches, holders = [], {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for s in range(len(w) - length + 1):
            f = frozenset(tuple(w[s + k:s + k + 5]) for k in range(length - 4))
            for x in f:
                holders.setdefault(x, set()).add(len(stretches))
            stretches.append((d, s, f))
    flags = [[False] * len((t or "").split()) for t in texts]
    for d, s, f in stretches:
        for m in set().union(*(holders[x] for x in f)):
            if stretches[m][0] != d and len(f & stretches[m][2]) >= 0.8 * len(f | stretches[m][2]):
                flags[d][s:s + length] = [True] * length
                break
    return flags


def test_near_passages_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    shared, texts = [[rng.choice(words) for _ in range(90)] for _ in range(3)], []
    for i in range(36):
        own = [rng.choice(words) for _ in range(rng.randint(0, 100))]
        if i % 3 == 0:
            part = list(rng.choice(shared))
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(90)] = f"zzz{i}"
            own += part[rng.randint(0, 25):] + [rng.choice(words) for _ in range(20)]
        texts.append(" ".join(own))
    texts += [texts[3], None, "", "a b", " ".join(shared[0])]
    rows = near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want, hit, missed, wrong = near_words(texts), 0, 0, 0
    for r in rows:
        got = [any(a <= k < b for a, b in zip(r.starts, r.ends)) for k in range(len(want[r.doc_id]))]
        hit += sum(x and y for x, y in zip(got, want[r.doc_id]))
        missed += sum(y and not x for x, y in zip(got, want[r.doc_id]))
        wrong += sum(x and not y for x, y in zip(got, want[r.doc_id]))
    assert hit > 500 and missed <= 0.05 * hit and wrong <= 0.01 * hit
    by_id = {r.doc_id: r for r in rows}
    assert by_id[36].component_id == by_id[3].component_id and by_id[37].n_repeated == 0


def test_contexts_alike_against_sets():
    rng = np.random.default_rng(2)
    least, width = 12, 23
    for kinds in (6, 10_000):  # tokens that repeat, tokens that do not
        base = rng.choice(kinds, (40, width), replace=True) if kinds < width else np.stack([rng.permutation(kinds)[:width] for _ in range(40)])
        a = (2 * base + 1).astype(np.uint32)
        b = a.copy()
        for row in b:
            row[rng.integers(0, width, rng.integers(0, 4))] = 2 * (kinds + rng.integers(0, 3)) + 1
        a[::5, :4], b[1::5, -5:] = 0, 0
        plain = not any((earlier(x) >= 0)[x > 0].any() for x in (a, b))
        for before in [(earlier(a).astype(np.int8), earlier(b).astype(np.int8))] + [None] * plain:
            got = alike(a, b, before, least)
            for x, y, bits in zip(a.tolist(), b.tolist(), got.tolist()):
                for s in range(least):
                    p, q = x[s: s + least], y[s: s + least]
                    near = all(p) and all(q) and len({*p} & {*q}) >= 0.8 * len({*p} | {*q})
                    assert bool(bits >> s & 1) == near


def test_forest_names_the_smallest_node():
    node, root = forest(np.array([5, 3, 7, 8, 2]), np.array([3, 1, 5, 8, 6]), 9)
    assert dict(zip(node.tolist(), root.tolist())) == {3: 1, 5: 1, 7: 1, 6: 2}
    assert len(forest(np.zeros(0, int), np.zeros(0, int), 0)[0]) == 0


def test_near_passages_of_repetitive_and_empty_tables(spark):
    line = " ".join(f"w{i}" for i in range(9))
    texts = [" ".join(["la"] * 80), " ".join(["la"] * 70), " ".join([line] * 9), " ".join([line] * 9) + " end", None, ""]
    rows = {r.doc_id: r for r in near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # The stretch up to the last word has nine shingles of ten in common with the others, so that word counts.
    assert [rows[i].n_repeated for i in range(6)] == [80, 70, 81, 82, 0, 0]
    assert rows[0].component_id == rows[1].component_id == 0 and rows[2].component_id == rows[3].component_id == 2
    assert near_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_between_texts_that_different_leaders_met(spark):
    """Chains of texts of 50 words, each alike to its neighbours only: no link may depend on who was compared first."""
    rng, texts, ends = random.Random(11), [], []
    for c in range(60):
        text = [f"c{c}w{rng.randrange(10**6)}" for _ in range(50)]
        ends.append(len(texts))
        for place in (None, 8, 16, 24, 32, 40):
            if place:
                text = text[:place] + [f"e{c}x{place}"] + text[place + 1:]
            texts.append(" ".join(text))
    rows = {r.doc_id: r.component_id for r in near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(rows[i] == e for e in ends for i in range(e, e + 6)) >= 0.99 * len(texts)
