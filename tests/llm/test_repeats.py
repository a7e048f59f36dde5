"""Repeats counted in words: brute force over all windows, and passages just above and below the pipeline's threshold."""

import random
from collections import Counter

import corpus_pipeline
from actuspark.llm.suffixes import repeated_spans

SF = "/root/testdata/sf0.001"


def kept_words(texts, length):
    raw = [(t or "").split() for t in texts]
    seen = Counter(tuple(x[i:i + length]) for x in raw for i in range(len(x) - length + 1))
    for x in raw:
        gone = set()
        for i in range(len(x) - length + 1):
            if seen[tuple(x[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        yield [w for i, w in enumerate(x) if i not in gone]


def test_words_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "bé", "of", "thing", "x"] + [f"w{i}" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(30)] for _ in range(3)]
    texts = [None, "", "  ", "a " * 90, "a\n" * 7]
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 80))] + rng.choice(shared)[rng.randint(0, 25):] + [rng.choice(words)]
        texts.append(rng.choice(["", " \n"]) + "".join(w + rng.choice([" ", "\n", " \t"]) for w in body))
    texts += texts[-3:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (12, 51):
        got = {r.doc_id: r for r in repeated_spans(docs, threshold=length, keep_text=True, words=True).collect()}
        assert [got[i].kept_text.split() for i in range(len(texts))] == list(kept_words(texts, length))
        assert all(r.n_bytes == len((texts[i] or "").encode()) == r.n_removed + len(r.kept_text.encode()) for i, r in got.items())


def test_short_words_count_as_much_as_long_ones(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for n in (51, 50):
        passage = " ".join(rng.choice(["to", "be", "or", "not", "it", "is"]) for _ in range(n))
        texts += [" ".join([*rng.sample(words, 40), passage, *rng.sample(words, 40)]) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    assert [len(out[i].text.split()) for i in range(4)] == [80, 80, 130, 130]
    assert out[0].n_chars == len(out[0].text) and out[2].text == texts[2]
