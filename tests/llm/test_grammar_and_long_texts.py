"""The composed toxicity grammar against its five parts, and texts that are cut to pieces anywhere."""

import random

import numpy as np
import pytest

from actuspark.llm import tokencounts, toxicity
from actuspark.llm.toxicity import CASCADE, COMPOSED, KINDS, Grammar


def test_composition_equals_the_five_in_turn():
    rng = random.Random(3)
    for _ in range(400):
        symbols = [rng.choice([0, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randint(0, 30))]
        one = symbols
        for part in CASCADE:
            one = part.run(one)
        assert COMPOSED.run(symbols) == one
    assert {KINDS[k] for k in COMPOSED.run([5, 1, 5, 2, 5, 4, 1, 0, 0, 0, 4, 1, 3, 5, 4, 1])} == set(KINDS)


GRAMMAR = Grammar(words={"scum": 0.9, "rat": 0.7}, kinds={"plain": 0.3, "targeted": 1.0, "negated": 0.1, "reported": 0.2}, threat=0.8, unmatched=0.0)


@pytest.mark.parametrize("text, kinds, score", [
    ("a scum word", ["plain"], 0.27), ("you scum", ["targeted"], 0.9), ("you are such a scum", ["plain"], 0.27),
    ("you are not scum", ["negated"], 0.09), ("he said: you scum", ["targeted"], 0.9), ("she said you scum", ["reported"], 0.18),
    ("kill you", ["threat"], 0.8), ("never kill you", [], 0.0), ("kill that one and then you", [], 0.0), ("told them to kill you", ["reported threat"], 0.8),
    ("you rat you scum", ["targeted", "targeted"], 0.9), ("you rat. you scum", ["targeted", "targeted"], 0.97), ("scum", ["plain"], 0.27), ("", [], 0.0)])
def test_clauses_score_by_their_best_match(text, kinds, score):
    assert [k for k, _ in GRAMMAR.matches(text)] == kinds and GRAMMAR.score(text) == pytest.approx(score)


def test_pieces_do_not_change_a_score(monkeypatch):
    text = "Nobody said you scum; kill them, you rat. They never were scum\n2nd: not you, rat? İscum scum-rat scum1rat you 3 scum "
    want = GRAMMAR.score(text), list(GRAMMAR.matches(text))
    for size in range(1, len(text) + 1):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert (GRAMMAR.score(text), list(GRAMMAR.matches(text))) == want
        assert "".join(toxicity.pieces(text)) == text.lower()


def test_tokens_of_long_blanks_and_of_pieces(monkeypatch, spark):
    content = open(tokencounts.VOCABULARY, "rb").read()
    encoder, sizes = tokencounts.encoding(content)

    def whole(text):
        return np.cumsum(sizes[np.array(encoder.encode_ordinary(text), np.int64)])

    rng = random.Random(4)
    bits = ["word", " ", "\n", " " * 1500, "\n" * 1001, " \t" * 700, "été", "12", "?!", " a"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        for piece in (1, 7, 1 << 18):
            monkeypatch.setattr(tokencounts, "PIECE", piece)
            assert (tokencounts.token_ends(text, content) == whole(text)).all()
    monkeypatch.undo()
    long = "a" + " " * 2_000_000 + "b" + "\n" * 2_000_000
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    out = tokencounts.section_tokens(docs).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in out} == {1: len(tokencounts.token_ends(long, content)), 2: 0, 3: 0}
    assert tokencounts.section_tokens(docs.limit(0)).count() == 0
