"""Near-copy contexts of one signature: how many pairs are compared, and that no similar stretch is left out."""

import numpy as np
import pyarrow as pa

from actuspark.llm.passages import NEAR, PACKET, Contexts, context_type, verify
from actuspark.llm.suffixes import ENTRY, arrived, shipped


def test_a_large_family_of_near_copies_is_compared_once_and_whole():
    """One signature of many variants: the pairs that are compared stay below all pairs, and no similar stretch is left out."""
    rng, least = np.random.default_rng(5), 46
    base = rng.permutation(10_000)[: 2 * least - 1]
    rows = np.repeat(base[None, :], 300, axis=0)
    for i, row in enumerate(rows):
        for place in rng.choice(np.r_[0: least - 1, least: 2 * least - 1], rng.integers(0, 12), replace=False):
            row[place] = 20_000 + 200 * i + place  # a token that no other row holds
    contexts = (2 * rows + 1).astype(np.uint32)
    held = Contexts(np.zeros(300, np.int64), contexts, least)
    left, right = np.triu_indices(300, 1)
    want = np.zeros(300, np.uint64)
    np.bitwise_or.at(want, left, held.alike(left, right))
    np.bitwise_or.at(want, right, held.alike(left, right))
    part = np.zeros(300, context_type(least))
    part["major"], part["minor"], part["context"] = 7, np.arange(300), contexts
    pairs = []
    plain = Contexts.alike
    Contexts.alike = lambda self, a, b: (pairs.append(len(a)), plain(self, a, b))[1]
    try:
        keys = [i.to_bytes(16, "big") for i in range(1, 301)]
        found = verify(least)(pa.Table.from_pylist(
            [{"bucket": 0, "keys": k, "body": part[i: i + 1].tobytes()} for i, k in enumerate(keys)], PACKET)).to_pylist()
    finally:
        Contexts.alike = plain
    got = {int.from_bytes(r["body"][8:16], "little"): int.from_bytes(r["body"][16:24], "little") for r in found if r["body"][0] == NEAR}
    assert got == {i: int(w) for i, w in enumerate(want) if w}
    assert sum(pairs) <= 300 * 299 // 2


def test_entries_travel_whole_in_fewer_bytes():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (1000, 70_000), (1003, 60_000)):  # documents beyond two bytes, and not
        part = np.zeros(n, ENTRY)
        part["major"], part["minor"] = rng.integers(0, 2**63, (2, n))
        part["doc"], part["many"] = rng.integers(most // 2, most, n), rng.integers(0, 2, n)
        if n:
            part["doc"][-1] = most - 1
        body = shipped(part)
        assert (arrived(body) == part).all() and len(arrived(body)) == n
        assert len(body) <= 8 + (21 if most > 1 << 16 else 19) * n
