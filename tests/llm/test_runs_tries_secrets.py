"""Periodic runs, the conversation trie and the secret scan: SQL on the test tables, brute force on small ones, edge tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from actuspark.llm import convtrie, periods, queries, secretscan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    mine = queries.queries()[name](spark, SF).toArrow()
    assert differences(mine, connect(SF).sql(queries.oracle_sql()[name]).to_arrow_table()) is None


# --- periodic runs ---

def plain_runs(words, least, exponent):
    """Every period and every stretch of equal words that far apart; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


@pytest.mark.parametrize("least, exponent", [(24, 3), (4, 2)])
def test_runs_equal_brute_force(spark, least, exponent):
    rng = random.Random(least)
    texts = [None, "", " \n ", "a " * 400, "ab " * 23, "ab " * 24, "a\x0bb\x0ca\tb " * 9, "é ü " * 15]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice(["a", "b", "A", "ß", "c"][:rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
            words += [unit[i % len(unit)] for i in range(rng.randint(0, 70))]
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, runs string, k0 long")
    got = {r.doc_id: r for r in periods.periodic_runs(docs, least=least, exponent=exponent).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = plain_runs(words, least, exponent)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == want and got[i].n_words == len(words)
        gone = {k for s, q, n in want for k in range(s + q, s + n)}
        assert got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_of_edge_tables(spark):
    docs = spark.createDataFrame([(None, "x " * 30), (1, "x " * 30), (1, "x " * 30)], "doc_id long, text string")
    assert [tuple(r.runs[0]) for r in periods.periodic_runs(docs).collect()] == [(0, 30, 1)] * 3
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    assert periods.periodic_runs(docs, keep=()).columns == ["n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, exponent=1)


def test_extensions_of_a_long_text_equal_a_walk():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 3, 700)
    text = np.concatenate([[-1], word, word, np.zeros(900, int), np.tile([1, 2], 300), word[:333], [-2], word, [-3]])
    grammar = periods.Grammar(text)
    a, b = rng.integers(1, 2500, 400), rng.integers(2501, len(text) - 1, 400)
    for way in (1, -1):
        got = grammar.extend(a, b, way)
        for i, j, n in zip(a, b, got):
            k = 0
            while text[i + k if way == 1 else i - 1 - k] == text[j + k if way == 1 else j - 1 - k]:
                k += 1
            assert k == n


# --- conversation trie ---

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(set)
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].add(c)
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == path)
        yield (min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
               sum(len(p) == len(path) + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())


def conversations(rng, n):
    rows = []
    for c in rng.sample(range(90), n):
        length = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, rng.choice([i, i, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "a  b", "", None, "c", "d\ne f"]))
                 for i in range(length)]
    return rows + rows[:2] + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = conversations(rng, 60) + [(20, i, "user", f"turn {i % 5}") for i in range(400)] + [(-7, 0, "user", "a b")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # one conversation lies over several blocks
        got = [tuple(r) for r in convtrie.prefix_trie(table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (r[0], r[1], r[7])
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)


def test_trie_of_edge_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert convtrie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert convtrie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], kind)).count() == 0
    one = convtrie.prefix_trie(spark.createDataFrame([(5, None, None, None)] * 2, kind)).collect()
    h = zlib.crc32(b"5") % 4
    assert sorted(r.depth for r in one) == list(range(max(0, 2 - h) + 1)) and {r.n_convs for r in one} == {1}


def test_equal_fingerprints_of_different_turns_are_noticed(spark):
    row = "1L AS conv, 1L AS depth, 5L AS f0, 6L AS f1, 0L AS g0, 0L AS g1, 3L AS words"
    path = spark.sql(f"SELECT {row}, X'01' AS digest UNION ALL SELECT {row}, X'02'")
    assert convtrie.prefix_nodes(path) is None
    assert convtrie.prefix_nodes(path.where("digest = X'01'")).count() == 1


# --- secret scan ---

ASSIGN = (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
          r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PLAIN = {"assign": (ASSIGN, 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32),
         "forge": (r"gh[pousr]_([A-Za-z0-9]+)", 1, 36), "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 1, 16),
         "pem": (r"-----BEGIN[A-Z ]*PRIVATE KEY-----", 0, 1)}
BITS = ["password", "passwd", "secret", "TOKEN", "token", "api_key", "apikey", "ApiKey", '"', "'", " ", "  ", "=", ":", "a1b2c3d4", "AKIA", "AKI",
        "AKIAABCDEFGH1234", "0123456789abcdef", "ab", "XYZ", "é", "\n", "ghp_", "eyJ", ".", "-", "-----BEGIN", "PRIVATE KEY-----", " RSA ",
        "\0", "z" * 9, "/+_", "f" * 33, "ſecret", "toKen", "𝄞"]


def plain_spans(text):
    found = [(m.start(), k, kind, m.end(), m.group()) for k, (kind, (pattern, group, least)) in enumerate(PLAIN.items())
             for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(kind, start, end, match) for start, _, kind, end, match in sorted(found)]


def test_secrets_equal_separate_searches(spark):
    rng = random.Random(6)
    texts = [None, "", "x" * 300_000 + " token = " + "k" * 9, "token=" + " " * 200_000 + "'abcdefgh1"]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r.spans for r in secretscan.secrets(docs).collect()}
    assert {i: [tuple(s) for s in v] for i, v in got.items()} == {i: plain_spans(t or "") for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 800
    assert secretscan.secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lanes", [1, 2, 7, 64])
def test_lanes_do_not_change_the_states(lanes):
    rng = random.Random(2)
    machine = secretscan.combined(secretscan.BASE)
    for _ in range(60):
        data = np.frombuffer("".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))).encode(), np.uint8)
        now, want = 0, []
        for b in data:
            now = machine.moves[now + machine.classes[b]]
            want.append(now)
        assert secretscan.states(machine, data, lanes).tolist() == want


def test_automaton_is_minimal_and_refuses_what_one_pass_cannot_tell():
    machine = secretscan.combined((secretscan.Rule("ab", "(a|A)b+"), secretscan.Rule("again", "[aA]b+")))
    assert len(machine.moves) // machine.width == 3  # nothing, after a letter a, inside both
    for pattern in ("(ab)*", "a|b", "[a-c]x*y|bx*", r"\x00a", "é+", "a(b|cb)+"):
        with pytest.raises(ValueError):
            secretscan.combined((secretscan.Rule("bad", pattern),))


def test_registered_columns(spark):
    found = queries.queries()["op13_secret_scan"](spark, "/root/testdata/sf0.01")
    row = found.where(F.col("n_assign") > 0).first()
    assert row.spans.count("assign:") == row.n_assign and len(row.base_sha256) == 64
