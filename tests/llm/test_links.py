"""Trust and distrust reach hosts many links away, however many pages without links the table holds."""

import random

import duckdb

from actuspark.llm import links, sql


def test_chains_among_many_unlinked_pages(spark):
    hops, rules = 30, [("bad.net", "/", "block"), ("blocked.net", "/", "block")]
    pages = [(i, f"http://h{i}.org/", f"<a href='http://{f'h{i - 1}.org' if i else 'bad.net'}/'>") for i in range(hops)]
    pages += [(1000, "http://bad.net/", None)] + [(2000 + i, f"http://blocked.net/{i}", None) for i in range(3000)]
    out = links.filtered(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    got = {r.page_id: r for r in out.where("page_id < 1000").collect()}
    assert [got[i].verdict for i in range(hops)] == ["block"] * hops
    assert all(abs(got[i].distrust / (0.15 / 3001 * 0.85 ** (i + 1)) - 1) < 1e-9 for i in (0, 1, hops - 1))


def test_ranks_equal_sums_over_walks(spark):
    """Random hosts that link to each other, in circles too, against SQL that adds up walks of 60 links."""
    rng = random.Random(11)
    rules = [("a.org", "/", "allow"), ("b.org", "/x", "block"), ("sub.b.org", "/", "allow")]
    hosts = ["a.org", "A.org", "b.org", "sub.b.org", "c.net", "d.net", "e.net", "f.net", "g.net"]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['x', 'y/z', ''])}{rng.choice(['', '?q', '#t'])}",
              " ".join(f"<a HREF = 'https://{rng.choice(hosts)}/p'>" for _ in range(rng.randint(0, 3))) if i % 5 else None) for i in range(80)]
    pages += [(100, None, "<a href='//a.org'>"), (101, "nothing", None), (102, "http://h.net", "<a href=//c.net> <a href='//h.net/'>"), (7, *pages[7][1:])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    want = sorted(con.sql(sql.url_filters(rules, damping=0.3)).fetchall(), key=str)
    got = sorted((tuple(r) for r in links.filtered(frame, rules, damping=0.3, tolerance=1e-6).collect()), key=str)
    assert [w[:5] for w in want] == [g[:5] for g in got] and {w[4] for w in want} == {"allow", "block"}
    assert all(abs(a - b) < 1e-6 for w, g in zip(want, got) for a, b in zip(w[5:], g[5:]))
