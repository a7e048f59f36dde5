"""DuckDB counterparts of document queries, written from the definitions and not from the methods."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: CTE ``crc_table``: one row with the 256 remainders of CRC-32 (reflected, polynomial 0xEDB88320).
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS remainders
)"""


def crc32(column: str) -> str:
    """crc32 of a column's decimal text, where ``crc_table`` is joined."""
    codes = f"list_transform(string_split({column}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


PERIODIC_RUNS = f"""
WITH {CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc32('doc_id')} AS h
  FROM documents, crc_table
),
sized AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 AS g FROM docs),
cut AS (SELECT *, g % greatest(n, 1) AS a FROM sized),
planned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
words AS (
  SELECT r, n, i, CASE WHEN again AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planned)
),
pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
),
stretches AS (
  SELECT r, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
),
runs AS (SELECT r, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
best AS (
  SELECT r, count(*) AS n_runs, first({{'s': s, 'n': e - s, 'q': q}} ORDER BY (e - s) / q DESC, s, q) AS b,
         string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r
),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS line FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

CONVERSATION_TRIE = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT conv_id, turns, {crc32('conv_id')} % 4 AS h FROM own, crc_table),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
),
members AS (SELECT conv_id, len(turns) AS length, depth, turns[1:depth] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '{WORD}')) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, path
),
parents AS (SELECT *, path[1:depth - 1] AS above FROM nodes WHERE depth > 0),
children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM parents GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.depth = children.depth AND nodes.path = children.path),
subtrees AS (
  SELECT k AS depth, path[1:k] AS path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY 1, 2
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON c.depth = s.depth AND c.path = s.path
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]
"""


#: Words of letters, digits and everything beyond ASCII, capitals of ASCII lowered.
_PLAIN = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
items AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1:s + k], ' ') AS win
  FROM (SELECT *, least(len(w), 13) AS k, unnest(range(greatest(1, len(w) - 12))) AS s FROM items WHERE len(w) > 0)
),
places AS (
  SELECT r, k, s, array_to_string(w[s + 1:s + k], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS s FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
),
hits AS (SELECT p.r, p.s, p.k, i.item_id FROM places p JOIN windows i ON p.k = i.k AND p.win = i.win),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + k)) AS i FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)
"""


def url_filters(rules: list[tuple[str, str, str]], damping: float = 0.85, threshold: float = 0.5, rounds: int = 60) -> str:
    """Rules by host suffix and path, else trust and distrust summed over walks of up to ``rounds`` links.

    The query's own sums stop at its tolerance, so ranks agree to that where hosts link to each other in circles.
    """
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    start = 1 - damping

    def walk(name: str, seeds: str, source: str, target: str) -> str:
        return f"""
{name}_edges AS (SELECT {source} AS a, {target} AS b, n / sum(n) OVER (PARTITION BY {source}) AS weight FROM links),
{name}_walk AS (
  SELECT host, 0 AS step, {seeds} / greatest((SELECT sum({seeds}) FROM hosts), 1) * {start!r}::DOUBLE AS mass FROM hosts WHERE {seeds} > 0
  UNION ALL SELECT b, step + 1, sum(mass * weight * {damping}::DOUBLE) FROM {name}_walk JOIN {name}_edges ON a = host WHERE step < {rounds} GROUP BY b, step
),
{name} AS (SELECT host, sum(mass) AS mass FROM {name}_walk GROUP BY host)"""

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE rules(h, p, verdict) AS (VALUES {rows}),
rests AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (
  SELECT parts.r, h || p AS rule, verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY parts.r ORDER BY length(h || p) DESC, h || p) = 1
),
judged AS (SELECT parts.*, rule, verdict AS ruled FROM parts LEFT JOIN fits USING (r)),
hosts AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad FROM judged GROUP BY host),
links AS (
  SELECT host AS src, dst, count(*) AS n FROM (
    SELECT host, {lower.format("unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''\\s>]+)', 1))")} AS dst FROM parts)
  WHERE host <> '' AND host <> dst GROUP BY ALL
),{walk('trusted', 'good', 'src', 'dst')},{walk('distrusted', 'bad', 'dst', 'src')}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) > {threshold} * (coalesce(t.mass, 0) + coalesce(d.mass, 0))
       THEN 'block' ELSE 'allow' END) AS verdict, coalesce(t.mass, 0.0)::DOUBLE AS trust, coalesce(d.mass, 0.0)::DOUBLE AS distrust
FROM judged j LEFT JOIN trusted t ON t.host = j.host LEFT JOIN distrusted d ON d.host = j.host
"""


def water(family: list[str], level: str) -> str:
    """CTEs ``<level>_nodes`` and ``<level>_given``: the level L of each family at which its children, each giving at most its
    supply and otherwise its weight times L, give the family's budget."""
    path = ", ".join([*family, level])
    keys = f"PARTITION BY {', '.join(family)}" if family else ""
    budget = f"(SELECT {', '.join(family)}, given AS budget FROM {family[-1]}_given)" if family else "(SELECT least(budget, supply) AS budget FROM whole)"
    join = f"JOIN {budget} AS b USING ({', '.join(family)})" if family else f"CROSS JOIN {budget} AS b"
    on = f"USING ({', '.join(family)})" if family else "ON TRUE"
    pick = f"{', '.join(family)}, " if family else ""
    return f"""
{level}_nodes AS (
  SELECT n.*, b.budget, supply / weight AS ratio FROM (
    SELECT {path}, sum(tokens * epochs)::DOUBLE AS supply, coalesce((SELECT max(weight) FROM weights WHERE level = '{level}' AND node = leaves.{level}), 1.0) AS weight
    FROM leaves, config GROUP BY {path}, epochs) AS n {join}
),
{level}_steps AS (
  SELECT *, (budget - coalesce(sum(supply) OVER ({keys} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER ({keys} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS height FROM {level}_nodes
),
{level}_water AS (SELECT {pick}arg_min(height, (ratio, {level})) FILTER (WHERE supply > weight * height) AS surface FROM {level}_steps {'GROUP BY ' + ', '.join(family) if family else ''}),
{level}_given AS (
  SELECT {path}, CASE WHEN surface IS NULL OR supply <= weight * surface THEN supply ELSE weight * surface END AS given FROM {level}_nodes LEFT JOIN {level}_water {on}
)"""


def mixing(weights: list[tuple[str, str, float]], share: float, epochs: int, seed: int) -> str:
    """The mix of ``documents`` dealt to three domains by the MD5 of their source."""
    rows = ", ".join(f"('{level}', '{node}', {weight}::DOUBLE)" for level, node, weight in weights)
    order = f"('0x' || substr(md5('{seed}:' || epoch || ':' || place), 1, 8))::BIGINT"
    return f"""
WITH config AS (SELECT {epochs} AS epochs), weights(level, node, weight) AS (VALUES {rows}),
docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS place, 'd' || ((('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT) % 3) AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
whole AS (SELECT sum(tokens) * {share} AS budget, sum(tokens)::DOUBLE * {epochs} AS supply FROM leaves),
{water([], 'domain')},{water(['domain'], 'language')},{water(['domain', 'language'], 'source')},
plan AS (
  SELECT domain, language, source, tokens, floor(given + 1e-6)::BIGINT AS given FROM leaves JOIN source_given USING (domain, language, source)
  WHERE tokens > 0 AND floor(given + 1e-6) > 0
),
turns AS (
  SELECT d.*, unnest(range(1, given // tokens + 2)) AS epoch, given // tokens AS full_epochs, given % tokens AS rest
  FROM docs d JOIN plan USING (domain, language, source)
),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source, epoch ORDER BY {order}, place, n_tokens
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turns
)
SELECT doc_id, domain, language, source, n_tokens, epoch::INTEGER AS epoch FROM placed WHERE epoch <= full_epochs OR used < rest
"""


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: (kind, pattern of any match, pattern of a whole match that counts)
SECRETS = [
    ("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
     """[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]{8,}"""),
    # The matches of these two that are long enough are those of the pattern with the length.
    ("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12,}"),
    ("hex", "[0-9a-f]{32,}", "[0-9a-f]{32,}"),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}"),
    ("pem", "-----BEGIN[A-Z ]*PRIVATE KEY-----", "-----BEGIN[A-Z ]*PRIVATE KEY-----"),
]


def spans_sql(order: int, kind: str, pattern: str, whole: str) -> str:
    """Matches in order; each begins where its text first occurs after the one before it."""
    return f"""
  SELECT r, {order} AS rule, '{kind}' AS kind, found[i].start AS start, found[i].stop AS stop
  FROM (SELECT r, found, unnest(range(2, len(found) + 1)) AS i FROM (
    SELECT r, list_reduce(list_prepend([{{'start': 0, 'stop': 0, 'match': ''}}],
             list_transform(regexp_extract_all(text, '{pattern}'), lambda m: [{{'start': 0, 'stop': 0, 'match': m}}])),
             lambda done, m: list_append(done, {{
               'start': done[-1].stop + instr(substr(text, done[-1].stop + 1), m[1].match) - 1,
               'stop': done[-1].stop + instr(substr(text, done[-1].stop + 1), m[1].match) - 1 + length(m[1].match),
               'match': m[1].match}})) AS found
    FROM docs WHERE regexp_matches(text, '{whole}')))
  WHERE regexp_full_match(found[i].match, '{whole}')"""


SECRET_SCAN = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(spans_sql(i, *rule) for i, rule in enumerate(SECRETS))}),
lists AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (WHERE rule < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (r)
"""
