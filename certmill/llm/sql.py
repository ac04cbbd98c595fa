"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""


def _matches(kind: str, no: int, pattern: str, where: str = "true") -> str:
    """The matches of one kind as rows (doc_id, start_at, no, end_at, kind, m), places from running lengths."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, end_at - length(m) AS start_at, {no} AS no, end_at, '{kind}' AS kind, m FROM (
      SELECT doc_id, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS end_at FROM (
        SELECT doc_id, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS m,
          generate_subscripts(string_split_regex(t, '{p}'), 1) AS i
        FROM docs)
    ) WHERE m IS NOT NULL AND {where}"""


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""(SELECT sum(CASE WHEN k % 2 = 0 THEN d * 2 - CASE WHEN d > 4 THEN 9 ELSE 0 END ELSE d END) % 10 = 0 FROM (
  SELECT k, substr(reverse({_DIGITS}), k, 1)::INT AS d FROM (SELECT unnest(generate_series(1, length({_DIGITS}))) AS k)))"""
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mod97() -> str:
    plain = "replace(m, ' ', '')"
    number = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    for i, c in enumerate(_LETTERS):
        number = f"replace({number}, '{c}', '{10 + i}')"
    # The number in pieces that fit: 15 digits, then the rest with the remainder before it.
    first = f"(substr({number}, 1, 15)::HUGEINT % 97)"
    for at in (16, 31, 46, 61):
        first = f"(CASE WHEN length({number}) >= {at} THEN ({first}::VARCHAR || substr({number}, {at}, 15))::HUGEINT % 97 ELSE {first} END)"
    return f"{first} = 1"


_IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"
_NUMBERS = " AND ".join(f"list_extract(string_split(m, '.'), {i})::HUGEINT <= 255" for i in (1, 2, 3, 4))
_RESULT = """
SELECT d.doc_id, {counts},
  sha256(coalesce((SELECT string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, no) FROM base b WHERE b.doc_id = d.doc_id), '')) AS base_sha256,
  coalesce((SELECT string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, no) FROM every e WHERE e.doc_id = d.doc_id), '') AS spans
FROM docs d
"""


def _result(kinds: list[str]) -> str:
    counts = ", ".join(f"(SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND b.kind = '{k}') AS n_{k}" for k in kinds)
    return _RESULT.format(counts=counts)


OP3 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (
  {_matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")} UNION ALL
  {_matches("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _NUMBERS)} UNION ALL
  {_matches("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")} UNION ALL
  {_matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
every AS MATERIALIZED (
  SELECT * FROM base UNION ALL {_matches("iban", 4, _IBAN, _mod97())} UNION ALL
  SELECT s.* FROM ({_matches("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')")}) s
  JOIN docs USING (doc_id)
  WHERE regexp_matches(lower(substr(t, greatest(start_at - 40, 0)::BIGINT + 1, (start_at - greatest(start_at - 40, 0))::BIGINT)), 'ssn|social security'))
{_result(["email", "ip", "card", "phone"])}
"""

_KEYS = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
_ASSIGN = _KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_IDENT = r"""(?i:\b(?:user_?name|user|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,64}"""
_MIXED = "length(m) BETWEEN 20 AND 128 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"

OP7 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (
  {_matches("assign", 0, _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8")} UNION ALL
  {_matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16")} UNION ALL
  {_matches("hex", 2, "[0-9a-f]+", "length(m) >= 32")}),
weak AS MATERIALIZED (
  SELECT * FROM (
    {_matches("endpoint", 3, '''https?://[^\\x00-\\x20"'<>]{4,512}''')} UNION ALL
    {_matches("ident", 4, _IDENT)} UNION ALL
    {_matches("weak_secret", 5, "[A-Za-z0-9+/_=-]+", _MIXED)}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start_at < w.end_at AND w.start_at < b.end_at)),
parts AS MATERIALIZED (
  SELECT doc_id, start_at, CASE WHEN kind IN ('access', 'ident') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role
  FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
seen AS MATERIALIZED (
  SELECT w.doc_id, w.start_at, w.no, w.end_at, w.kind, w.m,
    count(DISTINCT CASE WHEN abs(p.start_at - w.start_at) <= 300 AND p.role <> 'endpoint' THEN p.role END) AS roles,
    count(*) FILTER (abs(p.start_at - w.start_at) <= 300 AND p.role = 'id') AS ids,
    count(*) FILTER (abs(p.start_at - w.start_at) <= 300 AND p.role = 'secret') AS secrets
  FROM weak w JOIN parts p USING (doc_id) GROUP BY ALL),
every AS MATERIALIZED (
  SELECT doc_id, start_at, no, end_at, kind, m FROM base UNION ALL
  SELECT doc_id, start_at, no, end_at, kind, m FROM seen
  WHERE (kind = 'endpoint' AND roles = 2) OR (kind = 'ident' AND secrets > 0) OR (kind = 'weak_secret' AND ids > 0))
{_result(["assign", "access", "hex"])}
"""

OP8 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS set_id FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE c * 10 >= 8 * (sa.n + sb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id,
  coalesce((SELECT min(o.doc_id) FROM sizes o WHERE o.set_id = s.set_id), d.doc_id) AS rep_id,
  (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id,
  (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links,
  (SELECT count(DISTINCT o.set_id) FROM links l JOIN sizes o ON o.doc_id = l.b WHERE l.a = d.doc_id AND o.set_id <> s.set_id) AS n_text_links
FROM documents d LEFT JOIN sizes s USING (doc_id)
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP12 = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * big_n) // l) AS m FROM n, total),
asked AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, t, times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (t), total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM w JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""

# A run has at least six places at which a word equals the one a period later.
OP13 = r"""
WITH crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')])),
    lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384))) AS h FROM documents),
shape AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM crc),
docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_concat(w[1 : a], [w[a + 1 + (i % (1 + (n - a) // (3 + g % 8)))] for i in range(n - a)]) ELSE w END AS w FROM shape),
words AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS t FROM docs),
grams AS MATERIALIZED (SELECT doc_id, i, hash(t, lead(t, 1) OVER p, lead(t, 2) OVER p, lead(t, 3) OVER p, lead(t, 4) OVER p, lead(t, 5) OVER p) AS g,
    lead(t, 5) OVER p AS last
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
  WHERE a.last IS NOT NULL AND b.last IS NOT NULL),
stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs) GROUP BY doc_id, q, part),
runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length,
    arg_min(period, (-length, start, period)) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL = {
    "op1_exact_dedup": OP1,
    "op3_pii": OP3,
    "op7_secrets": OP7,
    "op8_jaccard_join": OP8,
    "op10_exact_topk": OP10,
    "op12_lexical_search": OP12,
    "op13_periodic_runs": OP13,
}
