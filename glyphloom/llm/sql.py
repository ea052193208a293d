"""DuckDB SQL of the operators that SQL can express, by query name."""

from __future__ import annotations

from glyphloom.llm.secrets import BASE, KINDS, REPOS, RUN


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(number: int, pattern: str, group: int) -> str:
    q = _quoted(pattern)
    return (f"SELECT rn, doc_id, source, {number} k, generate_subscripts(string_split_regex(t, {q}), 1) i, "
            f"unnest(string_split_regex(t, {q})) gap, unnest(regexp_extract_all(t, {q}, 0)) whole, "
            f"unnest(regexp_extract_all(t, {q}, {group})) val FROM d")


_PATTERNS = [*((p, g) for p, g, _ in BASE.values()), (RUN, 0)]
_LEAST = " ".join(f"WHEN {n} THEN length(val) >= {least}"
                  for n, (_, _, least) in enumerate(BASE.values()))
_NAMES = " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS))
_SPAN = f"(CASE k {_NAMES} END) || ':' || s || ':' || e"

OP8 = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () rn, doc_id, source, coalesce(text, '') t FROM documents),
m AS ({" UNION ALL ".join(_matches(n, p, g) for n, (p, g) in enumerate(_PATTERNS))}),
placed AS (
  SELECT *, length(gap) + coalesce(sum(length(gap) + coalesce(length(whole), 0)) OVER (
    PARTITION BY rn, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM m),
hits AS (
  SELECT rn, doc_id, source, k, CAST(s AS BIGINT) s, CAST(s + length(whole) AS BIGINT) e, val
  FROM placed WHERE whole IS NOT NULL AND CASE k {_LEAST} ELSE regexp_matches(val, '[A-Z]')
    AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]') END),
owned AS (SELECT val, count(DISTINCT coalesce(source, chr(1))) owners,
    count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), chr(1))) repos FROM hits GROUP BY val),
kept AS (SELECT hits.* FROM hits JOIN owned USING (val) WHERE k < {len(BASE)} OR owners <= 1 AND repos <= {REPOS}),
spans AS (
  SELECT rn, count(*) FILTER (k = 0) n_assign, count(*) FILTER (k = 1) n_access,
    count(*) FILTER (k = 2) n_hex,
    string_agg({_SPAN}, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) base,
    string_agg({_SPAN}, ',' ORDER BY s, k) spans
  FROM kept GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access,
  coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN spans USING (rn)
"""

_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m} m, unnest(list_transform(range(1, len(w) - {m - 2}), "
    f"lambda i: array_to_string(w[i:i + {m - 1}], ' '))) phrase FROM pieces" for m in (1, 2, 3))

OP11 = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(text, '{_A}', '{_A.lower()}'), '[.,;:!?\\x0A-\\x0D]')) p FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') w FROM cut),
counted AS (SELECT lang, m, phrase, count(*) f FROM ({_GRAMS}) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) n FROM counted WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f a, string_split(phrase, ' ') w FROM counted WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT lang, m, phrase, a, w, k, array_to_string(w[:k], ' ') front, array_to_string(w[k + 1:], ' ') rest
  FROM (SELECT *, unnest(range(1, m)) k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f l, y.f r,
    CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.front AND x.m = c.k
  JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest AND y.m = c.m - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') phrase, max(a) held
  FROM (SELECT *, unnest([1, 2]) i FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op8_secret_ownership": OP8, "op11_prefix_subtrees": OP11}
