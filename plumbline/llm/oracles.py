"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from itertools import permutations

_K = """SELECT CASE WHEN k = 0 OR good = 0 OR good = n OR n - nn / n <= 0 THEN 1000.0
  WHEN share <= 1 / 1001.0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / share - 1)) END AS k
FROM (SELECT *, (gg - good * good / n - (k - 1) * (good / n) * (1 - good / n)) / (n - nn / n) / ((good / n) * (1 - good / n)) AS share
  FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS good,
    CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(good AS DOUBLE) * good / n) AS gg FROM {} WHERE n > 0))"""

DOC_LEVELS, SOURCE_LEVELS = 6, 4


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _climb(name: str, levels: int) -> str:
    """CTEs ``name0 .. name<levels>`` (g, r, h, m) from ``name0``, and ``name_s<k>`` with each node's siblings."""
    steps = []
    for k in range(levels):
        here = f"{name}{k}"
        steps.append(f"""{name}_s{k} AS (SELECT g, r,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {here} WHERE m > 1)""")
        steps.append(f"""{name}{k + 1} AS (SELECT g, r // 16 AS r, CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h,
  (m + 15) // 16 AS m FROM {here} GROUP BY g, r // 16, m)""")
    return ",\n".join(steps)


def _fold(tree: str, levels: int, source: str, place: str) -> str:
    """CTEs that lead each row of ``source`` up a tree: ``f`` is folded, ``p`` gathers siblings."""
    steps = []
    for k in range(levels):
        after = f"{tree}_f{k}"
        steps.append(f"""{after} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s.r IS NULL THEN f ELSE sha256(s.b || f || s.a) END AS f,
  p || coalesce(s.b || s.a, '') AS p FROM {source} x LEFT JOIN {tree}_s{k} s ON s.g = x.{'g' if tree == 'doc' else 'one'} AND s.r = x.{place} // {16**k})""")
        source = after
    return ",\n".join(steps)


#: CRC-32 of the decimal key, bit by bit.
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""

#: Levels are written out: 16^6 documents a source, 16^4 sources.
_MERKLE = f"""
WITH own AS (
  SELECT doc_id, source, sha256(concat({', '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})) AS leaf,
    sha256(concat({', '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))},
      {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) AS lowered
  FROM documents),
keyed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, 0 AS one FROM own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS m FROM keyed),
doc0 AS (SELECT g, r, leaf AS h, m FROM ranked),
{_climb('doc', DOC_LEVELS)},
top0 AS (SELECT 0 AS g, g AS r, h, count(*) OVER () AS m FROM doc{DOC_LEVELS}),
{_climb('top', SOURCE_LEVELS)},
start AS (SELECT ranked.* EXCLUDE (m), '' AS p,
  CASE WHEN {_CRC} % 5 = 0 THEN lowered ELSE leaf END AS f FROM ranked),
{_fold('doc', DOC_LEVELS, 'start', 'r')},
{_fold('top', SOURCE_LEVELS, f'doc_f{DOC_LEVELS - 1}', 'g')}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM top_f{SOURCE_LEVELS - 1} x JOIN doc{DOC_LEVELS} s ON s.g = x.g CROSS JOIN top{SOURCE_LEVELS} t"""

_ORDERS = ", ".join(
    f"('{''.join(order)}', {k + 1}, '{f}', {sum(1 << 'ABCDE'.index(g) for g in order[:k])}, {1 << 'ABCDE'.index(f)})"
    for order in permutations("ABCDE")
    for k, f in enumerate(order)
)

_AUDIT = f"""
WITH own AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM own),
marked AS (SELECT part,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) THEN 1 ELSE 0 END AS good,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN 1 ELSE 0 END AS toxic
  FROM cut),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
steps(filter_order, step, filter, before, own) AS (VALUES {_ORDERS}),
rows AS (SELECT part, filter_order, step, filter,
  sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM kinds CROSS JOIN steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM rows"""

ORACLES: dict[str, str] = {
    "op5_url_filter": f"""
WITH own AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
hosts AS (
  SELECT host, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
    string_split(host, '.')[-1] AS suffix, n, good
  FROM (SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS good
    FROM own LEFT JOIN labels ON labels.doc_id = own.page_id AND quality IS NOT NULL GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY suffix),
kh AS ({_K.format('hosts')}),
kd AS ({_K.format('domains')}),
ks AS ({_K.format('suffixes')}),
top AS (SELECT (sum(good) + 1) * 1.0 / (sum(n) + 2) AS m FROM hosts),
sm AS (SELECT suffix, (good + (SELECT k FROM ks) * (SELECT m FROM top)) / (n + (SELECT k FROM ks)) AS m FROM suffixes),
dm AS (SELECT domain, (good + (SELECT k FROM kd) * sm.m) / (n + (SELECT k FROM kd)) AS m FROM domains JOIN sm USING (suffix)),
hm AS (SELECT host, (good + (SELECT k FROM kh) * dm.m) / (n + (SELECT k FROM kh)) AS m, n + (SELECT k FROM kh) AS w FROM hosts JOIN dm USING (domain)),
b AS (SELECT host, m, m - 1.645 * sqrt(m * (1 - m) / (w + 1)) AS lo, m + 1.645 * sqrt(m * (1 - m) / (w + 1)) AS hi FROM hm),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM own JOIN b USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN hi < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  round(m, 6) AS good_share, round(lo, 6) AS lower, round(hi, 6) AS upper
FROM ruled""",
    "op13_merkle_manifest": _MERKLE,
    "op12_filter_audit": _AUDIT,
}
