"""DuckDB SQL for the queries of this subpackage that SQL can express; plain brute force over whole tables."""

from __future__ import annotations

from . import licenses

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x != '')"


def decontamination(width: int) -> str:
    words = _words(_LOWER.format("coalesce(text, '')"), _ALNUM)
    return f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + least({width}, len(w)) - 1], ' ') AS s, least({width}, len(w)) AS n FROM items, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {words} AS w FROM documents),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS MATERIALIZED (SELECT doc_id, i, occ.n, item FROM occ JOIN win USING (s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _hash(seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)"


def _filled(name: str, rows: str, group: str, weight: str, tie: str) -> str:
    """CTEs that end in ``name``: ``rows(cap, wanted, <weight>)`` with ``given``."""
    part = f"PARTITION BY {group} " if group else ""
    order = f"{part}ORDER BY cap / {weight}, {tie}"
    return f"""{name}1 AS (SELECT *, (wanted - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line, row_number() OVER ({order}) AS place FROM {rows}),
{name}2 AS (SELECT *, line * {weight} >= cap AS is_full FROM {name}1),
{name}3 AS (SELECT *, arg_min(line, place) FILTER (WHERE NOT is_full) OVER ({part}) AS level FROM {name}2),
{name} AS MATERIALIZED (SELECT * EXCLUDE (line, place, is_full, level), CASE WHEN is_full THEN cap ELSE level * {weight} END AS given FROM {name}3)"""


def mixture(weights: list[float], share: float, copies: float, seed: str = "mix-1:") -> str:
    turns = ", ".join(f"{w}::DOUBLE" for w in weights)
    text = f"""WITH r AS MATERIALIZED (SELECT doc_id, source, CAST(len({_words("coalesce(text, '')", _SPACE)}) AS BIGINT) AS size, {_hash(seed)} AS h FROM documents),
rows_ AS MATERIALIZED (SELECT *, CASE WHEN size BETWEEN 50 AND 5000 THEN 2::DOUBLE ELSE 1::DOUBLE END AS pref, (h + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM r),
cells0 AS MATERIALIZED (SELECT source, pref, CAST(sum(size) AS BIGINT) AS n FROM rows_ GROUP BY ALL),
src0 AS (SELECT source, CAST(sum(n) AS BIGINT) AS source_size FROM cells0 GROUP BY 1),
srcw AS (SELECT *, [{turns}][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} + 1 AS INTEGER)] AS w, {copies}::DOUBLE * source_size AS cap, {share}::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS wanted FROM src0),
{_filled("src", "srcw", "", "w", "source IS NULL, source")},
cellw AS (SELECT c.source, c.pref, c.n, s.source_size, s.given AS target, s.given AS wanted, {copies}::DOUBLE * c.n AS cap, c.pref * c.n AS wn FROM cells0 AS c JOIN src AS s ON c.source IS NOT DISTINCT FROM s.source),
cell0 AS (SELECT * FROM cellw WHERE n > 0),
{_filled("cell", "cell0", "source", "wn", "pref")},
cells AS MATERIALIZED (SELECT source, pref, n, source_size, target, floor(e) AS sure, e - floor(e) AS p FROM (SELECT *, least(given / n, {copies}::DOUBLE) AS e FROM cell UNION ALL SELECT *, 0::DOUBLE, 0::DOUBLE FROM cellw WHERE n = 0)),
lft AS (SELECT source, first(target) - sum(sure * n) AS lft FROM cells GROUP BY 1 HAVING max(p) > 0),
keyed AS MATERIALIZED (SELECT a.*, c.source_size, c.target, c.sure, CASE WHEN c.p > 0 THEN (u / (1 - u)) / (c.p / (1 - c.p)) END AS k FROM rows_ AS a JOIN cells AS c ON a.source IS NOT DISTINCT FROM c.source AND a.pref = c.pref),
ran AS (SELECT t.*, l.lft, sum(size) OVER (PARTITION BY t.source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed AS t JOIN lft AS l ON t.source IS NOT DISTINCT FROM l.source WHERE k IS NOT NULL),
fate AS MATERIALIZED (SELECT *, upto <= lft AS inside FROM ran),
g0 AS MATERIALIZED (SELECT source, first(lft) - coalesce(sum(size) FILTER (WHERE inside), 0) AS gap, []::BIGINT[] AS chosen FROM fate GROUP BY 1 HAVING NOT bool_and(inside))"""
    for i, fits in enumerate(("size <= gap", "size <= gap", "abs(size - gap) < gap AND (size <= gap OR abs(size - gap) < size)"), 1):
        text += f""",
b{i} AS (SELECT g.source, arg_min({{'d': doc_id, 's': size}}, (abs(size - gap), k, size, doc_id)) AS f FROM g{i - 1} AS g JOIN fate AS t ON t.source IS NOT DISTINCT FROM g.source WHERE NOT inside AND size > 0 AND NOT list_contains(chosen, doc_id) AND {fits} GROUP BY 1),
g{i} AS MATERIALIZED (SELECT g.source, gap - coalesce(f.s, 0) AS gap, CASE WHEN f IS NULL THEN chosen ELSE list_append(chosen, f.d) END AS chosen FROM g{i - 1} AS g LEFT JOIN b{i} AS b ON b.source IS NOT DISTINCT FROM g.source)"""
    return text + """,
taken AS (SELECT doc_id FROM fate WHERE inside UNION ALL SELECT unnest(chosen) FROM g3)
SELECT doc_id, size, source_size, target, CAST((sure + CASE WHEN doc_id IN (SELECT doc_id FROM taken) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM keyed"""


def near_duplicates(percent: int) -> str:
    """Two-word shingles: all pairs that share one, and reachability."""
    words = _words(_LOWER.format("coalesce(text, '')"), _SPACE)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) AS e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) AS c ON c.a = d.doc_id"""


def shards(limit: int) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, {_hash("")} AS h FROM documents),
node AS (SELECT k, h >> (52 - k) AS p FROM d, unnest(range(0, 53)) AS t(k) GROUP BY ALL HAVING sum(n_bytes) > {limit} AND count(*) > 1),
deep AS (SELECT doc_id, max(k) + 1 AS depth FROM d JOIN node ON d.h >> (52 - node.k) = node.p GROUP BY 1)
SELECT doc_id, n_bytes, CAST(coalesce(depth, 0) AS INTEGER) AS depth, left(lpad(bin(h), 52, '0'), CAST(coalesce(depth, 0) AS INTEGER)) AS shard FROM d LEFT JOIN deep USING (doc_id)"""


def license_scan() -> str:
    table = "[" + ", ".join(f"'{s}'" for s in licenses.SENTENCES) + "]"

    def ids(text: str) -> str:
        cut = rf"regexp_replace({text}, '([.!?])[ \t]+', '\1' || chr(10), 'g')"
        parts = f"string_split_regex({_LOWER.format(cut)}, '[\\n\\r]+')"
        place = f"list_position({table}, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        found = f"list_filter(list_transform({parts}, lambda s: coalesce({place}, 0)), lambda k: k > 0)"
        return f"array_to_string(list_transform({found}, lambda k: ',' || k || ','), '')"

    text = f"""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{"|".join(licenses.HINTS)}') THEN text ELSE '' END AS text FROM documents),
m0 AS (SELECT doc_id, {ids("text")} AS l, {ids(r"regexp_replace(text, '[\n\r]+', ' ', 'g')")} AS p, []::VARCHAR[] AS found, '' AS x FROM t),
n0 AS (SELECT doc_id, l, l AS a, p AS b, found FROM m0)"""
    ordered = sorted(licenses.RULES, key=lambda r: -len(r[1]))
    for i, (name, sequence) in enumerate(ordered, 1):
        mark = "".join(f",{k}," for k in sequence)
        text += f",\nn{i} AS (SELECT doc_id, l, replace(a, '{mark}', '|') AS a, replace(b, '{mark}', '|') AS b, CASE WHEN contains(a, '{mark}') OR contains(b, '{mark}') THEN list_append(found, '{name}') ELSE found END AS found FROM n{i - 1})"
    return text + f"\nSELECT doc_id, CAST((length(l) - length(replace(l, ',', ''))) // 2 AS BIGINT) AS n_sentences, array_to_string(list_sort(list_distinct(found)), ',') AS licenses FROM n{len(ordered)}"
