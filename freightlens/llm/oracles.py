"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import secrets, sharding

_U = "(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


def _level(by: str, size: str, weight: str, total: str) -> str:
    """Share of each row: capped at three times its size, the rest by weight at one level."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    upto = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY need RANGE UNBOUNDED PRECEDING)"
    return f"""SELECT *, CASE WHEN capped THEN 3.0 * {size} ELSE {weight} * (({total} - 3.0 * coalesce(sum(CASE WHEN capped THEN {size} END) {over}, 0)) / sum(CASE
  WHEN NOT capped THEN {weight} END) {over}) END AS share
  FROM (SELECT *, CASE WHEN w > 0 THEN ({total} - full_) / w >= need ELSE {total} - full_ >= 0 END AS capped
    FROM (SELECT *, 3.0 * sum({size}) {upto} AS full_, sum({weight}) {over} - sum({weight}) {upto} AS w FROM (SELECT *,
      3.0 * {size} / {weight} AS need FROM """


MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, {_U} AS u
  FROM documents),
k AS (SELECT *, CASE WHEN size < 64 THEN 1 ELSE 2 END AS class, u / (1.0 - u) AS odds FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
t AS ({_level("", "source_size", "weight", "total")} (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s))))),
c AS (SELECT k.source, class, CAST(sum(size) AS BIGINT) AS csize, class * CAST(sum(size) AS BIGINT) AS cweight,
  any_value(source_size) AS source_size, any_value(share) AS target FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source GROUP BY k.source, class),
l AS (SELECT *, share / csize AS copies FROM ({_level("source", "csize", "cweight", "target")} (SELECT * FROM c WHERE csize > 0)))))),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p,
  sum((copies - floor(copies)) * csize) OVER (PARTITION BY source) AS left_, sum(CASE
  WHEN copies > floor(copies) THEN csize END) OVER (PARTITION BY source) AS open_ FROM l),
q AS (SELECT *, CASE WHEN p > 0 AND left_ / open_ < 1 THEN (p / (1 - p)) / ((left_ / open_) / (1 - left_ / open_)) END AS by_ FROM p),
r AS (SELECT k.*, left_, (odds / by_) / (1.0 + odds / by_) AS rank_ FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source AND k.class = q.class
  WHERE by_ IS NOT NULL AND size > 0),
units AS (SELECT source, rank_, doc_id, u, sum(size) AS n, max(left_) AS left_ FROM r GROUP BY source, rank_, doc_id, u),
chosen AS (SELECT source, doc_id, u, rank_ FROM (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank_, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM units) WHERE 2 * upto - n <= 2 * left_)
SELECT k.doc_id, k.size, c.source_size, c.target, CAST(k.size * (coalesce(q.whole, 0) + CASE WHEN chosen.rank_ IS NOT NULL THEN 1
  ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.class = c.class LEFT JOIN q ON k.source IS NOT DISTINCT FROM q.source
  AND k.class = q.class
LEFT JOIN chosen ON chosen.source IS NOT DISTINCT FROM k.source AND chosen.doc_id IS NOT DISTINCT FROM k.doc_id AND chosen.u = k.u AND k.size > 0
  AND by_ IS NOT NULL"""

_N, _M = len(sharding.SHARDS), sharding.TABLE_SIZE
SHARDING = f"""WITH RECURSIVE shards AS (SELECT s, 'shard-' || lpad(CAST(s AS VARCHAR), 2, '0') AS name FROM range({_N}) t(s)),
steps AS (SELECT s, name, ('0x' || substr(md5(name || ':offset'), 1, 12))::BIGINT % {_M} AS first, ('0x' || substr(md5(name || ':skip'), 1,
  12))::BIGINT % {_M - 1} + 1 AS skip FROM shards),
prefer AS (SELECT list(slots ORDER BY s) AS lists FROM (SELECT s, list_transform(range({_M}), lambda j: (first + j * skip) % {_M}) AS slots
  FROM steps)),
fill AS (SELECT 0 AS claim, list_transform(range({_M}), lambda j: CAST(NULL AS BIGINT)) AS owner UNION ALL
  SELECT claim + 1, list_transform(owner, lambda v, i: CASE WHEN i = slot + 1 THEN claim % {_N} ELSE v END)
  FROM (SELECT claim, owner, list_filter(lists[claim % {_N} + 1], lambda x: owner[x + 1] IS NULL)[1] AS slot FROM fill, prefer WHERE claim < {_M})),
owners AS (SELECT unnest(owner) AS s, unnest(range({_M})) AS slot FROM fill WHERE claim = {_M})
SELECT doc_id, CAST(o.slot AS INT) AS slot, name AS shard FROM documents
  JOIN owners o ON o.slot = ('0x' || substr(md5('place:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % {_M} JOIN shards USING (s)"""


def _spans(k: int, r: secrets.Rule) -> str:
    pattern = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT k AS row, {k} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i],
  lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start, unnest(m) AS found, unnest(v) AS value
  FROM (SELECT k, string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}, 0) AS m,
    regexp_extract_all(text, {pattern}, {r.group}) AS v FROM d WHERE regexp_matches(text, {pattern}))"""


def _joined(where: str) -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    return f"coalesce(string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(found) AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE {where}), '')"


_LEAST = " ".join(f"WHEN {k} THEN {max(1, r.least)}" for k, r in enumerate(secrets.RULES))
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT * FROM ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))}) WHERE length(value) >= CASE kind {_LEAST} END)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, name in enumerate(secrets.BASE))},
  sha256({_joined(f"kind < {len(secrets.BASE)}")}) AS base_sha256, {_joined("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN spans ON spans.row = d.k GROUP BY d.k"""


def _components(nodes: str, links: str) -> str:
    """Nodes (k, id) and links (a, b) to reach (k, component_id)."""
    return f"""ends AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT k, k AS other FROM {nodes} UNION SELECT reach.k, ends.b FROM reach JOIN ends ON ends.a = reach.other),
component AS (SELECT reach.k, min(n.id) AS component_id FROM reach JOIN {nodes} n ON n.k = reach.other GROUP BY reach.k)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NGRAM_JOIN = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT row_number() OVER () AS row, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
nodes AS (SELECT row_number() OVER () AS k, s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT k, len(s) AS n, unnest(s) AS g FROM nodes),
links AS (
  SELECT x.k AS a, y.k AS b FROM grams x JOIN grams y ON x.g = y.g AND x.k < y.k
  GROUP BY x.k, y.k, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_components("nodes", "links")}
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN component USING (k)"""

EMBEDDINGS = f"""WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS k, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT * FROM rows_ WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.k AS a, y.k AS b FROM usable x JOIN usable y ON x.k < y.k AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
{_components("rows_", "links")},
degree AS (SELECT a AS k, count(*) AS n FROM ends GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept
FROM rows_ LEFT JOIN component USING (k) LEFT JOIN degree USING (k)"""

CHAT = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, FALSE AS added FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', TRUE UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', TRUE),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[ROLE|\[/ROLE\]'))
    + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 5
      ELSE 6 + length(role) + len(regexp_extract_all(role, '[\\[\]<>\s]')) + 2 + 8 END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, added"""

INFILL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (
  SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(hex, i, 8) AS BIGINT)) AS h FROM d),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(t[b + 1:], ''), '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


def _assigned(k: int) -> str:
    """Parts by codebook c{k}: each one's entry and squared distance."""
    return f"""a{k} AS MATERIALIZED (
  SELECT k, p, arg_min(e, d * 64 + e) AS e, min(d) AS d, any_value(y) AS y FROM (
    SELECT parts.k, p, e, y, CAST(list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN c{k} USING (p)) GROUP BY k, p)"""


def _moved(k: int) -> str:
    """Codebook c{k + 1} from the parts' entries of c{k}."""
    return f"""c{k + 1} AS MATERIALIZED (
  SELECT c{k}.p, c{k}.e, coalesce(any_value(n.c), any_value(c{k}.c)) AS c FROM c{k} LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS c FROM (
      SELECT p, e, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
      FROM (SELECT p, e, unnest(y) AS x, unnest(range(len(y))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e) n
  ON n.p = c{k}.p AND n.e = c{k}.e GROUP BY c{k}.p, c{k}.e)"""


VECTOR_CODES = f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT k, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS y FROM v, range(16) t(p)),
least AS (SELECT k, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v QUALIFY e < 64),
c0 AS MATERIALIZED (SELECT p, e, y AS c FROM least JOIN parts USING (k)),
{_assigned(0)},
{_moved(0)},
{_assigned(1)},
{_moved(1)},
{_assigned(2)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS hex FROM c2),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, hex AS codebooks_sha256
FROM v JOIN coded USING (k), books"""
