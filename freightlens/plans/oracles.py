"""SQL that gives the rows of the queries, for an engine that has the order tables as views."""

from __future__ import annotations

from datetime import date

from ..operators.constraints import Key, Reference, graph_constraints

START = date(1996, 1, 1)
#: The tables that shipments are made of.
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")
#: The values of the categories in the order tables, in order.
CATEGORIES = {
    "waste_code": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    "management_code": ("H0", "H1", "H2", "H3"),
    "form_code": ("A", "N", "R"),
    "source_code": ("F", "O"),
}

_TABLES = """manifests AS (
  SELECT o_orderkey AS mtn, o_orderdate AS shipped, CAST(o_custkey AS VARCHAR) AS generator, c_name AS generator_name, n_name AS generator_state,
         f.p_brand AS facility, 'Facility ' || f.p_brand AS facility_name, right(f.p_brand, 1) AS facility_state, CASE
           WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS rejection
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT l_orderkey, p_brand FROM (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY l_orderkey)
    JOIN part ON p_partkey = k) f ON f.l_orderkey = o_orderkey),
lines AS (
  SELECT l_orderkey AS mtn, l_linenumber AS line_no, l_quantity AS tons, l_extendedprice AS kg, CASE
    WHEN l_returnflag = 'R' THEN 'Y' END AS hazardous,
         CASE WHEN p_size > 10 THEN p_type END AS usdot_description, CASE
           WHEN p_size > 5 THEN p_type END AS nonhaz_description, 'H' || (p_size % 4) AS management_code,
           CAST(NULL AS VARCHAR) AS management_description,
         l_returnflag AS form_code, 'form ' || l_returnflag AS form_description, l_linestatus AS source_code,
           CAST(NULL AS VARCHAR) AS source_description, 'DM' AS container_code, 'drum' AS container_description
  FROM lineitem JOIN part ON p_partkey = l_partkey),
carriers AS (SELECT l_orderkey AS mtn, CAST(l_suppkey AS VARCHAR) AS transporter, s_name AS transporter_name FROM lineitem LEFT
  JOIN supplier ON s_suppkey = l_suppkey),
imports AS (SELECT DISTINCT o_orderkey AS mtn FROM orders WHERE o_orderpriority = '1-URGENT'),
federal AS (SELECT DISTINCT l_orderkey AS mtn, l_linenumber AS line_no, p_type AS code FROM lineitem JOIN part ON p_partkey = l_partkey),
state AS (SELECT DISTINCT l_orderkey AS mtn, l_returnflag AS code FROM lineitem),
dated AS (SELECT * FROM manifests WHERE shipped >= DATE '1996-01-01')"""

_TOPS = """top_line AS (SELECT line_no, count(*) AS row_count FROM lines WHERE mtn IN (SELECT mtn FROM dated) GROUP BY line_no ORDER BY row_count DESC,
  line_no LIMIT 5),
top_facility AS (SELECT facility, count(*) AS row_count FROM dated WHERE facility IS NOT NULL GROUP BY facility ORDER BY row_count DESC,
  facility LIMIT 12),
top_generator AS (SELECT generator, count(*) AS row_count FROM dated GROUP BY generator ORDER BY row_count DESC, generator LIMIT 300),
top_transporter AS (SELECT transporter, count(*) AS row_count FROM carriers JOIN dated USING (mtn) GROUP BY transporter ORDER BY row_count DESC,
  transporter LIMIT 60)"""

_STAGED = """base AS (SELECT mtn, shipped, CAST(year(shipped) AS INT) AS year, CAST(quarter(shipped) AS INT) AS quarter,
  CAST(year(shipped) * 100 + quarter(shipped) AS INT) AS year_quarter, generator, facility
  FROM dated WHERE facility IN (SELECT facility FROM top_facility) AND generator IN (SELECT generator FROM top_generator)),
carrier_pairs AS (SELECT DISTINCT mtn, transporter FROM carriers WHERE transporter IN (SELECT transporter FROM top_transporter)),
staged AS (
  SELECT mtn, line_no, shipped, year, quarter, year_quarter, generator, facility, hazardous, usdot_description, nonhaz_description, management_code,
    management_description, form_code, form_description, source_code, source_description, container_code, container_description,
         coalesce(usdot_description, nonhaz_description, 'Unknown Waste') AS primary_description, tons, kg, coalesce(n, 0) AS unique_transporters,
         md5(coalesce(hazardous, '') || '|' || coalesce(usdot_description, '') || '|' || coalesce(nonhaz_description, '') || '|' || management_code || '|' || form_code || '|' || source_code || '|' || container_code) AS waste_stream_key
  FROM base JOIN lines USING (mtn) LEFT JOIN (SELECT mtn, count(*) AS n FROM carrier_pairs GROUP BY mtn) USING (mtn)
    WHERE line_no IN (SELECT line_no FROM top_line)),
staged_carriers AS (SELECT year_quarter, mtn, transporter FROM (SELECT DISTINCT year_quarter, mtn FROM staged) JOIN carrier_pairs USING (mtn))"""

_BASE = """base_lines AS (SELECT CAST(year(shipped) * 10 + quarter(shipped) AS INT) AS year_quarter, CAST(date_trunc('quarter',
  shipped) AS DATE) AS quarter_start, generator, facility, lines.line_no, code AS waste_code, tons, management_code, form_code, source_code,
  manifests.mtn
  FROM manifests JOIN lines ON lines.mtn = manifests.mtn JOIN federal ON federal.mtn = lines.mtn AND federal.line_no = lines.line_no
    WHERE facility IS NOT NULL)"""


def _modes(c: str) -> str:
    return f"""mode_{c} AS (SELECT facility, waste_code, year_quarter, v AS mode_{c} FROM (SELECT *, row_number() OVER (PARTITION BY facility, waste_code,
  year_quarter ORDER BY n DESC, v) AS k FROM (SELECT facility, waste_code, year_quarter, {c} AS v, count(*) AS n FROM kept GROUP BY ALL)) WHERE k = 1)"""


def _label(now: str, sums: str) -> str:
    """The columns that follow from lags and the next value."""
    change = f"(next_qty_tons - {now}) / nullif({now}, 0)"
    return (
        f"{sums} AS lag_qty_sum, round({now} / nullif(({sums}) / 4, 0), 6) AS qty_vs_lag_avg_ratio, next_qty_tons, "
        f"CASE WHEN {now} = 0 AND next_qty_tons > 0 THEN 'increase' WHEN {now} = 0 AND next_qty_tons = 0 THEN 'same' WHEN {change} >= 0.05 THEN 'increase' WHEN {change} <= -0.05 THEN 'decrease' ELSE 'same' END AS target_class"
    )


_LAGS = ", ".join(f"lag(qty, {i}) OVER w AS qty_tons_lag_{i}" for i in range(1, 5))
_LAG_NAMES = ", ".join(f"qty_tons_lag_{i}" for i in range(1, 5))
_LAG_SUM = " + ".join(f"coalesce(qty_tons_lag_{i}, 0)" for i in range(1, 5))

_SIMPLE = f"""{_BASE},
kept AS (SELECT * FROM base_lines WHERE waste_code IN (SELECT waste_code FROM base_lines GROUP BY 1 ORDER BY sum(tons) DESC, waste_code LIMIT 3)
  AND facility IN (SELECT facility FROM base_lines GROUP BY 1 ORDER BY sum(tons) DESC, facility LIMIT 10) AND generator IN (SELECT generator
    FROM base_lines GROUP BY 1 ORDER BY sum(tons) DESC, generator LIMIT 300)),
{_modes("management_code")}, {_modes("form_code")}, {_modes("source_code")},
sums AS (SELECT year_quarter, quarter_start, facility, waste_code, count(*) AS waste_line_row_count, count(DISTINCT mtn) AS manifest_count,
  count(DISTINCT generator) AS generator_count, sum(tons) AS qty, avg(tons) AS avg_line_qty_tons, stddev_samp(tons) AS std_line_qty_tons FROM kept
  GROUP BY ALL),
lagged AS (SELECT *, {_LAGS}, lead(qty, 1) OVER w AS next_qty_tons FROM sums WINDOW w AS (PARTITION BY facility, waste_code ORDER BY year_quarter)),
simple AS (SELECT row_number() OVER (ORDER BY facility, waste_code, year_quarter) AS uid, year_quarter, quarter_start, facility, waste_code,
  waste_line_row_count, manifest_count, generator_count, qty AS qty_tons, round(avg_line_qty_tons, 6) AS avg_line_qty_tons, round(std_line_qty_tons,
  6) AS std_line_qty_tons,
  mode_management_code, mode_form_code, mode_source_code, {_LAG_NAMES}, {_label("qty", _LAG_SUM)}
  FROM lagged JOIN mode_management_code USING (facility, waste_code, year_quarter) JOIN mode_form_code USING (facility, waste_code, year_quarter)
    JOIN mode_source_code USING (facility, waste_code, year_quarter) WHERE next_qty_tons IS NOT NULL)"""

_PER = """per AS (SELECT mtn, t.tons, t.kg, c.n AS n_carriers, d.n AS n_codes FROM (SELECT DISTINCT mtn FROM manifests) LEFT JOIN (SELECT mtn,
  sum(tons) AS tons, sum(kg) AS kg FROM lines GROUP BY mtn) t USING (mtn)
  LEFT JOIN (SELECT mtn, count(DISTINCT transporter) AS n FROM carriers GROUP BY mtn) c USING (mtn) LEFT JOIN (SELECT mtn, count(DISTINCT code) AS n
    FROM (SELECT mtn, code FROM federal UNION ALL SELECT mtn, code FROM state) GROUP BY mtn) d USING (mtn))"""


def _year_sql(kind: str) -> str:
    keys = {"GF": "generator, facility", "GT": "generator, transporter", "TF": "transporter, facility"}[kind]
    extra = {
        "GF": "CAST(sum(coalesce(n_carriers, 0)) AS BIGINT) AS unique_transporters, CAST(sum(CASE WHEN rejection = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS rejection_manifest_count, CAST(sum(CASE WHEN mtn IN (SELECT mtn FROM imports) THEN 1 ELSE 0 END) AS BIGINT) AS import_manifest_count",
        "GT": "count(DISTINCT facility) AS unique_facilities",
        "TF": "count(DISTINCT generator) AS unique_generators",
    }[kind]
    source = "dated" if kind == "GF" else "dated JOIN (SELECT mtn, transporter FROM carriers) USING (mtn)"
    return f"""SELECT CAST(year(shipped) AS INT) AS year, {keys}, count(*) AS manifest_count, sum(coalesce(tons, 0)) AS total_waste_tons, round(sum(coalesce(kg,
  0)), 2) AS total_waste_kg, CAST(sum(coalesce(n_codes, 0)) AS BIGINT) AS unique_waste_codes,
  min(shipped) AS first_shipped_date, max(shipped) AS last_shipped_date, {extra} FROM {source} JOIN per USING (mtn)
    WHERE {" AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))} GROUP BY ALL"""


def _quarter_sql(kind: str) -> str:
    keys = {"GF": "generator, facility", "GT": "generator, transporter", "TF": "transporter, facility"}[kind]
    extra = {"GF": "CAST(sum(unique_transporters) AS BIGINT) AS unique_transporters", "GT": "count(DISTINCT facility) AS unique_facilities", "TF": "count(DISTINCT generator) AS unique_generators"}[kind]
    source = "staged" if kind == "GF" else "staged JOIN staged_carriers USING (year_quarter, mtn)"
    return f"""SELECT year, quarter, year_quarter, {keys}, waste_stream_key, count(DISTINCT mtn) AS manifest_count, count(*) AS waste_line_count,
  sum(tons) AS total_waste_tons, round(sum(kg), 2) AS total_waste_kg, {extra}, min(shipped) AS first_shipped_date, max(shipped) AS last_shipped_date
  FROM {source} GROUP BY year, quarter, year_quarter, {keys}, waste_stream_key"""


_NODES = """nodes AS (SELECT 'GENERATOR' AS node_type, generator AS business_id, max(generator_name) AS business_name, max(generator_state) AS state_code
  FROM dated GROUP BY generator
  UNION ALL SELECT 'FACILITY', facility, max(facility_name), max(facility_state) FROM dated WHERE facility IS NOT NULL GROUP BY facility
  UNION ALL SELECT 'TRANSPORTER', transporter, max(transporter_name), NULL FROM carriers JOIN dated USING (mtn) WHERE transporter IS NOT NULL
    GROUP BY transporter)"""

_STREAMS = """streams AS (SELECT DISTINCT waste_stream_key, hazardous, usdot_description, nonhaz_description, management_code, form_code, source_code,
  container_code, primary_description, management_description, form_description, source_description, container_description,
  primary_description || ' | Form: ' || form_description || ' | Mgmt: ' || management_code || ' | Source: ' || source_code || ' | Container: ' || container_description AS display_name FROM staged)"""

_MORE = ("manifest_count", "generator_count", "transporter_count", "generator_pair_count", "transporter_pair_count")
_GEN = ("generator_pair_count", "generator_count", "pair_manifest_count_sum", "pair_waste_line_count_sum", "max_generator_pair_tons", "avg_generator_pair_tons", "repeated_generator_pairs", "summed_unique_transporters_from_pairs")
_TRN = ("transporter_pair_count", "transporter_count", "trans_fac_manifest_count_sum", "trans_fac_waste_line_count_sum", "max_transporter_pair_tons", "avg_transporter_pair_tons", "repeated_transporter_pairs", "summed_unique_generators_from_pairs")
_BOTH = ("global_gen_trans_pair_count", "global_gen_trans_generator_count", "global_gen_trans_transporter_count", "global_gen_trans_manifest_count_sum", "global_gen_trans_waste_line_count_sum", "global_max_gen_trans_pair_tons")


def _named(names: tuple[str, ...], exprs: tuple[str, ...]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in zip(names, exprs))


_SUMS = ("CAST(sum(manifest_count) AS BIGINT)", "CAST(sum(waste_line_count) AS BIGINT)", "max(total_waste_tons)", "avg(total_waste_tons)", "count(*) FILTER (WHERE manifest_count >= 2)")
_GRAPH = f"""gf AS ({_quarter_sql("GF")}), gt AS ({_quarter_sql("GT")}), tf AS ({_quarter_sql("TF")}), {_STREAMS},
cut_f AS (SELECT facility FROM gf GROUP BY 1 ORDER BY sum(total_waste_tons) DESC, facility LIMIT 8), cut_g AS (SELECT generator FROM gf GROUP BY 1
  ORDER BY sum(total_waste_tons) DESC, generator LIMIT 200), cut_t AS (SELECT transporter FROM tf GROUP BY 1 ORDER BY sum(total_waste_tons) DESC,
  transporter LIMIT 40),
own AS (SELECT year, quarter, year_quarter, facility, waste_stream_key, CAST(sum(manifest_count) AS BIGINT) AS manifest_count,
  CAST(sum(waste_line_count) AS BIGINT) AS waste_line_count, sum(total_waste_tons) AS qty, round(sum(total_waste_kg), 2) AS total_waste_kg,
  CAST(sum(unique_transporters) AS BIGINT) AS unique_transporters_from_gf, min(first_shipped_date) AS first_shipped_date,
  max(last_shipped_date) AS last_shipped_date FROM gf JOIN cut_f USING (facility) GROUP BY ALL),
gen AS (SELECT year_quarter, facility, waste_stream_key, {_named(_GEN, ("count(*)", "count(DISTINCT generator)", *_SUMS, "CAST(sum(unique_transporters) AS BIGINT)"))} FROM gf JOIN cut_f USING (facility) JOIN cut_g USING (generator) GROUP BY ALL),
trn AS (SELECT year_quarter, facility, waste_stream_key, {_named(_TRN, ("count(*)", "count(DISTINCT transporter)", *_SUMS, "CAST(sum(unique_generators) AS BIGINT)"))} FROM tf JOIN cut_f USING (facility) JOIN cut_t USING (transporter) GROUP BY ALL),
everywhere AS (SELECT year_quarter, waste_stream_key, {_named(_BOTH, ("count(*)", "count(DISTINCT generator)", "count(DISTINCT transporter)", *_SUMS[:3]))} FROM gt JOIN cut_g USING (generator) JOIN cut_t USING (transporter) GROUP BY ALL),
rows_ AS (SELECT own.*, {", ".join(f"{'round(' if c.startswith('avg') else '('}coalesce({c}, 0){', 6)' if c.startswith('avg') else ')'} AS {c}" for c in (*_GEN, *_TRN, *_BOTH))}, display_name, management_code, form_code, source_code
  FROM own LEFT JOIN gen USING (year_quarter, facility, waste_stream_key) LEFT JOIN trn USING (year_quarter, facility, waste_stream_key) LEFT
    JOIN everywhere USING (year_quarter, waste_stream_key) JOIN streams USING (waste_stream_key)),
lagged AS (SELECT *, {_LAGS}, {", ".join(f"lag({c}) OVER w AS {c}_lag_1" for c in _MORE)}, lead(qty, 1) OVER w AS next_qty_tons
  FROM rows_ WINDOW w AS (PARTITION BY facility, waste_stream_key ORDER BY year_quarter)),
graph_view AS (SELECT row_number() OVER (ORDER BY facility, waste_stream_key, year_quarter) AS uid, year, quarter, year_quarter, facility,
  waste_stream_key, display_name, management_code, form_code, source_code, manifest_count, waste_line_count, qty AS total_waste_tons,
  total_waste_kg, unique_transporters_from_gf, first_shipped_date, last_shipped_date,
  {", ".join((*_GEN, *_TRN, *_BOTH))}, {_LAG_NAMES}, {", ".join(f"{c}_lag_1" for c in _MORE)}, {", ".join(f"{c} - {c}_lag_1 AS {c}_qoq_delta" for c in _MORE)}, {_label("qty", _LAG_SUM)} FROM lagged WHERE next_qty_tons IS NOT NULL)"""

_SERIES = f"""sums AS (SELECT facility, CAST(year(shipped) * 10 + quarter(shipped) AS INT) AS year_quarter, sum(tons) AS qty FROM manifests JOIN lines USING (mtn)
  WHERE facility IS NOT NULL GROUP BY ALL),
series AS (SELECT facility, year_quarter, qty AS qty_tons, {_LAGS}, lead(qty, 1) OVER w AS next_qty_tons
  FROM sums WINDOW w AS (PARTITION BY facility ORDER BY year_quarter))"""

_CLASS = "CASE target_class WHEN 'decrease' THEN 0 WHEN 'increase' THEN 2 ELSE 1 END"
_FIRST = ("year_quarter", "waste_line_row_count", "manifest_count", "generator_count", "qty_tons", "avg_line_qty_tons", "std_line_qty_tons", *_LAG_NAMES.split(", "), "lag_qty_sum", "qty_vs_lag_avg_ratio")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _FIRST)
_RULE = f"""matrix AS (SELECT {_CLASS} AS label, CASE WHEN r < 0.8 THEN 2 WHEN r > 1.2 THEN 0 ELSE 1 END AS prediction, count(*) AS n
  FROM (SELECT *, qty_tons / nullif(lag_qty_sum / 4, 0) AS r FROM simple) WHERE {_COMPLETE} GROUP BY ALL),
metrics AS (SELECT label, support, coalesce(hit / nullif(CAST(guessed AS DOUBLE), 0), 0) AS precision,
  coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS recall
  FROM (SELECT label, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit FROM matrix GROUP BY label) LEFT
    JOIN (SELECT prediction AS label, sum(n) AS guessed FROM matrix GROUP BY prediction) USING (label))"""


def _hot(column: str, name: str, levels: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {name}_{v}" for v in levels[1:])


_SIMPLE_CATEGORIES = {"waste_code": CATEGORIES["waste_code"], "mode_form_code": CATEGORIES["form_code"], "mode_source_code": CATEGORIES["source_code"]}
_HOTS = ", ".join(_hot(c, c, v) for c, v in _SIMPLE_CATEGORIES.items())
_FEATURES = (*_FIRST, *[f"{c}_{v}" for c, values in _SIMPLE_CATEGORIES.items() for v in values[1:]])
#: Multinomial naive Bayes in closed form, with one added to each count, and its figures on the test part.
_BAYES = f"""feat AS (
  SELECT uid, label, [{", ".join(f"greatest(CAST({c} AS DOUBLE), 0)" for c in _FEATURES)}] AS x
  FROM (SELECT uid, {", ".join(_FIRST)}, {_CLASS} AS label, {_HOTS} FROM simple WHERE {_COMPLETE})),
long AS (SELECT uid, label, unnest(range({len(_FEATURES)})) AS i, unnest(x) AS v FROM feat),
theta AS (
  SELECT label AS guess, i, ln(s + 1.0) - ln(sum(s) OVER (PARTITION BY label) + {len(_FEATURES)}.0) AS t
  FROM (SELECT label, i, sum(v) AS s FROM long WHERE uid % 100 < 70 GROUP BY label, i)),
prior AS (
  SELECT label AS guess, ln(count(*) + 1.0) - ln((SELECT count(*) FROM feat WHERE uid % 100 < 70) + 3.0) AS p
  FROM feat WHERE uid % 100 < 70 GROUP BY label),
scored AS (
  SELECT uid, label, guess, p + sum(v * t) AS score FROM long JOIN theta USING (i) JOIN prior USING (guess)
  WHERE uid % 100 >= 85 GROUP BY uid, label, guess, p),
matrix AS (SELECT label, prediction, count(*) AS n FROM (SELECT uid, label, arg_max(guess, score) AS prediction FROM scored GROUP BY uid, label)
  GROUP BY ALL),
metrics AS (
  SELECT label, coalesce(support, 0) AS support, coalesce(hit / nullif(CAST(guessed AS DOUBLE), 0), 0) AS precision,
    coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS recall
  FROM (SELECT label, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit FROM matrix GROUP BY label)
  FULL JOIN (SELECT prediction AS label, sum(n) AS guessed FROM matrix GROUP BY prediction) USING (label))"""
#: Trained by pages, the prior is a class's share of the rows, as the counts alone give it.
_BAYES_PAGES = _BAYES.replace("ln(count(*) + 1.0)", "ln(count(*))").replace(" + 3.0) AS p", ") AS p")
_GRAPH_NUMBERS = ("uid", "year_quarter", "manifest_count", "waste_line_count", "total_waste_tons", "total_waste_kg", "unique_transporters_from_gf", *_GEN, *_TRN, *_BOTH, *_LAG_NAMES.split(", "), *[f"{c}_lag_1" for c in _MORE], *[f"{c}_qoq_delta" for c in _MORE], "lag_qty_sum", "qty_vs_lag_avg_ratio")


def _with(*parts: str) -> str:
    *tables, query = parts
    return f"WITH {', '.join((_TABLES, *tables))} {query}"


_UPSERT = """old AS (SELECT * FROM (SELECT 'GENERATOR' AS node_type, generator AS business_id, max(generator_name) AS business_name,
  max(generator_state) AS state_code FROM manifests GROUP BY generator
  UNION ALL SELECT 'FACILITY', facility, max(facility_name), max(facility_state) FROM manifests WHERE facility IS NOT NULL GROUP BY facility
  UNION ALL SELECT 'TRANSPORTER', transporter, max(transporter_name), NULL FROM carriers JOIN manifests USING (mtn) GROUP BY transporter)
    WHERE business_id NOT LIKE '%7')"""

_ALL_STAGED = (_TOPS, _STAGED)
_METRICS = """SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM metrics"""
ORACLES = {
    "simple_train_view": _with(_SIMPLE, "SELECT * FROM simple"),
    "simple_base_lines": _with(_BASE, "SELECT * FROM base_lines"),
    "top_waste_codes": _with(_BASE, "SELECT waste_code, sum(tons) AS tons FROM base_lines GROUP BY waste_code ORDER BY tons DESC, waste_code LIMIT 3"),
    "top_wasteline_numbers_semi": _with(_TOPS, "SELECT * FROM top_line"),
    "top_facilities": _with(_TOPS, "SELECT * FROM top_facility"),
    "top_generators": _with(_TOPS, "SELECT * FROM top_generator"),
    "top_transporters": _with(_TOPS, "SELECT * FROM top_transporter"),
    "stageable_quarters": _with(*_ALL_STAGED, "SELECT year, quarter, year_quarter, count(DISTINCT mtn) AS manifest_count, count(*) AS waste_line_count FROM staged GROUP BY ALL"),
    "nodes_all": _with(_NODES, "SELECT * FROM nodes"),
    **{f"nodes_{k.lower()}": _with(_NODES, f"SELECT * FROM nodes WHERE node_type = '{k}'") for k in ("GENERATOR", "FACILITY", "TRANSPORTER")},
    "nodes_numbered": _with(_NODES, "SELECT row_number() OVER (ORDER BY node_type, business_id) AS graph_node_id, node_type, business_id FROM nodes"),
    **{f"edges_{k.lower()}_year": _with(_PER, _year_sql(k)) for k in ("GF", "GT", "TF")},
    "node_count_by_type": _with(_NODES, "SELECT node_type, count(*) AS nodes FROM nodes GROUP BY node_type"),
    "edge_summary_by_year": _with(_PER, " UNION ALL ".join(f"""SELECT year, '{k}' AS kind, count(*) AS edges, CAST(sum(manifest_count) AS BIGINT) AS manifests FROM ({_year_sql(k)}) GROUP BY year""" for k in ("GF", "GT", "TF"))),
    "top_pairs": _with(_PER, f"SELECT e.year, g.generator_name, f.facility_name, manifest_count, total_waste_tons FROM (SELECT * FROM ({_year_sql('GF')}) ORDER BY manifest_count DESC, total_waste_tons DESC, year, generator, facility LIMIT 25) e JOIN (SELECT generator, max(generator_name) AS generator_name FROM dated GROUP BY 1) g USING (generator) JOIN (SELECT facility, max(facility_name) AS facility_name FROM dated GROUP BY 1) f USING (facility)"),
    "stage_waste_lines": _with(*_ALL_STAGED, "SELECT * FROM staged"),
    "stage_manifest_transporter": _with(*_ALL_STAGED, "SELECT * FROM staged_carriers"),
    "waste_streams": _with(*_ALL_STAGED, _STREAMS, "SELECT * FROM streams"),
    **{f"edges_{k.lower()}_qtr": _with(*_ALL_STAGED, _quarter_sql(k)) for k in ("GF", "GT", "TF")},
    "quarter_edge_counts": _with(*_ALL_STAGED, "SELECT " + ", ".join(f"""(SELECT count(*) FROM ({_quarter_sql(k)}) WHERE year_quarter = 199703) AS {k.lower()}_edges""" for k in ("GF", "GT", "TF"))),
    "graph_train_view": _with(*_ALL_STAGED, _GRAPH, "SELECT * FROM graph_view"),
    "lag_lead_features": _with(_SERIES, "SELECT * FROM series"),
    "lag_ratio": _with(_SERIES, f"SELECT facility, year_quarter, {_LAG_SUM} AS lag_qty_sum, round(qty_tons / nullif(({_LAG_SUM}) / 4, 0), 6) AS ratio FROM series"),
    "label_classes": _with(_SERIES, "SELECT CASE WHEN next_qty_tons IS NULL THEN NULL WHEN (next_qty_tons - qty_tons) / qty_tons >= 0.05 THEN 'increase' WHEN (next_qty_tons - qty_tons) / qty_tons <= -0.05 THEN 'decrease' ELSE 'same' END AS target_class, count(*) AS n FROM series GROUP BY 1"),
    "upsert_nodes": _with(_NODES, _UPSERT, "SELECT coalesce(o.node_type, n.node_type) AS node_type, coalesce(o.business_id, n.business_id) AS business_id, coalesce(upper(n.business_name), o.business_name) AS business_name, CASE WHEN o.node_type IS NULL THEN '??' ELSE o.state_code END AS state_code FROM old o FULL JOIN nodes n ON o.node_type = n.node_type AND o.business_id = n.business_id"),
    "key_checks": _with(_PER, _NODES, f"gf AS ({_year_sql('GF')})", """
  SELECT 'duplicate_nodes' AS "check", count(*) AS bad FROM (SELECT 1 FROM nodes GROUP BY node_type, business_id HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_edges', count(*) FROM (SELECT 1 FROM gf GROUP BY year, generator, facility HAVING count(*) > 1)
  UNION ALL SELECT 'orphan_generators', count(*) FROM gf WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node_type = 'GENERATOR'
    AND business_id = generator)"""),
    "split_counts": _with(_SIMPLE, "SELECT CASE WHEN uid % 100 < 70 THEN 'train' WHEN uid % 100 < 85 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, min(uid) AS first_uid FROM simple GROUP BY 1"),
    "page_by_uid": _with(_SIMPLE, "SELECT uid, facility, waste_code, year_quarter FROM simple ORDER BY uid LIMIT 100 OFFSET 200"),
    "category_levels": _with(
        "SELECT DISTINCT 'waste_code' AS category, code AS level FROM federal UNION ALL "
        + " UNION ALL ".join(f"SELECT DISTINCT '{c}', {c} FROM lines" for c in ("management_code", "form_code", "source_code"))
    ),
    "edges_with_node_ids": _with(_PER, _NODES, f"gf AS ({_year_sql('GF')})", """numbered AS (
  SELECT row_number() OVER (ORDER BY node_type, business_id) AS id, node_type, business_id FROM nodes)""", """SELECT year, g.id AS generator_node_id, f.id AS facility_node_id, manifest_count FROM gf
  JOIN numbered g ON g.node_type = 'GENERATOR' AND g.business_id = generator JOIN numbered f ON f.node_type = 'FACILITY' AND f.business_id = facility"""),
    "model_bayes": _with(_SIMPLE, _BAYES, _METRICS),
    "model_bayes_pages": _with(_SIMPLE, _BAYES_PAGES, _METRICS),
    "one_hot_simple": _with(_SIMPLE, f"SELECT uid, {_hot('mode_form_code', 'form', CATEGORIES['form_code'])} FROM simple"),
    "transform_simple": _with(_SIMPLE, f"SELECT uid, {', '.join(_FIRST)}, {_CLASS} AS label, {_HOTS} FROM simple WHERE {_COMPLETE}"),
    "transform_graph": _with(*_ALL_STAGED, _GRAPH, f"SELECT {', '.join(f'coalesce({c}, 0) AS {c}' if 'delta' in c else c for c in _GRAPH_NUMBERS)}, {_CLASS} AS label, {', '.join(_hot(c, c, CATEGORIES[c]) for c in ('management_code', 'form_code', 'source_code'))} FROM graph_view WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _GRAPH_NUMBERS if 'lag' in c)}"),
    "confusion_matrix": _with(_SIMPLE, _RULE, "SELECT * FROM matrix"),
    "class_metrics": _with(_SIMPLE, _RULE, _METRICS),
    "overall_metrics": _with(_SIMPLE, _RULE, "SELECT round((SELECT sum(n) FROM matrix WHERE label = prediction) / (SELECT CAST(sum(n) AS DOUBLE) FROM matrix), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy FROM metrics"),
}

ORACLES["page_of_train"] = _with(_SIMPLE, "SELECT uid, facility, waste_code, year_quarter FROM simple WHERE uid % 100 < 70 ORDER BY uid LIMIT 100 OFFSET 200")
ORACLES["model_bayes_sparse"] = ORACLES["model_bayes"]
ORACLES["sparse_entries"] = _with(_SIMPLE, f"""feat AS (SELECT uid, [{", ".join(f"CAST({c} AS DOUBLE)" for c in _FEATURES)}] AS x
  FROM (SELECT uid, {", ".join(_FIRST)}, {_HOTS} FROM simple WHERE {_COMPLETE}))""", f"""SELECT uid, CAST(i AS INT) AS "index", round(v, 6) AS "value"
FROM (SELECT uid, unnest(range({len(_FEATURES)})) AS i, unnest(x) AS v FROM feat) WHERE v <> 0""")

#: Queries over built tables give the rows of those that compute all at once.
ORACLES |= {
    "upsert_nodes_into_buckets": ORACLES["upsert_nodes"],
    "edges_gf_built": ORACLES["edges_gf_qtr"],
    "edges_gf_streamed": _with(*_ALL_STAGED, f"""SELECT * FROM ({_quarter_sql("GF")}) WHERE year_quarter NOT IN (
  SELECT DISTINCT year_quarter FROM staged ORDER BY year_quarter DESC LIMIT 2)"""),
    "quarter_states": _with(*_ALL_STAGED, "SELECT DISTINCT year_quarter, 'SUCCESS' AS stage, 'SUCCESS' AS load FROM staged"),
}
ORACLES["table_rows"] = " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n_rows FROM {t}""" for t in TABLES)


def _checked(c: Key | Reference, table: dict[str, str]) -> str:
    """One constraint's rows and faults; `table` has the names that tables go by here."""
    names = [p for p in c.columns if isinstance(p, str)]
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    if isinstance(c, Reference):
        same = " AND ".join(f"p.{q} = {repr(p[0]) if isinstance(p, tuple) else 't.' + p}" for p, q in zip(c.columns, c.parent_columns))
        bad = f"count(*) FILTER ({whole} AND NOT EXISTS (SELECT 1 FROM {table[c.parent]} p WHERE {same}))"
        return f"""SELECT '{c.name}' AS "constraint", 'reference' AS kind, count(*) AS rows, {bad} AS bad FROM {table[c.table]} t"""
    nulls = f" + count(*) FILTER (NOT ({whole}))" if c.primary else ""
    more = f"CAST(coalesce((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {table[c.table]} WHERE {whole} GROUP BY {', '.join(names)})), 0) AS BIGINT)"
    return f"""SELECT '{c.name}' AS "constraint", '{"primary" if c.primary else "unique"}' AS kind, count(*) AS rows, {more}{nulls} AS bad FROM {table[c.table]}"""


_TABLES_OF = {"nodes": "nodes_numbered", "streams": "streams", "top_line_no": "top_line", **{f"top_{c}": f"top_{c}" for c in ("facility", "generator", "transporter")}}
_TABLES_OF |= {f"{t}_{k}": f"{t}_{k}" for t in ("years", "quarters") for k in ("gf", "gt", "tf")}
ORACLES["constraint_checks"] = _with(
    _PER, _NODES, *_ALL_STAGED, _STREAMS, "nodes_numbered AS (SELECT row_number() OVER (ORDER BY node_type, business_id) AS graph_node_id, * FROM nodes)",
    *[f"{t}_{k.lower()} AS MATERIALIZED ({sql(k)})" for t, sql in (("years", _year_sql), ("quarters", _quarter_sql)) for k in ("GF", "GT", "TF")],
    " UNION ALL ".join(_checked(c, _TABLES_OF) for c in graph_constraints()),
)
