"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..operators import access, filters, geo, inequality, linkage, network, quality, sampling, scenario, weights
from . import phases
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: T.rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def R(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


BAND = "CASE WHEN t_min <= 30 THEN '<=30' WHEN t_min <= 60 THEN '>30_<=60' WHEN t_min <= 120 THEN '>60_<=120' WHEN t_min > 120 THEN '>120' ELSE 'unroutable_or_not_estimated' END"
MEAN = f"""count(*) AS n_cp, count(weight) AS n_cp_with_weight, count(*) FILTER (WHERE t_min IS NOT NULL AND weight IS NOT NULL) AS n_cp_with_time, CAST(sum(weight) AS BIGINT) AS total_pop,
  CAST(coalesce(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0) AS BIGINT) AS pop_with_time, {R("sum(t_min * weight) / nullif(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0)")} AS weighted_mean,
  {R("100.0 * CAST(coalesce(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0) AS DOUBLE) / nullif(sum(weight), 0)")} AS share_with_time_pct"""


# --- access ------------------------------------------------------------------------------------------


@query("a1_weighted_mean", f"WITH {T.DEMAND} SELECT dep, prov, {MEAN} FROM demand GROUP BY dep, prov")
def _(spark, sf):
    return access.weighted_mean_access(T.demand(spark, sf), ["dep", "prov"])


@query("a1_weighted_mean_total", f"WITH {T.DEMAND} SELECT 'total' AS scope, {MEAN} FROM demand")
def _(spark, sf):
    return access.weighted_mean_access(T.demand(spark, sf))


@query("p7_p8_access_bands", f"WITH {T.DEMAND} SELECT demand_id, status, {R('t_min')} AS t_min, {BAND} AS band FROM demand")
def _(spark, sf):
    d = T.demand(spark, sf).withColumn("t_min", X.access_time("status", "t_raw"))
    return d.select("demand_id", "status", "t_min", X.band("t_min").alias("band"))


def _band_rows(bands, total):
    parts = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{n}' AS band, CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) AS population, {R(f'100.0 * CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) / nullif({total}, 0)')} AS pct FROM demand" for i,
        (n, c) in enumerate(bands)
    )
    return f"WITH {T.DEMAND} {parts}"


_A = list(zip(K.BANDS, ("t_min <= 30", "t_min > 30 AND t_min <= 60", "t_min > 60 AND t_min <= 120", "t_min > 120"), strict=True))
_CUM = list(zip(K.CUMULATIVE, ("t_min <= 30", "t_min <= 60", "t_min <= 120", "t_min > 120", "t_min IS NULL"), strict=True))


@query("a2_bands_a", _band_rows(_A, "sum(weight) FILTER (WHERE t_min IS NOT NULL)"))
def _(spark, sf):
    return access.bands_of_timed(T.demand(spark, sf))


@query("a2_bands_b", _band_rows([*_A, (K.NO_TIME, "t_min IS NULL")], "sum(weight)"))
def _(spark, sf):
    return access.bands_of_all(T.demand(spark, sf))


@query("a2_cumulative", _band_rows(_CUM, "sum(weight)"))
def _(spark, sf):
    return access.bands_cumulative(T.demand(spark, sf))


_WIDE = ", ".join(
    f'CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) AS "pop_{n}", ' + R(
        f"100.0 * CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) / nullif(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0)"
    ) + f' AS "pct_{n}"' for n,
    c in _A
)


@query("a3_bands_wide", f"WITH {T.DEMAND} SELECT dep, dist, {_WIDE} FROM demand GROUP BY dep, dist")
def _(spark, sf):
    return access.bands_wide(T.demand(spark, sf), ["dep", "dist"])


_CUM_COLS = ", ".join(
    R(f"100.0 * CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) / nullif(sum(weight), 0)") + f" AS {n}" for n,
    (_, c) in zip(("pct_le_30", "pct_le_60", "pct_le_120", "pct_gt_120", "pct_no_time"), _CUM, strict=True)
)


@query("a4_district_metrics", f"WITH {T.DEMAND} SELECT dep, prov, dist, {MEAN}, {_CUM_COLS} FROM demand GROUP BY dep, prov, dist")
def _(spark, sf):
    return access.district_metrics(T.demand(spark, sf), ["dep", "prov", "dist"])


_STATUS = f"count(*) AS n, CAST(sum(weight) AS BIGINT) AS population, {R('100.0 * CAST(sum(weight) AS DOUBLE) / (SELECT sum(weight) FROM demand)')} AS "


@query(
    "a5_completeness",
    f"WITH {T.DEMAND} SELECT status, {_STATUS} pct_population, {R('100.0 * count(*) / (SELECT count(*) FROM demand)')} AS pct_n FROM demand GROUP BY status"
)
def _(spark, sf):
    return access.completeness(T.demand(spark, sf), "status")


@query("a6_unroutable", f"WITH {T.DEMAND} SELECT dep, status, {_STATUS} pct_of_total FROM demand GROUP BY dep, status")
def _(spark, sf):
    return access.unroutable_concentration(T.demand(spark, sf), ["dep"], "status")


_UR_BANDS = ", ".join(
    R(
        f"100.0 * CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS DOUBLE) / nullif(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0)"
    ) + f' AS "pct_{n}"' for n,
    c in _A
)
_W_TIMED = "nullif(sum(weight) FILTER (WHERE t_min IS NOT NULL), 0)"


@query(
    "a12_urban_rural",
    f"""WITH {T.DEMAND} SELECT urban_rural, count(*) AS n_cp, count(*) FILTER (WHERE t_min IS NOT NULL AND weight IS NOT NULL) AS n_cp_with_time, {R(f"sum(t_min * weight) / {_W_TIMED}")} AS weighted_mean, {_UR_BANDS},
    {R("100.0 * count(*) FILTER (WHERE t_min IS NULL) / count(*)")} AS pct_without_route, {R(f"100.0 * CAST(sum(weight) FILTER (WHERE t_min <= 60) AS DOUBLE) / {_W_TIMED}")} AS cum_pct_le_60, {R(f"100.0 * CAST(sum(weight) FILTER (WHERE t_min <= 120) AS DOUBLE) / {_W_TIMED}")} AS cum_pct_le_120
    FROM demand GROUP BY urban_rural""",
)
def _(spark, sf):
    return access.urban_rural_summary(T.demand(spark, sf))


@query(
    "a14_urban_rural_coverage",
    f"WITH {T.DEMAND} SELECT CAST(sum(weight) FILTER (WHERE urban_rural = 'urban') AS BIGINT) AS urban, CAST(sum(weight) FILTER (WHERE urban_rural = 'rural') AS BIGINT) AS rural, CAST(sum(weight) FILTER (WHERE urban_rural = 'unknown') AS BIGINT) AS unknown, {R('100.0 * CAST(sum(weight) FILTER (WHERE urban_rural <> $$unknown$$) AS DOUBLE) / sum(weight)')} AS pct_classified FROM demand"
)
def _(spark, sf):
    return access.urban_rural_coverage(T.demand(spark, sf))


_M = lambda w: f"CAST(sum(t_min * {w}) AS DOUBLE) / CAST(sum({w}) FILTER (WHERE t_min IS NOT NULL) AS DOUBLE)"


@query(
    "a15_compare_weights",
    f"WITH {T.DEMAND} SELECT CASE WHEN grouping(dep) = 1 THEN 'TOTAL' ELSE dep END AS scope, {R(_M('design_weight'))} AS mean_ht, {R(_M('weight'))} AS mean_calibrated, {R(_M('weight') + ' - ' + _M('design_weight'))} AS difference FROM demand GROUP BY ROLLUP (dep)"
)
def _(spark, sf):
    return access.compare_weights(T.demand(spark, sf), "dep", "design_weight", "weight")


@query(
    "a16_summary",
    f"WITH {T.DEMAND} SELECT count(*) AS n_demand, count(weight) AS n_matched, {R('100.0 * count(weight) / count(*)')} AS pct_matched, CAST(sum(weight) AS BIGINT) AS population, {R(_M('weight'))} AS weighted_mean, {R('100.0 * CAST(sum(weight) FILTER (WHERE t_min IS NOT NULL) AS DOUBLE) / sum(weight)')} AS pct_with_time FROM demand"
)
def _(spark, sf):
    d = T.demand(spark, sf).withColumn("match_status", F.when(F.col("weight").isNotNull(), K.MATCHED).otherwise(K.UNMATCHED))
    return access.summary(d)


_S = lambda c: f"CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS BIGINT)"


@query(
    "a27_kpis",
    f"WITH {T.DEMAND} SELECT CAST(sum(weight) AS BIGINT) AS population_frame, {_S('t_min <= 60')} AS population_le, {R('100.0 * ' + _S('t_min <= 60') + ' / sum(weight)')} AS pct_le, {_S('t_min > 60')} AS population_gt, {_S('t_min IS NULL')} AS population_no_time, {R('100.0 * ' + _S('t_min IS NULL') + ' / sum(weight)')} AS pct_no_time, {R(_M('weight'))} AS weighted_mean FROM demand"
)
def _(spark, sf):
    return access.kpis(T.demand(spark, sf), weight="weight")


@query(
    "k1_topk",
    f"WITH {T.DEMAND} SELECT demand_id, dep, {R('t_min')} AS t_min FROM demand WHERE t_min IS NOT NULL ORDER BY demand.t_min DESC, demand_id LIMIT 20"
)
def _(spark, sf):
    return access.top_extreme(T.demand(spark, sf), "demand_id").select("demand_id", "dep", "t_min")


# --- linkage and weights ---------------------------------------------------------------------------------

_COUNTED = "counted AS (SELECT code, count(*) AS n, min(pop) AS pop FROM population GROUP BY code)"
_LINKED = f"""WITH {T.DEMAND}, {T.POPULATION}, {_COUNTED}, keyed AS (SELECT *, CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(c AS VARCHAR) END AS code, CAST(c + 1 AS VARCHAR) AS code2 FROM demand),
linked AS (SELECT keyed.*, coalesce(p.n, 0) AS n_population_records, CASE WHEN keyed.code IS NULL THEN 'no_key' ELSE 'primary_key' END AS match_method, CASE WHEN p.n = 1 THEN 'matched' WHEN p.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
  CASE WHEN p.n = 1 THEN p.pop END AS population, coalesce(code2 <> keyed.code AND s.code IS NOT NULL, false) AS secondary_key_disagrees FROM keyed LEFT JOIN counted p ON p.code = keyed.code LEFT JOIN counted s ON s.code = keyed.code2)"""


def _keyed(spark, sf):
    return T.demand(spark, sf).withColumn(
        "code", F.when(F.col("k") % 31 != 0, F.col("c").cast("string"))
    ).withColumn("code2", (F.col("c") + 1).cast("string"))


def _linked(spark, sf):
    return linkage.match_report(_keyed(spark, sf), T.population(spark, sf), "code", "code", "pop", "code2")


@query(
    "j1_match_report",
    f"{_LINKED} SELECT demand_id, n_population_records, match_method, match_status, population, secondary_key_disagrees FROM linked"
)
def _(spark, sf):
    return _linked(spark, sf).select("demand_id", "n_population_records", "match_method", "match_status", "population", "secondary_key_disagrees")


@query(
    "j11_weights",
    f"{_LINKED} SELECT demand_id, CASE WHEN match_status = 'matched' THEN population * design_weight END AS analysis_weight FROM linked"
)
def _(spark, sf):
    return _linked(spark, sf).select("demand_id", weights.analysis_weight().alias("analysis_weight"))


@query("j10_demand_analysis", f"""{_LINKED}, routing AS (SELECT demand_id, prov AS dist, status AS routing_status_car, t_raw AS travel_time_min_car FROM demand WHERE k % 13 <> 0),
areas AS (SELECT demand_id, nullif(urban_rural, 'unknown') AS urban_rural FROM demand WHERE k % 5 <> 0),
weighted AS (SELECT demand_id, population, match_status, CASE WHEN match_status = 'matched' THEN population * design_weight END AS analysis_weight FROM linked)
SELECT d.demand_id, d.dist, r.dist AS dist_routing, r.routing_status_car, {R("r.travel_time_min_car")} AS travel_time_min_car, w.population, w.match_status AS population_match_status, w.analysis_weight,
  coalesce(a.urban_rural, 'unknown') AS urban_rural, {R("CASE WHEN r.routing_status_car = 'routed' THEN r.travel_time_min_car END")} AS t_min, w.analysis_weight AS ht_population_weight
FROM demand d LEFT JOIN routing r ON r.demand_id = d.demand_id LEFT JOIN weighted w ON w.demand_id = d.demand_id LEFT JOIN areas a ON a.demand_id = d.demand_id""")
def _(spark, sf):
    d = T.demand(spark, sf)
    routing = d.where("k % 13 <> 0").select(
        "demand_id", F.col("prov").alias("dist"), F.col("status").alias("routing_status_car"),
        F.col("t_raw").alias("travel_time_min_car")
    )
    areas = d.where("k % 5 <> 0").select("demand_id", F.nullif("urban_rural", F.lit(K.UNKNOWN)).alias("urban_rural"))
    linked = _linked(spark, sf).select(
        "demand_id", "population", F.col("match_status").alias("population_match_status"),
        weights.analysis_weight().alias("analysis_weight")
    )
    out = linkage.demand_analysis(d.select("demand_id", "dist"), routing, linked, areas)
    return out.select(
        "demand_id", "dist", "dist_routing", "routing_status_car", "travel_time_min_car", "population",
        "population_match_status", "analysis_weight", "urban_rural", "t_min", "ht_population_weight"
    )


@query("a7_match_summary_rollup", f"""{_LINKED} SELECT CASE WHEN grouping(dep) = 1 THEN 'TOTAL' ELSE dep END AS scope, count(*) AS n, count(*) FILTER (WHERE match_status = 'matched') AS n_matched, count(*) FILTER (WHERE match_status = 'unmatched') AS n_unmatched, count(*) FILTER (WHERE match_status = 'ambiguous') AS n_ambiguous,
  {R("100.0 * count(*) FILTER (WHERE match_status = 'matched') / count(*)")} AS pct_matched, CAST(sum(population) AS BIGINT) AS population_matched FROM linked GROUP BY ROLLUP (dep)""")
def _(spark, sf):
    return weights.match_summary(_linked(spark, sf), "dep")


@query(
    "j21_unmatched_kinds",
    f"{_LINKED} SELECT CASE WHEN code IS NULL THEN 'A' WHEN code2 IN (SELECT code FROM population) THEN 'C' ELSE 'B' END AS unmatched_kind, count(*) AS n FROM linked WHERE match_status = 'unmatched' GROUP BY 1"
)
def _(spark, sf):
    return linkage.unmatched_kinds(
        _linked(spark, sf), "code", "code2", T.population(spark, sf), "code"
    ).groupBy("unmatched_kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j3_representative",
    "SELECT o_orderkey, (o_custkey % 5 = 0) OR count(*) OVER (PARTITION BY CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END) = 1 AS is_representative FROM orders"
)
def _(spark, sf):
    o = T.read(spark, sf, "orders").withColumn("code", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return linkage.flag_representative(o, "code", "o_orderkey").select("o_orderkey", "is_representative")


@query(
    "j5_universe",
    f"WITH {T.POPULATION} SELECT c_custkey, 1::BIGINT AS n_rows_for_key, (SELECT min(pop) FROM population WHERE code = CAST(c_custkey AS VARCHAR)) AS population FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT code FROM population)"
)
def _(spark, sf):
    c = linkage.flag_representative(T.read(spark, sf, "customer").withColumn("key", F.col("c_custkey").cast("string")), "key", "c_custkey")
    return linkage.population_universe(c, T.population(spark, sf), "key", "code", "pop").select("c_custkey", "n_rows_for_key", "population")


@query("j6_duplicate_resolution", f"""WITH {T.FACILITIES}, dup AS (SELECT *, count(*) OVER (PARTITION BY k // 2) AS n FROM facilities)
SELECT k // 2 AS pair, n AS n_rows, string_agg(facility_id, ',' ORDER BY facility_id) AS ids, {R("2 * 6371000e0 * asin(sqrt(least(greatest(pow(sin((radians(max(lat) FILTER (WHERE k % 2 = 1)) - radians(max(lat) FILTER (WHERE k % 2 = 0))) / 2), 2) + cos(radians(max(lat) FILTER (WHERE k % 2 = 0))) * cos(radians(max(lat) FILTER (WHERE k % 2 = 1))) * pow(sin(radians(max(lon) FILTER (WHERE k % 2 = 1) - max(lon) FILTER (WHERE k % 2 = 0)) / 2), 2), 0e0), 1e0)))", 3)} AS distance_m
FROM dup WHERE n > 1 GROUP BY k // 2, n""")
def _(spark, sf):
    f = T.facilities(spark, sf).withColumn("pair", F.floor(F.col("k") / 2).cast("long"))
    return T.rounded(linkage.duplicate_resolution(f, "pair", "facility_id", "lon", "lat"), 3)


_CROSS = f"WITH {T.POPULATION}, a AS (SELECT code, min(pop) AS value_a FROM population GROUP BY code), b AS (SELECT CAST(c_custkey AS VARCHAR) AS code, 100 + c_custkey % 900 + CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 50 ELSE 0 END AS value_b FROM customer), x AS (SELECT a.code, value_a, value_b, abs(value_b - value_a) AS diff_abs, 100.0 * (value_b - value_a) / nullif(value_a, 0) AS diff_pct FROM a JOIN b USING (code))"


def _cross(spark, sf):
    a = T.population(spark, sf).groupBy("code").agg(F.min("pop").alias("pop"))
    key = F.col("c_custkey")
    b = T.read(spark, sf, "customer").select(
        key.cast("string").alias("code"), (100 + key % 900 + F.when(key % 9 == 0, key % 50).otherwise(0)).alias("pop")
    )
    return linkage.cross_validate(a, b, "code", "pop", "pop")


@query(
    "j7_cross_validate",
    f"{_CROSS} SELECT count(*) AS n_common, count(*) FILTER (WHERE diff_abs = 0) AS n_identical, count(*) FILTER (WHERE diff_abs <> 0) AS n_discrepant, max(diff_abs) AS max_diff, {R('quantile_cont(diff_abs, 0.5)')} AS median_diff, {R('stddev_samp(diff_abs)')} AS std_diff FROM x"
)
def _(spark, sf):
    return linkage.cross_validation_summary(_cross(spark, sf))


@query(
    "k2_top_discrepant",
    f"{_CROSS} SELECT code, value_a, value_b, diff_abs, {R('diff_pct')} AS diff_pct FROM x ORDER BY diff_abs DESC, code LIMIT 10"
)
def _(spark, sf):
    return linkage.top_discrepant(_cross(spark, sf), "code")


@query(
    "j8_control",
    f"{_LINKED}, seen AS (SELECT dep, sum(population) AS observed FROM linked GROUP BY dep), bench AS (SELECT CASE WHEN r_name = 'ASIA' THEN 'ELSEWHERE' ELSE r_name END AS dep, 1000000 * (1 + r_regionkey) AS benchmark FROM region) SELECT coalesce(seen.dep, bench.dep) AS dep, CAST(observed AS BIGINT) AS observed, CAST(benchmark AS BIGINT) AS benchmark, {R('100.0 * CAST(observed AS DOUBLE) / benchmark')} AS captured_pct FROM seen FULL JOIN bench USING (dep)"
)
def _(spark, sf):
    r = T.read(spark, sf, "region")
    bench = r.select(
        F.when(F.col("r_name") == "ASIA", "ELSEWHERE").otherwise(F.col("r_name")).alias("dep"),
        (F.lit(1000000) * (1 + F.col("r_regionkey"))).cast("long").alias("benchmark")
    )
    return linkage.population_control(_linked(spark, sf), bench, "dep", "population", "benchmark")


@query(
    "p16_urban_rural",
    "SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR o_custkey % 5 = 0 THEN 'unknown' WHEN c_nationkey % 3 = 1 THEN 'urban' WHEN c_nationkey % 3 = 2 THEN 'rural' ELSE 'unknown' END AS urban_rural FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def _(spark, sf):
    c = T.read(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("code"), (F.col("c_nationkey") % 3).alias("area"))
    return linkage.urban_rural(T.read(spark, sf, "orders"), c.unionByName(c), "o_custkey", "code", "area").select("o_orderkey", "urban_rural")


_KNOWN = "known AS (SELECT dep, CASE WHEN dist = 'BUILDING' THEN 'NOWHERE' ELSE dist END AS dist, sum(design_weight) * 2 AS known_population FROM demand GROUP BY ALL), ht AS (SELECT dep, dist, sum(weight) AS ht FROM demand GROUP BY ALL), factors AS (SELECT coalesce(ht.dep, known.dep) AS dep, coalesce(ht.dist, known.dist) AS dist, coalesce(ht, 0) AS ht_total, known_population, CASE WHEN known_population > 0 AND coalesce(ht, 0) = 0 THEN 'impossible_no_sample' ELSE 'calibrated' END AS calibration_status FROM ht FULL JOIN known ON ht.dep = known.dep AND ht.dist = known.dist)"


def _factors(spark, sf):
    d = T.demand(spark, sf)
    known = d.groupBy(
        "dep", F.when(F.col("dist") == "BUILDING", "NOWHERE").otherwise(F.col("dist")).alias("dist")
    ).agg((F.sum("design_weight") * 2).alias("known"))
    return weights.calibration_factors(d, known, ["dep", "dist"], "weight", "known")


@query(
    "a9_calibration",
    f"WITH {T.DEMAND}, {_KNOWN} SELECT dep, dist, CAST(ht_total AS BIGINT) AS ht_total, CAST(known_population AS BIGINT) AS known_population, {R('CAST(known_population AS DOUBLE) / nullif(ht_total, 0)')} AS calibration_factor, calibration_status FROM factors"
)
def _(spark, sf):
    return _factors(spark, sf)


@query(
    "a9_calibrated_weights",
    f"WITH {T.DEMAND}, {_KNOWN} SELECT demand_id, {R('weight * (CAST(known_population AS DOUBLE) / nullif(ht_total, 0))')} AS calibrated_weight FROM demand LEFT JOIN factors USING (dep, dist)"
)
def _(spark, sf):
    return weights.calibrated(T.demand(spark, sf), _factors(spark, sf), ["dep", "dist"], "weight").select("demand_id", "calibrated_weight")


@query(
    "a28_quality_panels",
    f"WITH {T.DEMAND}, {_KNOWN} SELECT count(*) FILTER (WHERE calibration_status = 'impossible_no_sample') AS n_impossible, CAST(coalesce(sum(known_population) FILTER (WHERE calibration_status = 'impossible_no_sample'), 0) AS BIGINT) AS population_impossible, count(*) FILTER (WHERE CAST(known_population AS DOUBLE) / nullif(ht_total, 0) < 0.5) AS n_extreme_low, count(*) FILTER (WHERE CAST(known_population AS DOUBLE) / nullif(ht_total, 0) > 2.0) AS n_extreme_high FROM factors"
)
def _(spark, sf):
    f = _factors(spark, sf)
    return filters.population_quality_panel(f).crossJoin(filters.statistical_quality_panel(f))


_ESS = lambda w: f"pow(CAST(sum({w}) AS DOUBLE), 2) / CAST(sum({w} * {w}) AS DOUBLE)"


@query(
    "a10_a11_ess",
    f"WITH {T.DEMAND} SELECT CASE WHEN grouping(dep) = 1 THEN 'TOTAL' ELSE dep END AS scope, {R(_ESS('design_weight'))} AS n_eff_design_weight, {R(_ESS('weight'))} AS n_eff_weight FROM demand GROUP BY ROLLUP (dep)"
)
def _(spark, sf):
    return weights.effective_sizes(T.demand(spark, sf), "dep", ["design_weight", "weight"])


@query(
    "a8_representativeness",
    f"WITH {T.DEMAND} SELECT CASE WHEN grouping(dep) = 1 THEN 'TOTAL' ELSE dep END AS scope, count(*) AS n, count(weight) AS n_with_weight, CAST(sum(weight) AS BIGINT) AS total_weight, CASE WHEN grouping(dep) = 0 THEN {R('100.0 * CAST(sum(weight) AS DOUBLE) / (SELECT sum(weight) FROM demand)')} END AS pct_of_total FROM demand GROUP BY ROLLUP (dep)"
)
def _(spark, sf):
    return weights.representativeness(T.demand(spark, sf), "dep", "weight")


@query(
    "a25_compare_totals",
    f"WITH {T.DEMAND}, a AS (SELECT dep, prov, sum(weight) AS a FROM demand GROUP BY ALL), b AS (SELECT dep, prov, sum(design_weight) AS b FROM demand GROUP BY ALL) SELECT dep, prov, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, {R('CAST(a AS DOUBLE) / b')} AS ratio, {R('100.0 * CAST(a - b AS DOUBLE) / b')} AS diff_pct FROM a FULL JOIN b USING (dep, prov)"
)
def _(spark, sf):
    d = T.demand(spark, sf)
    return weights.compare_totals(d, d, ["dep", "prov"], "weight", "design_weight")


# --- sampling ----------------------------------------------------------------------------------------------

_QUOTA = """strata AS (SELECT prov, count(*) AS stratum_n FROM demand GROUP BY prov), total AS (SELECT sum(stratum_n) AS t FROM strata),
q AS (SELECT prov, stratum_n, CASE WHEN t <= {n} THEN stratum_n ELSE (stratum_n * {n}) // t END AS f, CASE WHEN t <= {n} THEN 0 ELSE (stratum_n * {n}) % t END AS r, t FROM strata, total),
quotas AS (SELECT prov, stratum_n, CAST(f + CASE WHEN t > {n} AND row_number() OVER (ORDER BY r DESC, prov) <= {n} - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


@query("sm1_quota", f"WITH {T.DEMAND}, {_QUOTA.format(n=777)} SELECT prov, stratum_n, quota FROM quotas")
def _(spark, sf):
    s = T.demand(spark, sf).groupBy("prov").agg(F.count(F.lit(1)).alias("stratum_n"))
    return sampling.quotas(s, "prov", "stratum_n", 777)


@query(
    "sm2_sample_sizes",
    f"WITH {T.DEMAND}, {_QUOTA.format(n=777)} SELECT prov, quota AS n, stratum_n, quota AS stratum_sample_n, {R('CAST(quota AS DOUBLE) / stratum_n')} AS inclusion_prob, {R('CAST(stratum_n AS DOUBLE) / quota')} AS design_weight FROM quotas WHERE quota > 0"
)
def _(spark, sf):
    s = sampling.stratified_sample(T.demand(spark, sf).drop("design_weight"), "prov", "demand_id", 777)
    return s.groupBy("prov").agg(
        F.count_distinct("demand_id").alias("n"), F.max("stratum_n").alias("stratum_n"),
        F.max("stratum_sample_n").alias("stratum_sample_n"), F.max("inclusion_prob").alias("inclusion_prob"),
        F.max("design_weight").alias("design_weight")
    )


_DRAWN = f"""{T.DEMAND}, {_QUOTA.format(n=777)}, drawn AS (SELECT demand_id, prov, stratum_n, quota, row_number() OVER (PARTITION BY prov ORDER BY CAST('0x' || substr(md5('42:' || demand_id), 1, 15) AS BIGINT), demand_id) AS nth FROM demand JOIN quotas USING (prov)),
sample AS (SELECT demand_id, prov, stratum_n, quota AS stratum_sample_n, CAST(quota AS DOUBLE) / stratum_n AS inclusion_prob, CAST(stratum_n AS DOUBLE) / quota AS design_weight FROM drawn WHERE nth <= quota)"""


@query(
    "sm2_sample",
    f"WITH {_DRAWN} SELECT demand_id, prov, stratum_n, stratum_sample_n, {R('inclusion_prob')} AS inclusion_prob, {R('design_weight')} AS design_weight FROM sample"
)
def _(spark, sf):
    s = sampling.stratified_sample(T.demand(spark, sf).drop("design_weight"), "prov", "demand_id", 777)
    return s.select("demand_id", "prov", "stratum_n", "stratum_sample_n", "inclusion_prob", "design_weight")


_P20 = "bool_and(abs(1 / inclusion_prob - w) <= 1e-8 + 1e-5 * abs(w)) AS consistent, (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT w) AS n FROM {t} GROUP BY prov)) AS one_weight_per_stratum, round(max(abs(1 / inclusion_prob - w)), 6) AS max_abs_diff FROM {t}"


@query(
    "p20_verify_weights",
    f"""WITH {_DRAWN}, own AS (SELECT *, design_weight AS w FROM sample), scaled AS (SELECT *, CASE WHEN prov = 'CHINA' THEN 1.5e0 ELSE 1e0 END * design_weight AS w FROM sample),
uneven AS (SELECT *, CASE WHEN demand_id LIKE '%7' THEN 1e0 ELSE 0e0 END + design_weight AS w FROM sample) SELECT 'own' AS which, {_P20.format(t="own")} UNION ALL SELECT 'scaled', {_P20.format(t="scaled")} UNION ALL SELECT 'uneven', {_P20.format(t="uneven")}""",
)
def _(spark, sf):
    s = sampling.stratified_sample(T.demand(spark, sf).drop("design_weight"), "prov", "demand_id", 777)
    w = F.col("design_weight")
    kinds = {
        "own": w, "scaled": F.when(F.col("prov") == "CHINA", 1.5).otherwise(1.0) * w,
        "uneven": F.when(F.col("demand_id").endswith("7"), 1.0).otherwise(0.0) + w
    }
    each = [
        weights.verify_design_weights(s.withColumn("design_weight", c), "prov").select(
            F.lit(k).alias("which"), "consistent", "one_weight_per_stratum", "max_abs_diff"
        ) for k,
        c in kinds.items()
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    "sm3_not_needed",
    f"WITH {T.DEMAND} SELECT prov, count(*) AS n, count(*) AS stratum_n, count(*) * count(*) AS sampled, 1e0 AS least_prob, CAST(count(*) AS DOUBLE) AS weights FROM demand GROUP BY prov"
)
def _(spark, sf):
    s = sampling.sample_if_needed(T.demand(spark, sf).drop("design_weight"), "prov", "demand_id", 10**12)
    return s.groupBy("prov").agg(
        F.count(F.lit(1)).alias("n"), F.max("stratum_n").alias("stratum_n"), F.sum("stratum_sample_n").alias("sampled"),
        F.min("inclusion_prob").alias("least_prob"), F.sum("design_weight").alias("weights")
    )


# --- inequality and ranks ----------------------------------------------------------------------------------------

_VALUES = "vals AS (SELECT t_min AS v, sum(weight) AS w FROM demand WHERE t_min IS NOT NULL AND weight > 0 GROUP BY t_min), run AS (SELECT v, w, sum(w) OVER (ORDER BY v) AS cw, sum(w * v) OVER (ORDER BY v) AS cwv FROM vals)"


@query("w1_weighted_median", f"WITH {T.DEMAND}, {_VALUES} SELECT {R('min(v)')} AS weighted_median FROM run WHERE cw * 2 >= (SELECT sum(w) FROM vals)")
def _(spark, sf):
    return inequality.weighted_median(T.demand(spark, sf), "t_min", "weight")


@query(
    "w1_weighted_median_by_dep",
    f"WITH {T.DEMAND}, g AS (SELECT dep, t_min AS v, sum(weight) AS w FROM demand WHERE t_min IS NOT NULL AND weight > 0 GROUP BY ALL), r AS (SELECT dep, v, sum(w) OVER (PARTITION BY dep ORDER BY v) AS cw, sum(w) OVER (PARTITION BY dep) AS t FROM g) SELECT dep, {R('min(v)')} AS weighted_median FROM r WHERE cw * 2 >= t GROUP BY dep"
)
def _(spark, sf):
    return inequality.weighted_median(T.demand(spark, sf), "t_min", "weight", ["dep"])


@query(
    "w2_gini",
    f"WITH {T.DEMAND}, {_VALUES} SELECT {R('1 - sum(CAST(w AS DOUBLE) * CAST(2 * cwv - w * v AS DOUBLE)) / (CAST(sum(w) AS DOUBLE) * CAST(sum(w * v) AS DOUBLE))')} AS gini, (SELECT count(*) FROM demand WHERE t_min IS NOT NULL AND weight > 0) AS n_included, CAST(sum(w) AS BIGINT) AS population_included, {R('100.0 - 100.0 * CAST(sum(w) AS DOUBLE) / (SELECT sum(weight) FROM demand)')} AS pct_population_excluded FROM run"
)
def _(spark, sf):
    return inequality.weighted_gini(T.demand(spark, sf), "t_min", "weight")


@query(
    "w3_lorenz",
    f"WITH {T.DEMAND}, {_VALUES} SELECT -1e0 AS ord, 0e0 AS cum_population, 0e0 AS cum_value UNION ALL SELECT {R('v')}, {R('CAST(cw AS DOUBLE) / CAST((SELECT sum(w) FROM vals) AS DOUBLE)')}, {R('CAST(cwv AS DOUBLE) / CAST((SELECT sum(w * v) FROM vals) AS DOUBLE)')} FROM run"
)
def _(spark, sf):
    return inequality.lorenz_curve(T.demand(spark, sf), "t_min", "weight")


@query(
    "w4_ecdf",
    f"WITH {T.DEMAND}, g AS (SELECT dep, t_min AS v, sum(weight) AS w FROM demand WHERE t_min IS NOT NULL AND weight > 0 GROUP BY ALL) SELECT dep, {R('v')} AS v, {R('100.0 * CAST(sum(w) OVER (PARTITION BY dep ORDER BY g.v) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY dep) AS DOUBLE)')} AS cum_pct FROM g"
)
def _(spark, sf):
    return inequality.weighted_ecdf(T.demand(spark, sf), "t_min", "weight", ["dep"])


@query(
    "w5_ecdf",
    f"SELECT value AS v, {R('CAST(row_number() OVER (ORDER BY value) AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE)')} AS share FROM events WHERE value IS NOT NULL"
)
def _(spark, sf):
    return inequality.ecdf(T.read(spark, sf, "events"), "value")


_DIST = f"WITH {T.DEMAND}, d AS (SELECT dep, prov, dist, {MEAN} FROM (SELECT * REPLACE (CASE WHEN dist = 'FURNITURE' AND k % 2 = 0 THEN NULL ELSE t_min END AS t_min) FROM demand) GROUP BY dep, prov, dist)"


def _districts(spark, sf):
    d = T.demand(spark, sf).withColumn("t_min", F.when((F.col("dist") == "FURNITURE") & (F.col("k") % 2 == 0), F.lit(None)).otherwise(F.col("t_min")))
    return T.rounded(access.weighted_mean_access(d, ["dep", "prov", "dist"]))


@query(
    "w6_rank_gaps",
    f"{_DIST} SELECT dep, prov, dist, weighted_mean, CAST(row_number() OVER (ORDER BY weighted_mean DESC NULLS FIRST, dep, prov, dist) AS INTEGER) AS rank, share_with_time_pct IS NULL OR share_with_time_pct < 50 AS low_coverage_warning FROM d"
)
def _(spark, sf):
    return inequality.rank_gaps(_districts(spark, sf), ["dep", "prov", "dist"]).select(
        "dep", "prov", "dist", "weighted_mean", "rank", "low_coverage_warning"
    )


_QUALITY = "CASE WHEN n_cp_with_weight = 0 THEN 'zero_population_sample_coverage' WHEN n_cp_with_weight < 3 THEN 'low_population_sample_coverage' WHEN n_cp_with_time = 0 THEN 'zero_routing_coverage' WHEN share_with_time_pct IS NULL OR share_with_time_pct < 50 THEN 'low_routing_coverage' ELSE 'computable' END"


def _with_quality(spark, sf):
    return _districts(spark, sf).withColumn(
        "district_status",
        X.district_quality(F.col("n_cp_with_weight"), F.col("n_cp_with_time"), F.col("share_with_time_pct"))
    )


@query("p11_district_quality", f"{_DIST} SELECT dep, prov, dist, {_QUALITY} AS district_status FROM d")
def _(spark, sf):
    return _with_quality(spark, sf).select("dep", "prov", "dist", "district_status")


@query(
    "p19_status_label",
    f"{_DIST} SELECT dep, prov, dist, CASE {_QUALITY} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in K.STATUS_LABELS.items()
    ) + " END AS label FROM d"
)
def _(spark, sf):
    return _with_quality(spark, sf).select("dep", "prov", "dist", X.status_label("district_status").alias("label"))


@query(
    "w7_split",
    f"{_DIST} SELECT dep, prov, dist, CAST(row_number() OVER (ORDER BY weighted_mean DESC, dep, prov, dist) AS INTEGER) AS rank FROM d WHERE {_QUALITY} = 'computable' AND weighted_mean IS NOT NULL"
)
def _(spark, sf):
    return inequality.split_gaps(_with_quality(spark, sf), ["dep", "prov", "dist"])[0].select("dep", "prov", "dist", "rank")


@query(
    "k4_worst_district",
    f"{_DIST} SELECT dep, prov, dist, weighted_mean FROM d WHERE weighted_mean IS NOT NULL ORDER BY weighted_mean DESC LIMIT 1"
)
def _(spark, sf):
    return inequality.worst_district(_districts(spark, sf), ["dep", "prov", "dist"])


# --- quality rules and normalisers ------------------------------------------------------------------------------


@query(
    "p3_normalize_category",
    f"WITH {T.FACILITIES}, {T.NORMED} SELECT facility_id, {T.CATEGORY} AS category, coalesce(upper(trim(state)) = 'ACTIVO', false) AS is_active, {T.CATEGORY} IN ('II-1','II-2','II-E','III-1','III-2','III-E') AND upper(trim(state)) = 'ACTIVO' AS is_resolutive FROM normed"
)
def _(spark, sf):
    f = T.facilities(spark, sf).withColumns({"category": X.normalize_category("raw_category"), "is_active": X.is_active("state")})
    return f.select("facility_id", "category", "is_active", (F.col("category").isin(*K.RESOLUTIVE) & F.col("is_active")).alias("is_resolutive"))


_MISSING = "(lon IS NULL OR lat IS NULL OR (abs(lon) <= 1e-6 AND abs(lat) <= 1e-6))"
_IN = "coalesce(lon BETWEEN -81.4e0 AND -68.6e0 AND lat BETWEEN -18.4e0 AND 0e0, false)"
_SWAP = "coalesce(lat BETWEEN -81.4e0 AND -68.6e0 AND lon BETWEEN -18.4e0 AND 0e0, false)"
_FLAGS = f"flags AS (SELECT *, {_MISSING} AS coord_missing, NOT {_MISSING} AND NOT {_IN} AS coord_out_of_bbox, NOT {_MISSING} AND NOT {_IN} AND {_SWAP} AS swap_candidate FROM facilities)"


def _validated(spark, sf):
    return quality.validated(T.facilities(spark, sf), "facility_id", inside_swapped=F.col("k") % 2 == 0)


@query(
    "v1_v2_v3_coordinates",
    f"WITH {T.FACILITIES}, {_FLAGS} SELECT facility_id, coord_missing, coord_out_of_bbox, swap_candidate, swap_candidate AND k % 2 = 0 AS swap_corrected, coord_missing OR (coord_out_of_bbox AND NOT (swap_candidate AND k % 2 = 0)) AS qc_excluded_from_routing, {R('CASE WHEN swap_candidate AND k % 2 = 0 THEN lat ELSE lon END')} AS lon, {R('CASE WHEN swap_candidate AND k % 2 = 0 THEN lon ELSE lat END')} AS lat FROM flags"
)
def _(spark, sf):
    return _validated(spark, sf).select(
        "facility_id", "coord_missing", "coord_out_of_bbox", "swap_candidate", "swap_corrected",
        "qc_excluded_from_routing", "lon", "lat"
    )


@query(
    "a19_quality_report",
    f"WITH {T.FACILITIES}, {_FLAGS} SELECT 'coord_missing' AS regla, count(*) FILTER (WHERE coord_missing) AS n_afectados, 'keep_warning' AS accion FROM flags UNION ALL SELECT 'coord_out_of_bbox', count(*) FILTER (WHERE coord_out_of_bbox), 'keep_warning' FROM flags UNION ALL SELECT 'swapped_latlon', count(*) FILTER (WHERE swap_candidate), 'correct_with_audit' FROM flags"
)
def _(spark, sf):
    return quality.quality_report(
        _validated(spark, sf),
        {"coord_missing": "coord_missing", "coord_out_of_bbox": "coord_out_of_bbox", "swapped_latlon": "swap_candidate"},
        {"swapped_latlon": "correct_with_audit"}
    )


@query(
    "a20_audit_detail",
    f"WITH {T.FACILITIES}, {_FLAGS} SELECT facility_id AS record_key, coord_missing, coord_out_of_bbox FROM flags WHERE coord_missing OR coord_out_of_bbox"
)
def _(spark, sf):
    return quality.audit_detail(_validated(spark, sf), "facility_id", ["coord_missing", "coord_out_of_bbox"])


@query(
    "a21_alarm",
    f"WITH {T.FACILITIES}, {_FLAGS} SELECT CASE WHEN 100.0 * count(*) FILTER (WHERE coord_missing) / count(*) > 1 THEN 'ALARM missing: ' || count(*) FILTER (WHERE coord_missing) || '/' || count(*) END AS alarm FROM flags"
)
def _(spark, sf):
    return _validated(spark, sf).agg(quality.alarm(F.count_if("coord_missing"), F.count(F.lit(1)), 1.0, "missing").alias("alarm"))


@query(
    "p6_pools",
    f"WITH {T.FACILITIES}, {T.NORMED}, {_FLAGS}, c AS (SELECT normed.facility_id, {T.CATEGORY} AS category, upper(trim(normed.state)) = 'ACTIVO' AND NOT (coord_missing OR (coord_out_of_bbox AND NOT (swap_candidate AND normed.k % 2 = 0))) AS ok FROM normed JOIN (SELECT facility_id, coord_missing, coord_out_of_bbox, swap_candidate FROM flags) USING (facility_id)) SELECT facility_id, CASE WHEN category IN ('II-1','II-2','II-E','III-1','III-2','III-E') THEN 'Resolutivo' ELSE 'Candidato' END AS layer FROM c WHERE ok AND (category IN ('II-1','II-2','II-E','III-1','III-2','III-E') OR category IN ('I-3','I-4'))"
)
def _(spark, sf):
    f = _validated(spark, sf).withColumns({"category": X.normalize_category("raw_category"), "is_active": X.is_active("state")})
    both = filters.resolutive(f).unionByName(filters.upgrade_candidates(f))
    return both.select("facility_id", X.facility_layer(F.col("category").isin(*K.RESOLUTIVE), F.col("category").isin("I-3", "I-4")).alias("layer"))


@query(
    "w9_duplicates",
    "SELECT doc_id, count(*) OVER (PARTITION BY n_chars) > 1 AS dup_any, count(*) OVER (PARTITION BY n_chars) > 1 AND count(*) OVER (PARTITION BY n_chars, text) = 1 AS dup_conflict, count(*) OVER (PARTITION BY n_chars, text) > 1 AND row_number() OVER (PARTITION BY n_chars, text ORDER BY doc_id) > 1 AS dup_drop FROM documents"
)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", "n_chars", "text")
    return quality.duplicate_flags(d, "n_chars", ["n_chars", "text"], ["doc_id"]).select("doc_id", "dup_any", "dup_conflict", "dup_drop")


@query(
    "f10_mojibake",
    f"WITH d AS (SELECT replace(text, 'é', 'Ã©') AS a, replace(source, '1', 'â€™') AS b FROM documents), n AS (SELECT count(a) + count(b) AS n_values, count(*) FILTER (WHERE regexp_matches(a, 'Ã.|Â.|â€.|�')) + count(*) FILTER (WHERE regexp_matches(b, 'Ã.|Â.|â€.|�')) AS n_flagged FROM d) SELECT n_values, n_flagged, {R('100.0 * n_flagged / n_values')} AS pct, 100.0 * n_flagged / n_values <= 1 AS ok FROM n"
)
def _(spark, sf):
    d = T.read(spark, sf, "documents").select(
        F.replace(F.col("text"), F.lit("é"), F.lit("Ã©")).alias("a"),
        F.replace(F.col("source"), F.lit("1"), F.lit("â€™")).alias("b")
    )
    return quality.encoding_report(d, ["a", "b"], 1.0)


@query(
    "f12_place_key",
    "SELECT n_nationkey, upper(trim(r_name)) || '|' || upper(trim(n_name)) AS place FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def _(spark, sf):
    n, r = T.read(spark, sf, "nation"), T.read(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", X.place_key("r_name", "n_name").alias("place"))


@query("p12_geographic_filter", f"WITH {T.DEMAND} SELECT dep, dist, count(*) AS n FROM demand WHERE dep IN ('ASIA', 'EUROPE') GROUP BY dep, dist")
def _(spark, sf):
    return filters.geographic(
        T.demand(spark, sf), {"dep": ["ASIA", "EUROPE"], "prov": [K.ALL], "dist": None}
    ).groupBy("dep", "dist").agg(F.count(F.lit(1)).alias("n"))


@query("p14_cascade", f"WITH {T.DEMAND} SELECT 0 AS ord, 'Todos' AS option UNION ALL SELECT DISTINCT 1, prov FROM demand WHERE dep = 'ASIA'")
def _(spark, sf):
    return filters.options(T.demand(spark, sf), "prov", {"dep": ["ASIA"]})


@query(
    "f15_color",
    f"{_DIST}, b AS (SELECT min(weighted_mean) AS lo, max(weighted_mean) AS hi FROM d WHERE {_QUALITY} = 'computable') SELECT dep, prov, dist, CASE WHEN {_QUALITY} = 'computable' AND weighted_mean IS NOT NULL THEN CAST(least(floor((weighted_mean - lo) / (hi - lo) * 4 + 0.5), 4) AS INTEGER) END AS color FROM d, b"
)
def _(spark, sf):
    q = _with_quality(spark, sf)
    b = q.where(F.col("district_status") == K.COMPUTABLE).agg(F.min("weighted_mean").alias("lo"), F.max("weighted_mean").alias("hi"))
    return q.crossJoin(F.broadcast(b)).select(
        "dep", "prov", "dist",
        X.color_position(F.col("weighted_mean"), F.col("lo"), F.col("hi"), F.col("district_status")).alias("color")
    )


# --- geometry --------------------------------------------------------------------------------------------------

_HAV = "2 * 6371000e0 * asin(sqrt(least(greatest(pow(sin((radians({b2}) - radians({b1})) / 2), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin(radians({a2} - {a1}) / 2), 2), 0e0), 1e0)))"


@query(
    "f1_haversine",
    f"WITH {T.FACILITIES} SELECT facility_id, {R(_HAV.format(a1='lon', b1='lat', a2='-71.97e0', b2='-13.52e0'), 3)} AS metres FROM facilities"
)
def _(spark, sf):
    m = X.haversine_m(F.col("lon"), F.col("lat"), F.lit(-71.97), F.lit(-13.52))
    return T.facilities(spark, sf).select("facility_id", F.round(m, 3).alias("metres"))


@query(
    "a31_bounds",
    f"WITH {T.FACILITIES} SELECT {R('min(lon)')} AS min_lon, {R('min(lat)')} AS min_lat, {R('max(lon)')} AS max_lon, {R('max(lat)')} AS max_lat FROM facilities"
)
def _(spark, sf):
    return geo.bounds(T.facilities(spark, sf))


def _boxes(spark, sf):
    """A box per nation, side by side."""
    n = T.read(spark, sf, "nation").select("n_nationkey", (-81.4 + 0.5 * F.col("n_nationkey")).alias("x"))
    p = lambda dx, y: F.struct((F.col("x") + dx).alias("x"), F.lit(y).alias("y"))
    return n.select("n_nationkey", F.array(F.array(p(0.0, -18.4), p(0.5, -18.4), p(0.5, 0.0), p(0.0, 0.0))).alias("rings"))


@query(
    "v4_declared_district",
    f"""WITH {T.FACILITIES}, {T.STRIPS}, own AS (SELECT *, lpad(CAST(s_nationkey AS VARCHAR), 6, '0') AS code FROM facilities), {T.near_sql("n", "own", "facility_id", "lon", "lat")}
SELECT facility_id, coalesce(NOT n.near, false) AS district_mismatch FROM facilities LEFT JOIN n ON n.key = facility_id""",
)
def _(spark, sf):
    f = T.facilities(spark, sf).withColumn("code", F.lpad(F.col("s_nationkey").cast("string"), 6, "0"))
    return geo.outside_declared(f, T.strips(spark, sf, "code"), "code").select("facility_id", "district_mismatch")


@query(
    "a23_dissolve",
    f"""WITH {T.FACILITIES}, box AS (SELECT n_regionkey, n_nationkey, -81.4e0 + 0.5e0 * n_nationkey AS x FROM nation), inside AS (SELECT n_regionkey, count(*) AS n FROM box JOIN facilities ON lon >= x AND lon < x + 0.5e0 AND lat >= -18.4e0 AND lat < 0e0 GROUP BY n_regionkey)
SELECT n_regionkey, count(*) AS n_rings, lpad(CAST(min(n_nationkey) AS VARCHAR), 2, '0') AS first_code, any_value(coalesce(inside.n, 0)) AS n_inside FROM box LEFT JOIN inside USING (n_regionkey) GROUP BY n_regionkey""",
)
def _(spark, sf):
    b = _boxes(spark, sf).join(T.read(spark, sf, "nation"), "n_nationkey").withColumn(
        "first_code", F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    )
    regions = geo.dissolve(b, ["n_regionkey"], firsts=("first_code",))
    inside = T.facilities(spark, sf).join(F.broadcast(regions), geo.contains(F.col("lon"), F.col("lat"), F.col("rings")))  # five regions
    counts = inside.groupBy(F.col("n_regionkey").alias("_r")).agg(F.count(F.lit(1)).alias("n_inside"))
    return regions.join(counts, F.col("n_regionkey") == F.col("_r"), "left").select(
        "n_regionkey", F.size("rings").cast("long").alias("n_rings"), "first_code",
        F.coalesce("n_inside", F.lit(0)).alias("n_inside")
    )


def _points(spark, sf, table, key):
    return T.located(T.read(spark, sf, table).select(F.col(key).alias("k")))


def _snapped(spark, sf):
    nodes = _points(spark, sf, "part", "p_partkey").where("lon is not null and lon <> 0")
    return geo.snap(_points(spark, sf, "supplier", "s_suppkey"), nodes, "k", "k", 5000.0)


_SNAP = f"""WITH n AS (SELECT * FROM (SELECT p_partkey AS node_id, {T.located_sql("p_partkey")} FROM part) WHERE lon IS NOT NULL AND lon <> 0), m AS (SELECT cos(radians(avg(lat))) AS c FROM n),
p AS (SELECT s_suppkey AS point_id, {T.located_sql("s_suppkey")} FROM supplier),
j AS (SELECT point_id, node_id, {_HAV.format(a1="p.lon", b1="p.lat", a2="n.lon", b2="n.lat")} AS d, row_number() OVER (PARTITION BY point_id ORDER BY pow((p.lon - n.lon) * c, 2) + pow(p.lat - n.lat, 2), node_id) AS rn FROM p, n, m WHERE p.lon IS NOT NULL AND p.lat IS NOT NULL),
s AS (SELECT p.point_id, CASE WHEN j.d <= 5000 THEN 'success' ELSE 'failure' END AS status, round(j.d, 3) AS snap_distance_m FROM p LEFT JOIN j ON j.point_id = p.point_id AND rn = 1)"""


@query("j14_snap", f"{_SNAP} SELECT point_id, status, snap_distance_m FROM s")
def _(spark, sf):
    return T.rounded(_snapped(spark, sf), 3).select("point_id", "status", "snap_distance_m")


@query(
    "a18_snap_report",
    f"{_SNAP} SELECT count(*) AS n_total, count(*) FILTER (WHERE status <> 'success') AS n_failed, {R('100.0 * count(*) FILTER (WHERE status <> $$success$$) / count(*)')} AS pct_failed, round(avg(snap_distance_m), 2) AS mean_snap_m, round(quantile_cont(snap_distance_m, 0.5), 2) AS median_snap_m, round(quantile_cont(snap_distance_m, 0.95), 2) AS p95_snap_m, round(max(snap_distance_m), 2) AS max_snap_m FROM s"
)
def _(spark, sf):
    return geo.snap_report(T.rounded(_snapped(spark, sf), 3)).withColumns(
        {c: F.round(c, 2) for c in ("mean_snap_m", "median_snap_m", "p95_snap_m", "max_snap_m")}
    )


# --- network -------------------------------------------------------------------------------------------------

_MAX = """CASE WHEN lower(trim(maxspeed)) IN ('none','signals','walk','variable') THEN NULL ELSE (CASE WHEN kmh BETWEEN 3 AND 150 THEN kmh END) END"""
_PARSED = f"""parsed AS (SELECT *, TRY_CAST(regexp_replace(split_part(split_part(lower(trim(maxspeed)), ';', 1), ',', 1), '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN contains(maxspeed, 'mph') THEN 1.60934e0 ELSE 1e0 END AS kmh FROM edges),
speeds AS (SELECT *, {_MAX} AS ms FROM parsed),
ways AS (SELECT *, coalesce(oneway, '') NOT IN ('-1', 'reverse') AS fwd, NOT (coalesce(oneway, '') = 'yes' OR (coalesce(junction, '') = 'roundabout' AND coalesce(oneway, '') NOT IN ('no', '0', 'false', '-1', 'reverse'))) AS bwd FROM speeds)"""
_CAR = "CASE highway " + " ".join(f"WHEN '{k}' THEN {float(v)}e0" for k, v in K.CAR_SPEED.items()) + " WHEN 'track' THEN 12e0 ELSE 30e0 END"
_BIKE = "CASE highway " + " ".join(f"WHEN '{k}' THEN {float(v)}e0" for k, v in K.BIKE_SPEED.items()) + " ELSE 12e0 END"
_CAR_OK = "highway NOT IN ('footway','path','pedestrian','steps','cycleway','bridleway','corridor') AND coalesce(access, '') NOT IN ('no', 'private')"
_HIGH = "highway IN ('motorway','motorway_link','trunk','trunk_link')"
_BIKE_OK = f"NOT (({_HIGH} OR highway = 'steps') AND coalesce(bicycle, '') <> 'yes') AND coalesce(bicycle, '') <> 'no' AND NOT (coalesce(access, '') IN ('no', 'private') AND coalesce(bicycle, '') NOT IN ('yes','permissive','designated'))"
_FOOT_OK = f"NOT ({_HIGH} AND coalesce(foot, '') <> 'yes') AND coalesce(foot, '') <> 'no' AND NOT (coalesce(access, '') IN ('no', 'private') AND coalesce(foot, '') NOT IN ('yes','permissive','designated'))"


def _edge_sql(ok, speed, fwd="fwd", bwd="bwd"):
    return f"WITH {T.EDGES}, {_PARSED} SELECT id, u, v, {R(f'CASE WHEN {ok} THEN {speed} END')} AS speed_kmh, {R(f'CASE WHEN {ok} THEN length / ({speed} * 1000.0 / 3600.0) END')} AS time_s, CASE WHEN {ok} THEN {fwd} END AS forward, CASE WHEN {ok} THEN {bwd} END AS backward FROM ways"


def _edge_query(mode):
    def run(spark, sf):
        e = T.edges(spark, sf)
        return e.withColumn("w", X.make_edge_weight(mode, e.columns, F.col("length"))).select(
            "id", "u", "v", "w.speed_kmh", "w.time_s", "w.forward", "w.backward"
        )

    return run


query("f5_car_weight", _edge_sql(_CAR_OK, f"coalesce(ms, {_CAR})"))(_edge_query("car"))
query("f6_bike_weight", _edge_sql(_BIKE_OK, _BIKE))(_edge_query("bike"))
query("f7_foot_weight", _edge_sql(_FOOT_OK, "CASE WHEN highway = 'steps' THEN 2e0 ELSE 5e0 END", "true", "true"))(_edge_query("foot"))


@query("f2_f4_tags", f"WITH {T.EDGES}, {_PARSED} SELECT id, u, v, {R('ms')} AS maxspeed_kmh, fwd AS forward, bwd AS backward FROM ways")
def _(spark, sf):
    e = T.edges(spark, sf).withColumn("w", X.oneway(F.col("oneway"), F.col("junction")))
    return e.select("id", "u", "v", X.parse_maxspeed("maxspeed").alias("maxspeed_kmh"), "w.forward", "w.backward")


@query(
    "g1_edges",
    f"WITH {T.EDGES}, {_PARSED}, car AS (SELECT u, v, length / (coalesce(ms, {_CAR}) * 1000.0 / 3600.0) AS time_s, length, fwd, bwd FROM ways WHERE {_CAR_OK}), both_ AS (SELECT u, v, time_s, length FROM car WHERE fwd UNION ALL SELECT v, u, time_s, length FROM car WHERE bwd) SELECT u, v, round(min(time_s), 6) AS time_s, round(arg_min(length, (time_s, length)), 6) AS length FROM both_ GROUP BY u, v"
)
def _(spark, sf):
    return network.graph(T.edges(spark, sf), "car").select("u", "v", "time_s", "length")


@query("u2_merge_network", f"WITH {T.EDGES} SELECT id, u, v, length FROM edges")
def _(spark, sf):
    e = T.edges(spark, sf)
    return network.merge_edges(e.where("u % 2 = 0"), e).select("id", "u", "v", "length")


@query(
    "w11_nearest",
    f"WITH {T.MODE_PAIRS} SELECT demand_id, mode, facility_id, {R('distance_m')} AS distance_m, {R('travel_time_min')} AS travel_time_min, reachable FROM nearest"
)
def _(spark, sf):
    return network.nearest_by_mode(T.mode_pairs(spark, sf))


def _nearest(spark, sf):
    return network.nearest_by_mode(T.mode_pairs(spark, sf))


_G7 = f"WITH {T.MODE_PAIRS}, g AS (SELECT c.demand_id, CASE WHEN c.facility_id = f.facility_id THEN 'both_reachable_same_facility' ELSE 'both_reachable_different_facility' END AS category, c.facility_id AS facility_id_car, f.facility_id AS facility_id_foot, c.travel_time_min AS car_time_min, f.travel_time_min AS foot_time_min, f.travel_time_min / nullif(c.travel_time_min, 0) AS foot_over_car_ratio FROM nearest c JOIN nearest f ON c.demand_id = f.demand_id AND c.mode = 'car' AND f.mode = 'foot')"


@query(
    "g7_car_vs_foot",
    f"{_G7} SELECT demand_id, category, facility_id_car, facility_id_foot, {R('car_time_min')} AS car_time_min, {R('foot_time_min')} AS foot_time_min, {R('foot_over_car_ratio')} AS foot_over_car_ratio FROM g"
)
def _(spark, sf):
    return network.car_vs_foot(_nearest(spark, sf))


@query(
    "g7_summary",
    f"{_G7} SELECT count(*) AS n_total, count(*) FILTER (WHERE category = 'both_reachable_same_facility') AS both_reachable_same_facility, count(*) FILTER (WHERE category = 'both_reachable_different_facility') AS both_reachable_different_facility, 0::BIGINT AS car_only_reachable, 0::BIGINT AS foot_only_reachable, 0::BIGINT AS both_unreachable, {R('100.0 * count(*) FILTER (WHERE category = $$both_reachable_different_facility$$) / nullif(count(*), 0)')} AS pct_different FROM g"
)
def _(spark, sf):
    return network.car_vs_foot_summary(network.car_vs_foot(_nearest(spark, sf)))


@query(
    "k3_ratio_extremes",
    f"{_G7} SELECT demand_id, {R('foot_over_car_ratio')} AS foot_over_car_ratio FROM g WHERE category = 'both_reachable_different_facility' AND foot_over_car_ratio IS NOT NULL ORDER BY g.foot_over_car_ratio DESC, demand_id LIMIT 20"
)
def _(spark, sf):
    return network.ratio_extremes(network.car_vs_foot(_nearest(spark, sf))).select("demand_id", "foot_over_car_ratio")


@query("p15_extreme_ratio", f"{_G7} SELECT demand_id, {R('foot_over_car_ratio')} AS foot_over_car_ratio FROM g WHERE foot_over_car_ratio > 5")
def _(spark, sf):
    return access.extreme_ratio(network.car_vs_foot(_nearest(spark, sf)), threshold=5.0).select("demand_id", "foot_over_car_ratio")


_T = lambda m: f"max(travel_time_min) FILTER (WHERE mode = '{m}')"


@query("g8_three_mode", f"""WITH {T.MODE_PAIRS}, ids AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS demand_id FROM orders), w AS (SELECT ids.demand_id, {_T("car")} AS c, {_T("bike")} AS b, {_T("foot")} AS f, max(facility_id) FILTER (WHERE mode = 'car') AS fc, max(facility_id) FILTER (WHERE mode = 'foot') AS ff FROM ids LEFT JOIN nearest ON nearest.demand_id = ids.demand_id GROUP BY ids.demand_id),
n AS (SELECT *, CAST((c IS NOT NULL) AS INTEGER) + CAST((b IS NOT NULL) AS INTEGER) + CAST((f IS NOT NULL) AS INTEGER) AS k FROM w)
SELECT demand_id, {R("c")} AS time_car_min, {R("b")} AS time_bike_min, {R("f")} AS time_foot_min, k AS n_modes_reachable, CASE k WHEN 3 THEN 'all_three_reachable' WHEN 2 THEN 'exactly_two_reachable' WHEN 1 THEN 'exactly_one_reachable' ELSE 'none_reachable' END AS reachability_category, {R("f / nullif(c, 0)")} AS foot_over_car_ratio, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN fc = ff END AS car_foot_same_facility FROM n""")
def _(spark, sf):
    ids = T.read(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("demand_id"))
    return network.three_modes(_nearest(spark, sf), ids).select(
        "demand_id", "time_car_min", "time_bike_min", "time_foot_min", "n_modes_reachable", "reachability_category",
        "foot_over_car_ratio", "car_foot_same_facility"
    )


@query(
    "a29_routing_quality",
    f"WITH {T.MODE_PAIRS}, s AS (SELECT mode, CASE WHEN reachable THEN 'routed' ELSE 'no_route_same_department' END AS st FROM pairs) SELECT mode || '_' || name AS metric, n AS value FROM (SELECT mode, 'snap_failed' AS name, 0::BIGINT AS n FROM s GROUP BY mode UNION ALL SELECT mode, 'snap_success', count(*) FROM s GROUP BY mode UNION ALL SELECT mode, 'routed', count(*) FILTER (WHERE st = 'routed') FROM s GROUP BY mode UNION ALL SELECT mode, 'no_route_same_department', count(*) FILTER (WHERE st <> 'routed') FROM s GROUP BY mode)"
)
def _(spark, sf):
    p = T.mode_pairs(spark, sf)
    return network.routing_quality(p.withColumn("routing_status", X.classify_demand(F.lit(True), F.col("reachable"))))


@query(
    "p9_p10_statuses",
    "SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'snap_failed' WHEN l_returnflag = 'R' THEN 'cross_department_not_evaluated' WHEN l_linestatus = 'O' THEN 'routed' ELSE 'no_route_same_department' END AS pair_status, CASE WHEN l_quantity < 5 THEN 'snap_failed' WHEN l_linestatus = 'O' THEN 'routed' ELSE 'no_route_same_department' END AS demand_status FROM lineitem"
)
def _(spark, sf):
    ok, same, reach = F.col("l_quantity") >= 5, F.col("l_returnflag") != "R", F.col("l_linestatus") == "O"
    return T.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", X.classify_pair(ok, same, reach).alias("pair_status"),
        X.classify_demand(ok, reach).alias("demand_status")
    )


def _places(spark, sf):
    """Facilities (nations) and demand points (customers) on nodes of the road graph, by region."""
    n, c = T.read(spark, sf, "nation"), T.read(spark, sf, "customer")
    f = n.select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("facility_id"),
        F.when(F.col("n_nationkey") % 9 != 0, F.col("n_nationkey").cast("long") * 41 % 997).alias("node_id"),
        F.col("n_regionkey").alias("dep")
    )
    d = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("demand_id"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey") * 3 % 997).alias("node_id"),
        F.col("n_regionkey").alias("dep")
    )
    return d, f


#: Rounds that the SQL of shortest paths and components takes; the road graph has 997 nodes and few hops between any two.
_ROUNDS = 40
_PLACES = """n AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS facility_id, CASE WHEN n_nationkey % 9 <> 0 THEN CAST(n_nationkey AS BIGINT) * 41 % 997 END AS node_id, n_regionkey AS dep FROM nation),
pts AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS demand_id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 3 % 997 END AS node_id, n_regionkey AS dep FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _graph_sql(ok: str, speed: str, fwd: str = "fwd", bwd: str = "bwd") -> str:
    return f"""{T.EDGES}, {_PARSED}, one AS (SELECT u, v, length / ({speed} * 1000.0 / 3600.0) AS t, length AS l, {fwd} AS f, {bwd} AS b FROM ways WHERE {ok}),
g AS MATERIALIZED (SELECT u, v, min(t) AS t, arg_min(l, (t, l)) AS l FROM (SELECT u, v, t, l FROM one WHERE f UNION ALL SELECT v, u, t, l FROM one WHERE b) GROUP BY u, v)"""


def _rounds_sql(name: str, seed: str, step: str, keys: str, value: str) -> str:
    """Tables name0, name1, ...: the least value of each key, of the last table and of one step from it."""
    out = f"{name}0 AS MATERIALIZED ({seed})"
    for i in range(_ROUNDS):
        out += f", {name}{i + 1} AS MATERIALIZED (SELECT {keys}, min({value}) AS {value} FROM (SELECT {keys}, {value} FROM {name}{i} UNION ALL {step.format(last=f'{name}{i}')}) GROUP BY {keys})"
    return out


def _least_sql(name: str, weight: str) -> str:
    seed = "SELECT facility_id, node_id AS node, 0e0 AS c FROM n WHERE node_id IN (SELECT u FROM g UNION SELECT v FROM g)"
    return _rounds_sql(name, seed, f"SELECT facility_id, g.u, c + g.{weight} FROM {{last}} JOIN g ON g.v = node", "facility_id, node", "c")


@query(
    "g3_matrix",
    f"""WITH {_graph_sql(_CAR_OK, f"coalesce(ms, {_CAR})")}, {_PLACES}, {_least_sql("t", "t")}, {_least_sql("l", "l")},
cells AS (SELECT pts.demand_id, n.facility_id, pts.node_id AS origin_node, n.node_id AS dest_node, pts.dep = n.dep AS same, t{_ROUNDS}.c AS s, l{_ROUNDS}.c AS m FROM pts CROSS JOIN n
  LEFT JOIN t{_ROUNDS} ON t{_ROUNDS}.facility_id = n.facility_id AND t{_ROUNDS}.node = pts.node_id LEFT JOIN l{_ROUNDS} ON l{_ROUNDS}.facility_id = n.facility_id AND l{_ROUNDS}.node = pts.node_id),
st AS (SELECT *, CASE WHEN origin_node IS NULL OR dest_node IS NULL THEN 'snap_failed' WHEN NOT same THEN 'cross_department_not_evaluated' WHEN s IS NOT NULL THEN 'routed' ELSE 'no_route_same_department' END AS routing_status FROM cells)
SELECT demand_id, facility_id, 'car' AS mode, CASE WHEN routing_status = 'routed' THEN round(m, 6) END AS distance_m, CASE WHEN routing_status = 'routed' THEN round(s / 60, 6) END AS travel_time_min, routing_status = 'routed' AS reachable, routing_status, origin_node, dest_node FROM st""",
)
def _(spark, sf):
    d, f = _places(spark, sf)
    return network.matrix(network.graph(T.edges(spark, sf), "car"), d, f, "car")


_BEST = "{'c': 0e0, 'f': max(facility_id), 's': 0e0}"


@query(
    "g4_multi_source",
    f"""WITH {_graph_sql(_FOOT_OK, "CASE WHEN highway = 'steps' THEN 2e0 ELSE 5e0 END", "true", "true")}, {_PLACES},
{_rounds_sql("r", f"SELECT node_id AS node, {_BEST} AS x FROM n WHERE node_id IN (SELECT u FROM g UNION SELECT v FROM g) GROUP BY node_id", "SELECT g.u, {{'c': x.c + g.t, 'f': x.f, 's': x.s + g.l}} FROM {last} JOIN g ON g.v = node", "node", "x")}
SELECT demand_id, x.f AS facility_id, 'foot' AS mode, round(x.s, 6) AS distance_m, round(x.c / 60, 6) AS travel_time_min, x IS NOT NULL AS reachable, CASE WHEN node_id IS NULL THEN 'snap_failed' WHEN x IS NULL THEN 'no_route_same_department' ELSE 'routed' END AS routing_status
FROM pts LEFT JOIN r{_ROUNDS} ON node = node_id""",
)
def _(spark, sf):
    d, f = _places(spark, sf)
    return network.nearest_multi_source(network.graph(T.edges(spark, sf), "foot"), d, f, "foot")


@query(
    "g5_components",
    f"""WITH {_graph_sql(_BIKE_OK, _BIKE)}, two AS (SELECT u, v FROM g UNION SELECT v, u FROM g),
{_rounds_sql("c", "SELECT DISTINCT u AS node, u AS component FROM two", "SELECT two.u, component FROM {last} JOIN two ON two.v = node", "node", "component")} SELECT node, component FROM c{_ROUNDS}""",
)
def _(spark, sf):
    return network.weak_components(network.graph(T.edges(spark, sf), "bike"))


@query(
    "j15_straight_line",
    f"WITH {T.MODE_PAIRS}, {T.FACILITIES}, pts AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS demand_id, {T.located_sql('o_orderkey')} FROM orders), j AS (SELECT nearest.demand_id, mode, facility_id, distance_m, {_HAV.format(a1='pts.lon', b1='pts.lat', a2='facilities.lon', b2='facilities.lat')} AS s FROM nearest JOIN pts USING (demand_id) JOIN facilities USING (facility_id)) SELECT demand_id, mode, facility_id, {R('s', 3)} AS straight_m, {R('distance_m / nullif(s, 0)')} AS ratio FROM j"
)
def _(spark, sf):
    points = T.located(T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))).withColumn(
        "demand_id", F.lpad(F.col("k").cast("string"), 10, "0")
    )
    out = network.straight_line_vs_network(_nearest(spark, sf), points, T.facilities(spark, sf))
    return out.select("demand_id", "mode", "facility_id", F.round("straight_m", 3).alias("straight_m"), "ratio")


# --- scenarios ------------------------------------------------------------------------------------------------

_PICK = "('000001', '000002', '000003', '000005', '000008')"
_SEL = ["000001", "000002", "000003", "000005", "000008"]
_SCEN = f"WITH {T.DEMAND}, {T.MATRIX}, best AS (SELECT demand_id, min(travel_time_min) AS b FROM matrix WHERE facility_id IN {_PICK} GROUP BY demand_id), s AS (SELECT demand.*, least(t_min, b) AS scenario_t FROM demand LEFT JOIN best USING (demand_id))"


@query("x1_scenario", f"{_SCEN} SELECT demand_id, {R('scenario_t')} AS scenario_t FROM s")
def _(spark, sf):
    return scenario.scenario_time(T.demand(spark, sf), T.matrix(spark, sf), _SEL).select("demand_id", "scenario_t")


def _sum_sql(t, suffix):
    s = lambda c: f"CAST(coalesce(sum(weight) FILTER (WHERE {c}), 0) AS BIGINT)"
    return f"CAST(sum(weight) AS BIGINT) AS total_population{suffix}, {s(f'{t} <= 30')} AS pop_le_30{suffix}, {s(f'{t} <= 60')} AS pop_le_60_cum{suffix}, {s(f'{t} <= 120')} AS pop_le_120_cum{suffix}, {s(f'{t} > 120')} AS pop_gt_120{suffix}, {s(f'{t} IS NULL')} AS pop_no_time_estimate{suffix}, {s(f'{t} > 30 AND {t} <= 60')} AS pop_30_60_only{suffix}, CAST(sum({t} * weight) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE {t} IS NOT NULL) AS DOUBLE) AS weighted_mean{suffix}"


@query(
    "x3_baseline_vs_scenario",
    f"{_SCEN}, a AS (SELECT {_sum_sql('t_min', '_baseline')}, {_sum_sql('scenario_t', '_scenario')}, CAST(coalesce(sum(weight) FILTER (WHERE t_min IS NULL AND scenario_t IS NOT NULL), 0) AS BIGINT) AS population_newly_routed FROM s) SELECT * REPLACE ({R('weighted_mean_baseline')} AS weighted_mean_baseline, {R('weighted_mean_scenario')} AS weighted_mean_scenario), pop_le_30_scenario - pop_le_30_baseline AS pop_gain_le_30, pop_le_60_cum_scenario - pop_le_60_cum_baseline AS pop_gain_le_60, pop_le_120_cum_scenario - pop_le_120_cum_baseline AS pop_gain_le_120, {R('weighted_mean_baseline - weighted_mean_scenario')} AS weighted_mean_reduction_min FROM a"
)
def _(spark, sf):
    return scenario.baseline_vs_scenario(T.demand(spark, sf), T.matrix(spark, sf), _SEL, weight="weight")


@query("x4_candidate_scores", f"""WITH {T.DEMAND}, {T.MATRIX}, base AS (SELECT sum(t_min * weight) AS tw, sum(weight) FILTER (WHERE t_min IS NOT NULL) AS w FROM demand), better AS (SELECT m.facility_id, travel_time_min AS m, t_min AS t, weight AS w FROM matrix m JOIN demand d USING (demand_id) WHERE weight IS NOT NULL AND (t_min IS NULL OR travel_time_min < t_min)),
g AS (SELECT facility_id, sum(w) FILTER (WHERE m <= 30 AND (t IS NULL OR t > 30)) AS g30, sum(w) FILTER (WHERE m <= 60 AND (t IS NULL OR t > 60)) AS g60, sum(w) FILTER (WHERE m <= 120 AND (t IS NULL OR t > 120)) AS g120, sum(w) FILTER (WHERE t IS NULL) AS nw, sum((m - coalesce(t, 0)) * w) AS dtw FROM better GROUP BY facility_id)
SELECT ids.facility_id, CAST(coalesce(g30, 0) AS BIGINT) AS pop_gain_le_30, CAST(coalesce(g60, 0) AS BIGINT) AS pop_gain_le_60, CAST(coalesce(g120, 0) AS BIGINT) AS pop_gain_le_120, {R("CAST(tw AS DOUBLE) / CAST(base.w AS DOUBLE) - CAST(tw + coalesce(dtw, 0) AS DOUBLE) / CAST(base.w + coalesce(nw, 0) AS DOUBLE)")} AS weighted_mean_reduction_min FROM (SELECT DISTINCT facility_id FROM matrix) ids CROSS JOIN base LEFT JOIN g ON g.facility_id = ids.facility_id""")
def _(spark, sf):
    return scenario.candidate_scores(T.demand(spark, sf), T.matrix(spark, sf))


@query(
    "w8_rank_candidates",
    ORACLE_SQL["x4_candidate_scores"].replace(
        "SELECT ids.facility_id,",
        "SELECT facility_id, pop_gain_le_60, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY pop_gain_le_60 DESC, facility_id) AS rank FROM (SELECT ids.facility_id,"
    ) + ")) WHERE rank <= 20"
)
def _(spark, sf):
    return inequality.rank_candidates(
        scenario.candidate_scores(T.demand(spark, sf), T.matrix(spark, sf)), "pop_gain_le_60", "facility_id", 20
    ).select("facility_id", "pop_gain_le_60", "rank")


@query(
    "j20_improvement",
    f"{_SCEN}, b AS (SELECT dep, prov, dist, {R(_M('weight'))} AS before FROM s GROUP BY ALL), a AS (SELECT dep, prov, dist, {R('CAST(sum(scenario_t * weight) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE scenario_t IS NOT NULL) AS DOUBLE)')} AS after FROM s GROUP BY ALL) SELECT dep, prov, dist, before, after, {R('before - after')} AS improvement FROM a JOIN b USING (dep, prov, dist) WHERE before - after > 0 ORDER BY before - after DESC, dep, prov, dist LIMIT 10"
)
def _(spark, sf):
    d = scenario.scenario_time(T.demand(spark, sf), T.matrix(spark, sf), _SEL)
    keys = ["dep", "prov", "dist"]
    before, after = T.rounded(access.weighted_mean_access(d, keys)), T.rounded(access.weighted_mean_access(d, keys, time="scenario_t"))
    return scenario.improvement_top(before, after, keys)


# --- whole phases and dashboard tables --------------------------------------------------------------------------

_SCOPE = ["AFRICA", "Asia", "EUROPE"]
_SCOPE_SQL = "('AFRICA', 'ASIA', 'EUROPE')"


def _phase_sql(raw: str, key: str, dep: str, texts: str, extra: str) -> str:
    """flags: the records without copies, with all flags; dups: counts of copies; bad: values decoded wrongly."""
    bad = " + ".join(f"coalesce(CAST(regexp_matches({c}, 'Ã.|Â.|â€.|�') AS INTEGER), 0)" for c in texts.split())
    some = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in texts.split())
    return f"""WITH {raw}, {T.STRIPS}, scoped AS (SELECT *, UBIGEO AS code, count(*) OVER (PARTITION BY {key}) AS n_key, row_number() OVER (PARTITION BY {key}, {texts.split()[0]} ORDER BY k) AS nth, count(*) OVER (PARTITION BY {key}, {texts.split()[0]}) AS n_row FROM raw WHERE upper({dep}) IN {_SCOPE_SQL}),
dups AS (SELECT count(*) FILTER (WHERE n_key > 1) AS dups, count(*) FILTER (WHERE n_row > 1 AND nth > 1) AS copies, count(*) FILTER (WHERE n_key > 1 AND n_row = 1) AS conflicts FROM scoped),
f1 AS (SELECT *, {key} || '/' || {texts.split()[0]} AS rid, n_key > 1 AND n_row = 1 AS conflict, {_MISSING} AS coord_missing, NOT {_MISSING} AND NOT {_IN} AS out_, NOT {_MISSING} AND NOT {_IN} AND {_SWAP} AS swap FROM scoped WHERE nth = 1),
{T.near_sql("sw", "f1", "rid", "lat", "lon")}, f2 AS (SELECT f1.*, swap AND coalesce(sw.near, false) AS fixed FROM f1 LEFT JOIN sw ON sw.key = rid),
f3 AS (SELECT * REPLACE (CASE WHEN fixed THEN lat ELSE lon END AS lon, CASE WHEN fixed THEN lon ELSE lat END AS lat), coord_missing OR (out_ AND NOT fixed) AS excluded FROM f2),
{T.near_sql("ne", "f3", "rid", "lon", "lat")}, flags AS (SELECT f3.*, NOT excluded AND coalesce(NOT ne.near, false) AS apart, {bad} AS bad, {some} AS vals FROM f3 LEFT JOIN ne ON ne.key = rid){extra}"""


def _report_sql(columns: str) -> str:
    """The rule report, or the alarms, of flags and dups."""
    rows = [
        (K.RULES["coord_missing"], "count(*) FILTER (WHERE coord_missing)", f"'{K.EXCLUDE}'", "0", "0", "count(*) FILTER (WHERE coord_missing)"),
        (K.RULES["coord_out_of_bbox"], "count(*) FILTER (WHERE out_)", f"'{K.EXCLUDE}'", "0", "0", "count(*) FILTER (WHERE out_)"),
        (
            K.RULES["swap_candidate"], "count(*) FILTER (WHERE swap)", f"'{K.CORRECT} / {K.WARN}'",
            "count(*) FILTER (WHERE fixed)", "0", "count(*) FILTER (WHERE swap AND NOT fixed)"
        ),
        (K.RULES["district_mismatch"], "count(*) FILTER (WHERE apart)", f"'{K.WARN}'", "0", "0", "count(*) FILTER (WHERE apart)"),
        (K.RULES["duplicates"], "any_value(dups)", f"'{K.DROP_COPY} / {K.WARN}'", "0", "any_value(copies)", "any_value(conflicts)"),
        (
            K.RULES["encoding"], "CAST(sum(bad) AS BIGINT)",
            f"CASE WHEN 100.0 * sum(bad) / sum(vals) <= 1 THEN '{K.VERIFIED}' ELSE '{K.CORRECT}' END", "0", "0",
            "CASE WHEN 100.0 * sum(bad) / sum(vals) <= 1 THEN 0 ELSE CAST(sum(bad) AS BIGINT) END"
        ),
    ]
    each = " UNION ALL ".join(
        f"SELECT '{n}' AS regla, {a} AS n_afectados, {act} AS accion, {c}::BIGINT AS n_corregidos, {d}::BIGINT AS n_eliminados, ({w})::BIGINT AS n_warnings, count(*) AS total FROM flags, dups" for n,
        a, act, c, d, w in rows
    )
    return f" SELECT {columns} FROM ({each})"


_FAC_PHASE = _phase_sql(T.RAW_FACILITIES, "COD_IPRESS", "DEPARTAMENTO", "NOMBRE DIRECCION DISTRITO PROVINCIA", "")
_DEM_PHASE = _phase_sql(T.RAW_SETTLEMENTS, "CODCP", "DEP", "NOMCP DIST PROV", "")
_REPORT = "regla, n_afectados, accion, n_corregidos, n_eliminados, n_warnings"
_AUDIT = "{key} AS record_key, conflict AS qc_duplicate_conflicting, coord_missing AS qc_coord_missing, out_ AS qc_coord_out_of_bbox, fixed AS qc_latlon_swap_corrected, swap AND NOT fixed AS qc_latlon_swap_ambiguous, apart AS qc_district_mismatch FROM flags WHERE conflict OR coord_missing OR out_ OR apart"
_ALARMS = "regla, 'ALARM {name}: ' || n_afectados || '/' || total AS alarm"
_OVER = f" WHERE (regla = '{K.RULES['coord_missing']}' AND 100.0 * n_afectados / total > 15) OR (regla = '{K.RULES['coord_out_of_bbox']}' AND 100.0 * n_afectados / total > 5)"


def _facility_phase(spark, sf):
    return phases.process_facilities(T.raw_facilities(spark, sf), _SCOPE, T.strips(spark, sf), order=["k"])


def _demand_phase(spark, sf):
    return phases.process_demand(T.raw_settlements(spark, sf), _SCOPE, T.strips(spark, sf), max_points=200, order=["k"])


@query(
    "v6_facilities",
    f"""{_FAC_PHASE}, normed AS (SELECT *, CATEGORIA AS raw_category, regexp_replace(upper(trim(CATEGORIA)), '\\s*-\\s*', '-', 'g') AS norm FROM flags), c AS (SELECT *, {T.CATEGORY} AS CATEGORIA_NORM, coalesce(upper(trim(ESTADO)) = 'ACTIVO', false) AS is_active FROM normed),
d AS (SELECT *, is_active AND CATEGORIA_NORM IN ('II-1','II-2','II-E','III-1','III-2','III-E') AS is_resolutive FROM c)
SELECT COD_IPRESS, NOMBRE, DEPARTAMENTO, PROVINCIA, DISTRITO, UBIGEO, CATEGORIA, CATEGORIA_NORM, ESTADO, is_active, is_resolutive, is_resolutive AND NOT excluded AS usable_for_routing, excluded AS qc_excluded_from_routing, apart AS qc_district_mismatch, {R("lon")} AS lon, {R("lat")} AS lat FROM d""",
)
def _(spark, sf):
    return _facility_phase(spark, sf)["facilities"]


@query("v6_facility_report", _FAC_PHASE + _report_sql(_REPORT))
def _(spark, sf):
    return _facility_phase(spark, sf)["quality"]


@query("v6_facility_audit", f"{_FAC_PHASE} SELECT 'facilities' AS dataset, {_AUDIT.format(key='COD_IPRESS')}")
def _(spark, sf):
    return _facility_phase(spark, sf)["audit"]


@query("v6_facility_alarms", _FAC_PHASE + _report_sql(_ALARMS.format(name="facilities")) + _OVER)
def _(spark, sf):
    return _facility_phase(spark, sf)["alarms"]


_USABLE = _DEM_PHASE + """, demand AS (SELECT *, UBIGEO AS prov_ FROM flags WHERE NOT excluded), strata AS (SELECT UBIGEO, count(*) AS stratum_n FROM demand GROUP BY UBIGEO), total AS (SELECT sum(stratum_n) AS t FROM strata),
q AS (SELECT UBIGEO, stratum_n, t, CASE WHEN t <= 200 THEN stratum_n ELSE (stratum_n * 200) // t END AS f, CASE WHEN t <= 200 THEN 0 ELSE (stratum_n * 200) % t END AS r FROM strata, total),
quotas AS (SELECT UBIGEO, stratum_n, CAST(f + CASE WHEN t > 200 AND row_number() OVER (ORDER BY r DESC, UBIGEO) <= 200 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q),
drawn AS (SELECT demand.*, stratum_n, quota, row_number() OVER (PARTITION BY UBIGEO ORDER BY CAST('0x' || substr(md5('42:' || CODCP), 1, 15) AS BIGINT), CODCP) AS place FROM demand JOIN quotas USING (UBIGEO))"""


@query(
    "v6_demand",
    f"{_USABLE} SELECT CODCP, DEP, PROV, DIST, UBIGEO, CPINEI, apart AS qc_district_mismatch, stratum_n, quota AS stratum_sample_n, {R('CAST(quota AS DOUBLE) / stratum_n')} AS inclusion_prob, {R('CAST(stratum_n AS DOUBLE) / quota')} AS design_weight, {R('lon')} AS lon, {R('lat')} AS lat FROM drawn WHERE place <= quota"
)
def _(spark, sf):
    d = _demand_phase(spark, sf)["demand"]
    return d.select(
        "CODCP", "DEP", "PROV", "DIST", "UBIGEO", "CPINEI", "qc_district_mismatch", "stratum_n", "stratum_sample_n",
        "inclusion_prob", "design_weight", "lon", "lat"
    )


@query("v6_demand_report", _DEM_PHASE + _report_sql(_REPORT))
def _(spark, sf):
    return _demand_phase(spark, sf)["quality"]


@query("v6_demand_audit", f"{_DEM_PHASE} SELECT 'demand' AS dataset, {_AUDIT.format(key='CODCP')}")
def _(spark, sf):
    return _demand_phase(spark, sf)["audit"]


@query(
    "v6_demand_counts",
    f"{_DEM_PHASE} SELECT (SELECT count(*) FROM raw) AS n_national, (SELECT count(*) FROM scoped) AS n_in_scope, count(*) FILTER (WHERE NOT excluded) AS n_usable FROM flags"
)
def _(spark, sf):
    return _demand_phase(spark, sf)["counts"]


@query("p1_scope", f"WITH {T.RAW_FACILITIES} SELECT COD_IPRESS, NOMBRE FROM raw WHERE upper(DEPARTAMENTO) IN {_SCOPE_SQL}")
def _(spark, sf):
    return filters.scope(T.raw_facilities(spark, sf), "DEPARTAMENTO", _SCOPE).select("COD_IPRESS", "NOMBRE")


@query("p2_study_codes", f"WITH {T.RAW_FACILITIES} SELECT COD_IPRESS, UBIGEO FROM raw WHERE UBIGEO IN ('000003', '000011', '000024')")
def _(spark, sf):
    return filters.by_code(T.raw_facilities(spark, sf), "UBIGEO", ["000003", "000011", "000024"]).select("COD_IPRESS", "UBIGEO")


_LAYER = f"""{T.FACILITIES}, {T.NORMED}, cat AS (SELECT *, {T.CATEGORY} AS category, coalesce(upper(trim(state)) = 'ACTIVO', false) AS is_active FROM normed),
layer AS (SELECT facility_id, category, is_active, category IN ('II-1','II-2','II-E','III-1','III-2','III-E') AND is_active AS is_resolutive, CASE WHEN k % 10 <> 3 THEN 'INST' || k % 4 END AS institution FROM cat)"""


def _layer(spark, sf):
    f = T.facilities(spark, sf).withColumns({"category": X.normalize_category("raw_category"), "is_active": X.is_active("state")})
    f = f.withColumn("is_resolutive", F.col("category").isin(*K.RESOLUTIVE) & F.col("is_active"))
    raw = f.where("k % 10 <> 3").select("facility_id", F.concat(F.lit("INST"), (F.col("k") % 4).cast("string")).alias("INSTITUCION"))
    return f.withColumnRenamed("category", "CATEGORIA_NORM"), raw


@query(
    "j19_facility_layer",
    f"WITH {_LAYER} SELECT facility_id, category, institution, CASE WHEN is_resolutive THEN '{K.LAYER_RESOLUTIVE}' WHEN category IN ('I-3', 'I-4') AND is_active THEN '{K.LAYER_UPGRADE}' ELSE '{K.LAYER_OTHER}' END AS layer_category FROM layer"
)
def _(spark, sf):
    return phases.facility_layer(*_layer(spark, sf), key="facility_id").select(
        "facility_id", F.col("CATEGORIA_NORM").alias("category"), F.col("INSTITUCION").alias("institution"),
        "layer_category"
    )


@query(
    "p13_facility_filter",
    f"""WITH {_LAYER} SELECT 'category' AS chosen, facility_id FROM layer WHERE category IN ('I-4', 'II-1') UNION ALL SELECT 'institution', facility_id FROM layer WHERE institution IN ('INST0', 'INST2')
UNION ALL SELECT 'resolutive', facility_id FROM layer WHERE is_resolutive UNION ALL SELECT 'others', facility_id FROM layer WHERE NOT is_resolutive UNION ALL SELECT 'all', facility_id FROM layer""",
)
def _(spark, sf):
    f, raw = _layer(spark, sf)
    f = phases.attach(
        f.withColumnRenamed("CATEGORIA_NORM", "category"), raw, ["facility_id"], ["INSTITUCION"]
    ).withColumnRenamed("INSTITUCION", "institution")
    kinds = {
        "category": {"categories": ["I-4", "II-1"]}, "institution": {"institutions": ["INST0", "INST2"]},
        "resolutive": {"resolutive": True}, "others": {"resolutive": False}, "all": {"categories": [K.ALL]}
    }
    out = [filters.facilities(f, **kw).select(F.lit(name).alias("chosen"), "facility_id") for name, kw in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


_REPRESENTED = f"""{_LINKED}, rep AS (SELECT *, code IS NULL OR count(*) OVER (PARTITION BY code) = 1 OR demand_id IN ('0000000007', '0000000500') AS is_rep FROM linked)"""


@query(
    "j4_duplicate_key_excluded",
    f"{_REPRESENTED} SELECT demand_id, CASE WHEN match_status = 'matched' AND NOT is_rep THEN '{K.DUPLICATE_EXCLUDED}' ELSE match_status END AS match_status, CASE WHEN match_status = 'matched' AND is_rep THEN population END AS population FROM rep"
)
def _(spark, sf):
    d = _keyed(spark, sf)
    d = d.withColumn("is_representative", _chosen(d))
    return linkage.match_report(
        d, T.population(spark, sf), "code", "code", "pop", representative="is_representative"
    ).select("demand_id", "match_status", "population")


def _chosen(d):
    """Alone in its key, without one, or named."""
    from pyspark.sql.window import Window

    return F.col("code").isNull() | (F.count(F.lit(1)).over(Window.partitionBy("code")) == 1) | F.col("demand_id").isin("0000000007", "0000000500")


@query(
    "a27_kpi_header",
    ORACLE_SQL["a27_kpis"].replace(
        f"WITH {T.DEMAND} SELECT", f"WITH {T.DEMAND}, {_VALUES}, k AS (SELECT"
    ) + f") SELECT k.*, (SELECT {R('min(v)')} FROM run WHERE cw * 2 >= (SELECT sum(w) FROM vals)) AS weighted_median FROM k"
)
def _(spark, sf):
    return access.kpi_header(T.demand(spark, sf), weight="weight")


@query(
    "a26_captured_population",
    "WITH pop AS (SELECT c_custkey, n_name AS dep, 100 + c_custkey % 900 AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 4 <> 0) SELECT dep, o_custkey IS NOT NULL AS matched, count(*) AS n_cp, CAST(sum(pop) AS BIGINT) AS population FROM pop LEFT JOIN d ON c_custkey = o_custkey GROUP BY ALL"
)
def _(spark, sf):
    c = T.read(spark, sf, "customer").join(T.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pop = c.select(F.col("c_custkey").cast("string").alias("code"), F.col("n_name").alias("dep"), (100 + F.col("c_custkey") % 900).alias("pop"))
    demand = T.read(spark, sf, "orders").select(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("c"))
    return phases.captured_population(pop, demand, "dep", "code", "pop", "c")


@query(
    "a30_render_stats",
    f"{_DIST} SELECT count(weighted_mean) AS n, {R('min(weighted_mean)')} AS min_value, {R('max(weighted_mean)')} AS max_value, count(DISTINCT dep) AS n_colors FROM d"
)
def _(spark, sf):
    return geo.render_stats(_districts(spark, sf), "weighted_mean", "dep")


@query(
    "j17_district_status",
    f"{_DIST}, st AS (SELECT dep, prov, dist, {_QUALITY} AS district_status FROM d WHERE prov <> 'NATION_3') SELECT dep, prov, dist, weighted_mean, district_status FROM d LEFT JOIN st USING (dep, prov, dist)"
)
def _(spark, sf):
    keys = ["dep", "prov", "dist"]
    status = _with_quality(spark, sf).where("prov <> 'NATION_3'")
    return phases.attach(_districts(spark, sf), status, keys, ["district_status"]).select(*keys, "weighted_mean", "district_status")


@query(
    "j18_map_layer",
    f"{_DIST}, geo AS (SELECT n_name AS prov, -81.4e0 + 0.5e0 * n_nationkey AS x FROM nation WHERE n_nationkey % 4 <> 0) SELECT dep, prov, dist, weighted_mean, {R('x')} AS min_x FROM d JOIN geo USING (prov)"
)
def _(spark, sf):
    boxes = T.strips(spark, sf).join(
        T.read(spark, sf, "nation").select(
            F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("UBIGEO"), F.col("n_name").alias("prov"),
            "n_nationkey"
        ),
        "UBIGEO"
    ).where("n_nationkey % 4 <> 0")
    out = phases.attach(_districts(spark, sf), boxes, ["prov"], ["rings"], "inner")
    return out.select("dep", "prov", "dist", "weighted_mean", F.array_min(F.transform(F.col("rings")[0], lambda p: p["x"])).alias("min_x"))


@query(
    "j22_candidate_table",
    f"WITH {T.FACILITIES}, scores AS ({ORACLE_SQL['x4_candidate_scores']}) SELECT scores.facility_id, pop_gain_le_60, name, state FROM scores LEFT JOIN facilities USING (facility_id)"
)
def _(spark, sf):
    return phases.attach(
        scenario.candidate_scores(T.demand(spark, sf), T.matrix(spark, sf)), T.facilities(spark, sf), ["facility_id"],
        ["name", "state"]
    ).select("facility_id", "pop_gain_le_60", "name", "state")


_ROUTED = f"{T.MODE_PAIRS}, routed AS (SELECT *, 'routed' AS routing_status FROM nearest), ids AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS demand_id, o_orderkey AS k FROM orders)"


def _routed(spark, sf):
    ids = T.read(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("demand_id"), F.col("o_orderkey").alias("k"))
    return _nearest(spark, sf).withColumn("routing_status", F.lit(K.ROUTED)), ids


@query(
    "u3_with_failed",
    f"WITH {_ROUTED}, m AS (SELECT unnest(['car', 'foot']) AS mode) SELECT ids.demand_id, m.mode, facility_id, coalesce(reachable, false) AS reachable, coalesce(routing_status, 'snap_failed') AS routing_status FROM ids CROSS JOIN m LEFT JOIN routed r ON r.demand_id = ids.demand_id AND r.mode = m.mode"
)
def _(spark, sf):
    rows, ids = _routed(spark, sf)
    return network.with_failed(rows.where("mode <> 'bike'"), ids, ["car", "foot"]).select(
        "demand_id", "mode", "facility_id", "reachable", "routing_status"
    )


_ONE_MODE = "coalesce(max(routing_status) FILTER (WHERE mode = '{m}'), 'snap_failed') AS routing_status_{m}, max(facility_id) FILTER (WHERE mode = '{m}') AS nearest_facility_{m}, round(max(travel_time_min) FILTER (WHERE mode = '{m}'), 6) AS travel_time_min_{m}, round(max(distance_m) FILTER (WHERE mode = '{m}'), 6) AS distance_m_{m}"


@query(
    "j12_status_table",
    f"WITH {_ROUTED} SELECT ids.demand_id, CASE WHEN k % 13 = 0 THEN 'failure' ELSE 'success' END AS snap_status, CAST(k % 700 AS DOUBLE) AS snap_distance_m, {', '.join(_ONE_MODE.format(m=m) for m in ('car', 'bike', 'foot'))} FROM ids LEFT JOIN routed USING (demand_id) GROUP BY ids.demand_id, k"
)
def _(spark, sf):
    rows, ids = _routed(spark, sf)
    snaps = ids.select(
        F.col("demand_id").alias("point_id"),
        F.when(F.col("k") % 13 == 0, "failure").otherwise("success").alias("status"),
        (F.col("k") % 700).cast("double").alias("snap_distance_m")
    )
    return network.status_table(snaps, rows)


@query(
    "g9_snap_group",
    f"{_SNAP.replace('SELECT p.point_id,', 'SELECT p.point_id, j.node_id,')} SELECT point_id, 'facility' AS point_type, status, CASE WHEN status = 'success' THEN node_id END AS routing_node FROM s"
)
def _(spark, sf):
    nodes = _points(spark, sf, "part", "p_partkey").where("lon is not null and lon <> 0")
    return phases.snap_group(
        _points(spark, sf, "supplier", "s_suppkey"), nodes, "facility", "k", "k", 5000.0
    ).select("point_id", "point_type", "status", "routing_node")


@query(
    "g6_track_recovery",
    f"""WITH {_graph_sql(_CAR_OK, f"coalesce(ms, {_CAR})")}, {_PLACES}, iso AS (SELECT range AS node_id FROM range(0, 1500, 3)), has AS (SELECT u AS n FROM g WHERE u % 5 <> 0 AND v % 5 <> 0 UNION SELECT v FROM g WHERE u % 5 <> 0 AND v % 5 <> 0),
p AS (SELECT demand_id, node_id, node_id IN (SELECT n FROM has) AS e, CAST(demand_id AS BIGINT) % 7 = 0 AS r FROM pts WHERE node_id IN (SELECT node_id FROM iso))
SELECT (SELECT count(*) FROM iso) AS n_previously_isolated, count(*) FILTER (WHERE e) AS n_recovers_edges, count(*) FILTER (WHERE r) AS n_recovers_route, count(*) FILTER (WHERE NOT e) AS n_still_isolated FROM p""",
)
def _(spark, sf):
    d, _ = _places(spark, sf)
    e = network.graph(T.edges(spark, sf), "car").where("u % 5 <> 0 and v % 5 <> 0")
    routed = d.withColumn("routing_status", F.when(F.col("demand_id").cast("long") % 7 == 0, K.ROUTED).otherwise(K.NO_ROUTE))
    return network.track_recovery(spark.range(0, 1500, 3).select(F.col("id").alias("node_id")), d, e, routed)


@query(
    "f13_filter_token",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'todos' WHEN doc_id % 5 = 1 THEN 'todos' ELSE array_to_string(list_sort([lang, source, 'x' || doc_id % 3]), '-') END AS token FROM documents"
)
def _(spark, sf):
    i = F.col("doc_id") % 5
    chosen = F.when(
        i == 0, F.array().cast("array<string>")
    ).when(i == 1, F.array(F.lit(K.ALL))).otherwise(F.array("lang", "source", F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"))))
    return T.read(spark, sf, "documents").select("doc_id", X.serialized(chosen).alias("token"))


_SPECIALS = "p_brand || ' 5% & x_ {y} $'"
for _c in "&%$#_{}":
    _SPECIALS = f"replace({_SPECIALS}, '{_c}', chr(92) || '{_c}')"


@query(
    "f14_latex",
    f"SELECT p_partkey, {_SPECIALS} AS escaped, CASE WHEN p_size % 7 = 0 THEN '--' ELSE format('{{:,.1f}}', CAST(p_partkey * 1250 AS DOUBLE)) END AS num FROM part"
)
def _(spark, sf):
    text = F.concat(F.col("p_brand"), F.lit(" 5% & x_ {y} $"))
    return T.read(spark, sf, "part").select(
        "p_partkey", X.latex_escape(text).alias("escaped"),
        X.fmt_num(F.when(F.col("p_size") % 7 != 0, F.col("p_partkey") * 1250)).alias("num")
    )


@query(
    "k5_heads",
    "(SELECT 'facilities' AS part, CAST(s_suppkey AS VARCHAR) AS id FROM supplier ORDER BY s_suppkey LIMIT 5) UNION ALL (SELECT 'demand', CAST(c_custkey AS VARCHAR) FROM customer ORDER BY c_custkey LIMIT 20)"
)
def _(spark, sf):
    h = phases.heads({"facilities": (T.read(spark, sf, "supplier"), "s_suppkey", 5), "demand": (T.read(spark, sf, "customer"), "c_custkey", 20)})
    return h["facilities"].select(
        F.lit("facilities").alias("part"), F.col("s_suppkey").cast("string").alias("id")
    ).unionByName(h["demand"].select(F.lit("demand").alias("part"), F.col("c_custkey").cast("string").alias("id")))


_PHASE3 = f"""WITH {T.DEMAND}, {T.POPULATION}, {_COUNTED}, own AS (SELECT *, CASE WHEN k % 31 <> 0 THEN CAST(CASE WHEN k % 10 = 3 THEN k - 1 ELSE k END AS VARCHAR) END AS code FROM demand),
rep AS (SELECT own.*, code IS NULL OR count(*) OVER (PARTITION BY code) = 1 OR (code = '12' AND demand_id = '0000000012') OR (code = '22' AND demand_id = '0000000023') AS is_rep FROM own),
lk AS (SELECT rep.*, p.pop, CASE WHEN p.n = 1 AND is_rep THEN p.pop * design_weight END AS ht FROM rep LEFT JOIN counted p ON p.code = rep.code),
known AS (SELECT dep, prov, dist, sum(pop) AS known FROM lk WHERE is_rep AND pop IS NOT NULL GROUP BY ALL), fac AS (SELECT dep, prov, dist, coalesce(sum(ht), 0) AS total FROM lk GROUP BY ALL),
da AS (SELECT lk.*, CASE WHEN status = 'routed' THEN t_raw END AS t, CAST(ht AS DOUBLE) * CASE WHEN total > 0 THEN CAST(known AS DOUBLE) / CAST(total AS DOUBLE) END AS cw FROM lk LEFT JOIN fac USING (dep, prov, dist) LEFT JOIN known USING (dep, prov, dist))"""
_CUM = ", ".join(
    f"round(100.0 * coalesce(sum(cw) FILTER (WHERE {c}), 0) / nullif(sum(cw), 0), 6) AS {n}" for c,
    n in (("t <= 30", "pct_le_30"), ("t <= 60", "pct_le_60"), ("t <= 120", "pct_le_120"), ("t > 120", "pct_gt_120"), ("t IS NULL", "pct_no_time"))
)
_CMEAN = "round(sum(CAST(t AS DOUBLE) * cw) / sum(cw) FILTER (WHERE t IS NOT NULL), 6) AS weighted_mean"


def _phase3(spark, sf):
    d = T.demand(spark, sf).withColumn(
        "CPINEI",
        F.when(F.col("k") % 31 != 0, F.when(F.col("k") % 10 == 3, F.col("k") - 1).otherwise(F.col("k")).cast("string"))
    )
    demand = d.select("demand_id", "CPINEI", "dep", "prov", "dist", "design_weight")
    routing = d.select("demand_id", F.col("status").alias("routing_status_car"), F.col("t_raw").alias("travel_time_min_car"))
    areas = d.select("demand_id", "urban_rural")
    return phases.analyse(demand, routing, T.population(spark, sf), areas, demand, override={"12": "0000000012", "22": "0000000023"})


@query(
    "h12_access_by_department",
    f"{_PHASE3} SELECT CASE WHEN grouping(dep) = 1 THEN 'Total' ELSE dep END AS scope, round(sum(cw), 6) AS population, {_CMEAN}, {_CUM} FROM da GROUP BY ROLLUP (dep)"
)
def _(spark, sf):
    return _phase3(spark, sf)["access_by_department"]


@query(
    "phase3_districts",
    f"{_PHASE3} SELECT dep, prov, dist, count(*) AS n_cp, count(cw) AS n_cp_with_weight, {_CMEAN}, {_CUM} FROM da GROUP BY dep, prov, dist"
)
def _(spark, sf):
    out = _phase3(spark, sf)["districts"]
    return out.select(
        "dep", "prov", "dist", "n_cp", "n_cp_with_weight", "weighted_mean", "pct_le_30", "pct_le_60", "pct_le_120",
        "pct_gt_120", "pct_no_time"
    )


@query(
    "h11_macros",
    ORACLE_SQL["a16_summary"].join(
        [
            "WITH one AS (",
            ") SELECT unnest(['n_demand', 'n_matched']) AS name, unnest([format('{:,}', n_demand), format('{:,}', n_matched)]) AS value FROM one"
        ]
    )
)
def _(spark, sf):
    return phases.macros(QUERIES["a16_summary"](spark, sf)).where("name in ('n_demand', 'n_matched')")


@query("u6_audits", f"SELECT * FROM ({ORACLE_SQL['v6_facility_audit']}) UNION ALL SELECT * FROM ({ORACLE_SQL['v6_demand_audit']})")
def _(spark, sf):
    return phases.audits(_facility_phase(spark, sf)["audit"], _demand_phase(spark, sf)["audit"])


@query("a28_facility_panel", f"SELECT regla, n_afectados, accion, 'declared' AS justificacion FROM ({ORACLE_SQL['v6_facility_report']})")
def _(spark, sf):
    both = [
        _facility_phase(spark, sf)["quality"].withColumn("dataset", F.lit("facilities")),
        _demand_phase(spark, sf)["quality"].withColumn("dataset", F.lit("demand"))
    ]
    return filters.facility_quality(both[0].unionByName(both[1]).withColumn("justificacion", F.lit("declared")))


@query(
    "a28_routing_panel",
    f"WITH {_ROUTED}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM pairs WHERE mode = 'car' AND NOT reachable) AS lost FROM ids) SELECT 17e0 AS car_snap_failed, round(100.0 * 17 / n, 6) AS car_snap_failed_pct, CAST(lost AS DOUBLE) AS car_no_route, round(100.0 * lost / n, 6) AS car_no_route_pct, CAST(n AS DOUBLE) AS demand_total FROM c"
)
def _(spark, sf):
    lost = T.mode_pairs(spark, sf).where("mode = 'car' and not reachable").agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("car_no_route_same_department").alias("metric"), "value"
    )
    total = T.read(spark, sf, "orders").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("demand_total").alias("metric"), "value")
    return filters.routing_quality_panel(
        lost.unionByName(total).unionByName(spark.createDataFrame([("car_snap_failed", "17")], "metric string, value string"))
    )


@query(
    "p17_area_categories",
    "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'urban' WHEN c_mktsegment = 'FURNITURE' THEN 'rural' ELSE 'unknown' END AS urban_rural FROM customer"
)
def _(spark, sf):
    c = T.read(spark, sf, "customer")
    return linkage.urban_rural(
        c, c.select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_custkey", "id", "c_mktsegment",
        urban=("BUILDING", "MACHINERY"), rural=("FURNITURE",)
    ).select("c_custkey", "urban_rural")


@query(
    "v8_simplify",
    "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS code, 6 AS n_points, round(-81.4e0 + 0.5e0 * n_nationkey, 6) AS min_x, round(-81.4e0 + 0.5e0 * n_nationkey + 0.5e0, 6) AS max_x, -18.4e0 AS min_y, 0.2e0 AS max_y FROM nation"
)
def _(spark, sf):
    n = T.read(spark, sf, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("code"),
        (-81.4 + 0.5 * F.col("n_nationkey")).alias("x")
    )
    p = lambda dx, y: F.struct((F.col("x") + dx).alias("x"), F.lit(y).alias("y"))
    # points on a straight side, or nearer to it than the tolerance, go; the roof's top stays
    ring = F.array(p(0.0, -18.4), p(0.1, -18.4), p(0.3, -18.4005), p(0.5, -18.4), p(0.5, -9.0), p(0.5, 0.0), p(0.25, 0.2), p(0.0, 0.0), p(0.0, -18.4))
    done = geo.simplify(n.select("code", F.array(ring).alias("rings"))).select("code", F.col("rings")[0].alias("r"))
    of = lambda f, c: f(F.transform("r", lambda q: q[c]))
    return done.select(
        "code", F.size("r").alias("n_points"), of(F.array_min, "x").alias("min_x"), of(F.array_max, "x").alias("max_x"),
        of(F.array_min, "y").alias("min_y"), of(F.array_max, "y").alias("max_y")
    )


@query(
    "a17_track_impact",
    "WITH a AS (SELECT count(*) FILTER (WHERE o_orderkey % 20 > 5) AS before, count(*) FILTER (WHERE o_orderkey % 20 > 3) AS after FROM orders) SELECT before, after, after - before AS gain, round(100.0 * (after - before) / before, 6) AS gain_pct FROM a"
)
def _(spark, sf):
    one = T.read(spark, sf, "orders").agg(
        F.count_if(F.col("o_orderkey") % 20 > 5).alias("b"), F.count_if(F.col("o_orderkey") % 20 > 3).alias("a")
    ).first()
    return spark.createDataFrame([access.track_impact(one.b, one.a)], "before long, after long, gain long, gain_pct double")
