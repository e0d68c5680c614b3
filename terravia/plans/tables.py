"""The domain's tables as the driver's tables give them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals as doubles, doubles rounded: sums above are exact, so both engines agree."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        out.append((F.round(c.cast("double"), digits) if kind.startswith("decimal") or kind == "double" else c).alias(f.name))
    return df.select(*out)


def minutes(c: Column) -> Column:
    return (F.floor(c) / 100).cast("decimal(12,2)")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand points: orders, placed by their customer; t_min null where not routed, weight null where not linked."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col("o_orderkey")
    status = F.when(k % 20 == 0, "snap_failed").when(k % 20 <= 3, "no_route_same_department").otherwise("routed")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.lpad(
            k.cast("string"), 10, "0"
        ).alias("demand_id"), F.col("r_name").alias("dep"), F.col("n_name").alias("prov"), F.col("c_mktsegment").alias("dist"), k.alias("k"), F.col("o_custkey").alias("c"),
        status.alias("status"), minutes(F.col("o_totalprice") / 25).alias("t_raw"), F.when(
            status == "routed", minutes(F.col("o_totalprice") / 25)
        ).alias("t_min"), (1 + k % 7).alias("design_weight"),
        F.when(
            F.col("o_custkey") % 7 != 0, 1 + k % 7
        ).alias("weight"), F.when(k % 3 == 0, "urban").when(k % 3 == 1, "rural").otherwise("unknown").alias("urban_rural"),
    )


DEMAND = """demand AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS demand_id, r_name AS dep, n_name AS prov, c_mktsegment AS dist, o_orderkey AS k, o_custkey AS c,
  CASE WHEN o_orderkey % 20 = 0 THEN 'snap_failed' WHEN o_orderkey % 20 <= 3 THEN 'no_route_same_department' ELSE 'routed' END AS status,
  CAST(floor(o_totalprice / 25) / 100e0 AS DECIMAL(12,2)) AS t_raw,
  CASE WHEN o_orderkey % 20 > 3 THEN CAST(floor(o_totalprice / 25) / 100e0 AS DECIMAL(12,2)) END AS t_min,
  1 + o_orderkey % 7 AS design_weight, CASE WHEN o_custkey % 7 <> 0 THEN 1 + o_orderkey % 7 END AS weight,
  CASE o_orderkey % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'rural' ELSE 'unknown' END AS urban_rural
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population records: customers but each seventh, each eleventh twice."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").cast("string").alias("code"), (100 + F.col("c_custkey") % 900).alias("pop")
    )
    return c.unionByName(c.where("cast(code as bigint) % 11 = 0"))


POPULATION = """population AS (SELECT CAST(c_custkey AS VARCHAR) AS code, 100 + c_custkey % 900 AS pop FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 100 + c_custkey % 900 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0)"""

_RAW = ("I-1", "I-2", "I-3", "I-4", "II-1", "II-2", "II-E", "III-1", " ii - 1 ", "iii-e", "0", None, "IV-9")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities: suppliers with categories as they are written, states and coordinates, some of these damaged."""
    k = F.col("s_suppkey")
    raw = F.get(F.array(*(F.lit(x) for x in _RAW)), (k % 13).cast("int"))
    state = F.when(k % 5 == 0, "BAJA DEFINITIVA").when(k % 5 == 1, " activo ").otherwise("ACTIVO")
    rows = read(spark, sf_dir, "supplier").select(
        F.lpad(k.cast("string"), 6, "0").alias("facility_id"), k.alias("k"), raw.alias("raw_category"),
        state.alias("state"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("s_nationkey")
    )
    return located(rows)


def located(rows: DataFrame) -> DataFrame:
    """lon and lat from k: each 50th none, each 41st zero, each 37th exchanged, each 29th far away."""
    k = F.col("k")
    x = -81.4 + 12.8 * ((k * 37) % 1000) / 1000.0
    y = -18.4 + 18.4 * ((k * 91) % 1000) / 1000.0
    pick = lambda own, other, far: F.when(k % 50 == 0, F.lit(None).cast("double")).when(k % 41 == 0, F.lit(0.0)).when(k % 37 == 0, other).when(k % 29 == 0, F.lit(far)).otherwise(own)
    return rows.withColumns({"lon": pick(x, y, 10.0), "lat": pick(y, x, 50.0)})


_CASES = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(_RAW))


def located_sql(k: str) -> str:
    x, y = f"(-81.4e0 + 12.8e0 * (({k} * 37) % 1000) / 1000e0)", f"(-18.4e0 + 18.4e0 * (({k} * 91) % 1000) / 1000e0)"
    pick = lambda own, other, far: f"CASE WHEN {k} % 50 = 0 THEN NULL WHEN {k} % 41 = 0 THEN 0e0 WHEN {k} % 37 = 0 THEN {other} WHEN {k} % 29 = 0 THEN {far}e0 ELSE {own} END"
    return f"{pick(x, y, 10)} AS lon, {pick(y, x, 50)} AS lat"


FACILITIES = f"""facilities AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS facility_id, s_suppkey AS k, CASE s_suppkey % 13 {_CASES} END AS raw_category,
  CASE WHEN s_suppkey % 5 = 0 THEN 'BAJA DEFINITIVA' WHEN s_suppkey % 5 = 1 THEN ' activo ' ELSE 'ACTIVO' END AS state, s_name AS name, s_nationkey, {located_sql("s_suppkey")} FROM supplier)"""

CATEGORY = """CASE WHEN raw_category IS NULL OR norm IN ('', '0', 'NAN', 'NONE', 'SIN CATEGORIA', 'SIN CATEGORÍA') THEN 'SIN_CATEGORIA'
  WHEN norm IN ('I-1','I-2','I-3','I-4','II-1','II-2','II-E','III-1','III-2','III-E') THEN norm ELSE 'DESCONOCIDA' END"""
NORMED = "normed AS (SELECT *, regexp_replace(upper(trim(raw_category)), '\\s*-\\s*', '-', 'g') AS norm FROM facilities)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel times: order and supplier of each line, the least price of the two as minutes."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_extendedprice").alias("p"))
    return rows.select(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("demand_id"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("facility_id"),
        minutes(F.col("p") / 10).alias("travel_time_min")
    )


MATRIX = """matrix AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS demand_id, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS facility_id,
  CAST(floor(min(l_extendedprice) / 10) / 100e0 AS DECIMAL(12,2)) AS travel_time_min FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def mode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand, facility, mode (by line number), time and distance; some pairs unreachable."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("m")).agg(
        F.min("l_extendedprice").alias("p"), F.min("l_returnflag").alias("f")
    )
    mode = F.when(F.col("m") == 0, "car").when(F.col("m") == 1, "bike").otherwise("foot")
    ok = F.col("f") != "R"
    return rows.select(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("demand_id"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("facility_id"), mode.alias("mode"),
        F.when(ok, F.floor(F.col("p") / 10) / 100).alias("travel_time_min"),
        F.when(ok, F.floor("p").cast("double")).alias("distance_m"), ok.alias("reachable")
    )


MODE_PAIRS = """pairs AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS demand_id, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS facility_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'bike' ELSE 'foot' END AS mode, CASE WHEN min(l_returnflag) <> 'R' THEN floor(min(l_extendedprice) / 10) / 100e0 END AS travel_time_min,
  CASE WHEN min(l_returnflag) <> 'R' THEN floor(min(l_extendedprice)) END AS distance_m, min(l_returnflag) <> 'R' AS reachable FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linenumber % 3),
nearest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY demand_id, mode ORDER BY travel_time_min, facility_id) AS rn FROM pairs WHERE reachable) WHERE rn = 1)"""

_HIGHWAYS = ("motorway", "primary", "residential", "track", "steps", "cycleway", "trunk_link")
_SPEEDS = ("60", "60 km/h", "50;40", "signals", None, "30 mph", "50-60", "abc", " 20 ")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments: a line joins its part's node to its supplier's; tags from the line."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.groupBy(
        F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 997).alias("u"),
        (F.col("l_suppkey") * 7 % 997).alias("v")
    ).agg(F.min("l_linenumber").alias("ln"), F.min("l_returnflag").alias("rf"), F.min("l_quantity").cast("int").alias("q"))
    pick = lambda xs, c: F.get(F.array(*(F.lit(x) for x in xs)), (c % len(xs)).cast("int"))
    return rows.select(
        "id", "u", "v", pick(_HIGHWAYS, F.col("ln")).alias("highway"), F.when(
            F.col("rf") == "A", "yes"
        ).when(F.col("rf") == "R", "-1").alias("oneway"), pick(_SPEEDS, F.col("q")).alias("maxspeed"),
        F.when(F.col("q") % 10 == 0, "no").alias("access"), F.when(
            F.col("q") % 7 == 0, "roundabout"
        ).alias("junction"), F.when(F.col("q") % 3 == 0, "yes").when(F.col("q") % 11 == 0, "no").alias("bicycle"),
        F.when(F.col("q") % 4 == 0, "yes").when(F.col("q") % 13 == 0, "no").alias("foot"), (100.0 + (F.col("id") % 50) * 10).alias("length"),
    )


def _pick_sql(xs, c):
    return f"CASE {c} % {len(xs)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(xs)) + " END"


EDGES = f"""lines AS (SELECT l_orderkey AS id, l_partkey % 997 AS u, l_suppkey * 7 % 997 AS v, min(l_linenumber) AS ln, min(l_returnflag) AS rf, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY ALL),
edges AS (SELECT id, u, v, {_pick_sql(_HIGHWAYS, "ln")} AS highway, CASE rf WHEN 'A' THEN 'yes' WHEN 'R' THEN '-1' END AS oneway, {_pick_sql(_SPEEDS, "q")} AS maxspeed, CASE WHEN q % 10 = 0 THEN 'no' END AS access,
  CASE WHEN q % 7 = 0 THEN 'roundabout' END AS junction, CASE WHEN q % 3 = 0 THEN 'yes' WHEN q % 11 = 0 THEN 'no' END AS bicycle, CASE WHEN q % 4 = 0 THEN 'yes' WHEN q % 13 = 0 THEN 'no' END AS foot, 100e0 + (id % 50) * 10 AS length FROM lines)"""


def raw_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility records as a register has them: some twice, some twice with another name, some wrongly decoded; two of three declare
    the district (a strip of half a degree) that they lie in."""
    f = facilities(spark, sf_dir)
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col("k")
    own = F.least(F.floor(12.8 * ((k * 37) % 1000) / 1000.0 / 0.5), F.lit(24))
    rows = f.join(n, f.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("facility_id").alias("COD_IPRESS"), F.when(
            k % 19 == 0, F.lit("SEÃ‘OR")
        ).otherwise(F.col("name")).alias("NOMBRE"), F.col("r_name").alias("DEPARTAMENTO"), F.col("n_name").alias("PROVINCIA"),
        F.concat(F.lit("D"), (k % 10).cast("string")).alias("DISTRITO"), F.lpad(
            F.when(k % 3 != 0, own).otherwise(F.col("s_nationkey")).cast("string"), 6, "0"
        ).alias("UBIGEO"), F.lit(None).cast("string").alias("DIRECCION"),
        F.col("raw_category").alias("CATEGORIA"), F.col("state").alias("ESTADO"), F.col("lat").cast("string").alias("NORTE"), F.col("lon").cast("string").alias("ESTE"), k.alias("k"),
    )
    twice = rows.where("k % 17 = 0").unionByName(rows.where("k % 23 = 0").withColumn("NOMBRE", F.lit("OTRO")))
    return rows.unionByName(twice)


_STRIP = "lpad(CAST(CASE WHEN {k} % 3 <> 0 THEN least(CAST(floor(12.8e0 * (({k} * 37) % 1000) / 1000e0 / 0.5e0) AS BIGINT), 24) ELSE n_nationkey END AS VARCHAR), 6, '0')"
RAW_FACILITIES = f"""{FACILITIES}, rows_ AS (SELECT facility_id AS COD_IPRESS, CASE WHEN k % 19 = 0 THEN 'SEÃ‘OR' ELSE name END AS NOMBRE, r_name AS DEPARTAMENTO, n_name AS PROVINCIA, 'D' || (k % 10) AS DISTRITO, {_STRIP.format(k="k")} AS UBIGEO,
  CAST(NULL AS VARCHAR) AS DIRECCION, raw_category AS CATEGORIA, state AS ESTADO, lat, lon, k FROM facilities JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT * FROM rows_ UNION ALL SELECT * FROM rows_ WHERE k % 17 = 0 UNION ALL SELECT * REPLACE ('OTRO' AS NOMBRE) FROM rows_ WHERE k % 23 = 0)"""


def raw_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements as a register has them, made from customers in the same way."""
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col("k")
    own = F.least(F.floor(12.8 * ((k * 37) % 1000) / 1000.0 / 0.5), F.lit(24))
    rows = located(c.withColumn("k", F.col("c_custkey"))).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = rows.select(
        F.lpad(
            k.cast("string"), 8, "0"
        ).alias("CODCP"), F.col("c_name").alias("NOMCP"), F.col("r_name").alias("DEP"), F.col("n_name").alias("PROV"), F.col("c_mktsegment").alias("DIST"),
        F.lpad(
            F.when(k % 3 != 0, own).otherwise(F.col("n_nationkey")).cast("string"), 6, "0"
        ).alias("UBIGEO"), F.col("lon").alias("XGD"), F.col("lat").alias("YGD"), F.when(k % 5 != 0, k.cast("string")).alias("CPINEI"), k.alias("k"),
    )
    return rows.unionByName(rows.where("k % 17 = 0")).unionByName(rows.where("k % 23 = 0").withColumn("NOMCP", F.lit("OTRO")))


RAW_SETTLEMENTS = f"""located AS (SELECT *, c_custkey AS k, {located_sql("c_custkey")} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rows_ AS (SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS CODCP, c_name AS NOMCP, r_name AS DEP, n_name AS PROV, c_mktsegment AS DIST, {_STRIP.format(k="k")} AS UBIGEO, lon, lat, CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) END AS CPINEI, k FROM located),
raw AS (SELECT * FROM rows_ UNION ALL SELECT * FROM rows_ WHERE k % 17 = 0 UNION ALL SELECT * REPLACE ('OTRO' AS NOMCP) FROM rows_ WHERE k % 23 = 0)"""


def strips(spark: SparkSession, sf_dir: str, code: str = "UBIGEO") -> DataFrame:
    """A district per nation: strips of half a degree, side by side."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", (-81.4 + 0.5 * F.col("n_nationkey")).alias("x"))
    p = lambda dx, y: F.struct((F.col("x") + dx).alias("x"), F.lit(y).alias("y"))
    return n.select(
        F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias(code),
        F.array(F.array(p(0.0, -18.4), p(0.5, -18.4), p(0.5, 0.0), p(0.0, 0.0))).alias("rings")
    )


def utm_sql(name: str, source: str, lon: str, lat: str) -> str:
    """Tables ending in `name`: the rows of source with ux, uy, their coordinates in UTM zone 18 south."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    scale = 0.9996 * 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    x = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    y = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return f"""{name}1 AS (SELECT *, sin(radians({lat})) AS s_, radians({lon} + 75e0) AS l_ FROM {source}), {name}2 AS (SELECT *, sinh(atanh(s_) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s_)) AS t_ FROM {name}1),
{name}3 AS (SELECT *, atan2(t_, cos(l_)) AS xi, atanh(sin(l_) / sqrt(1 + t_ * t_)) AS eta FROM {name}2), {name} AS (SELECT * EXCLUDE (s_, l_, t_, xi, eta), 500000e0 + {scale!r}::DOUBLE * ({x}) AS ux, 10000000e0 + {scale!r}::DOUBLE * ({y}) AS uy FROM {name}3)"""


#: code, ax, ay, ex, ey: the edges of the strips in metres.
STRIPS = f"""corner AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS code, i, -81.4e0 + 0.5e0 * n_nationkey + CASE WHEN i IN (1, 2) THEN 0.5e0 ELSE 0e0 END AS clon, CASE WHEN i < 2 THEN -18.4e0 ELSE 0e0 END AS clat FROM nation, range(4) r(i)),
{utm_sql("cu", "corner", "clon", "clat")}, side AS (SELECT a.code, a.ux AS ax, a.uy AS ay, b.ux AS ex, b.uy AS ey FROM cu a JOIN cu b ON a.code = b.code AND b.i = (a.i + 1) % 4)"""


def near_sql(name: str, source: str, key: str, lon: str, lat: str) -> str:
    """Table `name`: key, near: whether points with a known district are in it or nearer than 1000 m."""
    return f"""{name}_in AS (SELECT DISTINCT {key} AS key, code, {lon} AS plon, {lat} AS plat FROM {source} WHERE {lon} IS NOT NULL AND {lat} IS NOT NULL AND abs({lat}) < 90), {utm_sql(f"{name}_u", f"{name}_in", "plon", "plat")},
{name}_d AS (SELECT key, u.code, plon, plat, ux, uy, ax, ay, ex - ax AS dx, ey - ay AS dy, least(greatest(((ux - ax) * (ex - ax) + (uy - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) AS t FROM {name}_u u JOIN side ON side.code = u.code),
{name} AS (SELECT key, any_value(plon >= -81.4e0 + 0.5e0 * CAST(code AS INTEGER) AND plon < -81.4e0 + 0.5e0 * CAST(code AS INTEGER) + 0.5e0 AND plat >= -18.4e0 AND plat < 0e0) OR min(sqrt(pow(ux - ax - t * dx, 2) + pow(uy - ay - t * dy, 2))) < 1000 AS near FROM {name}_d GROUP BY key)"""
