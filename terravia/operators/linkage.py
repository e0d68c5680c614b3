"""Linking settlements to population records without counting anybody twice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X


def match_report(
    demand: DataFrame, pop: DataFrame, key: str, pop_key: str, pop_value: str, secondary: str | None = None,
    representative: str | None = None
) -> DataFrame:
    """demand with n_population_records, population, match_status, match_method [, secondary_key_disagrees].

    The records of a key are counted before the join, so no row is multiplied; a key with several records is
    ambiguous and links to none."""
    records = pop.groupBy(F.col(pop_key).cast("string").alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.first(pop_value, ignorenulls=True).alias("_v")
    )
    own = F.col(key).cast("string")
    df = demand.join(records, own == F.col("_k"), "left")
    none = own.isNull() | (own == "")
    n = F.when(none, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    status = F.when(n == 1, K.MATCHED).when(n > 1, K.AMBIGUOUS).otherwise(K.UNMATCHED)
    if representative:
        status = F.when((n == 1) & ~F.col(representative), K.DUPLICATE_EXCLUDED).otherwise(status)
    df = df.withColumns({"n_population_records": n, "match_method": F.when(none, "no_key").otherwise("primary_key"), "match_status": status})
    df = df.withColumn("population", F.when(F.col("match_status") == K.MATCHED, F.col("_v"))).drop("_k", "_n", "_v")
    if secondary:
        other = F.col(secondary).cast("string")
        known = pop.select(F.col(pop_key).cast("string").alias("_s")).distinct()
        df = df.join(known, other == F.col("_s"), "left")
        flag = F.coalesce(other.isNotNull() & (other != own) & F.col("_s").isNotNull(), F.lit(False))
        df = df.withColumn("secondary_key_disagrees", flag).drop("_s")
    return df


def flag_representative(df: DataFrame, key: str, id_col: str, override: Mapping[str, str] | None = None) -> DataFrame:
    """is_representative: a unique or null key is; of a shared key only the id that override names."""
    several = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    named = F.lit(None).cast("string")
    if override:
        named = F.try_element_at(F.create_map(*(F.lit(x) for kv in override.items() for x in kv)), F.col(key).cast("string"))
    chosen = F.coalesce(named == F.col(id_col).cast("string"), F.lit(False))
    out = df.join(several, F.col(key) == F.col("_k"), "left")  # a null key meets nothing, so null keys need not come together
    return out.withColumn("is_representative", F.col("_n").isNull() | chosen).drop("_k", "_n")


def population_universe(df: DataFrame, pop: DataFrame, key: str, pop_key: str, pop_value: str) -> DataFrame:
    """Representative rows whose key has a record, its population, and how many rows share the key."""
    first = pop.groupBy(F.col(pop_key).alias("_k")).agg(F.first(pop_value, ignorenulls=True).alias("population"))
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n_rows_for_key"))
    return df.where("is_representative").join(counts.join(first, "_k"), F.col(key) == F.col("_k")).select(*df.columns, "n_rows_for_key", "population")


def duplicate_resolution(df: DataFrame, key: str, id_col: str, lon: str, lat: str) -> DataFrame:
    """A row per key that several rows share: how many, their ids, and their distance where they are two."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(lon).alias("x"), F.col(lat).alias("y")))).alias("r")
    ).where(F.size("r") > 1)
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    metres = F.when(F.size("r") == 2, X.haversine_m(a["x"], a["y"], b["x"], b["y"]))
    return rows.select(
        key, F.size("r").cast("long").alias("n_rows"),
        F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"), metres.alias("distance_m")
    )


def cross_validate(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str) -> DataFrame:
    """The keys both sources have, with diff_abs and diff_pct (null where a is 0)."""
    both = a.select(F.col(key).alias("_k"), F.col(value_a).alias("value_a")).join(
        b.select(F.col(key).alias("_k2"), F.col(value_b).alias("value_b")), F.col("_k") == F.col("_k2")
    )
    diff = F.col("value_b") - F.col("value_a")
    return both.select(
        F.col("_k").alias(key), "value_a", "value_b", F.abs(diff).alias("diff_abs"),
        (100.0 * X.ratio(diff, F.col("value_a"))).alias("diff_pct")
    )


def cross_validation_summary(pairs: DataFrame) -> DataFrame:
    same = F.col("diff_abs") == 0
    return pairs.agg(
        F.count(F.lit(1)).alias("n_common"), F.count_if(same).alias("n_identical"),
        F.count_if(~same).alias("n_discrepant"), F.max("diff_abs").alias("max_diff"),
        F.percentile("diff_abs", F.lit(0.5)).alias("median_diff"), F.stddev_samp("diff_abs").alias("std_diff")
    )


def top_discrepant(pairs: DataFrame, key: str, n: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("diff_abs"), key).limit(n)


def population_control(matched: DataFrame, benchmark: DataFrame, dep: str, value: str, benchmark_value: str) -> DataFrame:
    """Observed against benchmark population by department, from either side."""
    seen = matched.where(F.col(dep).isNotNull()).groupBy(F.col(dep).alias("_d")).agg(F.sum(value).alias("observed"))
    out = seen.join(benchmark.select(F.col(dep).alias("_b"), F.col(benchmark_value).alias("benchmark")), F.col("_d") == F.col("_b"), "full_outer")
    return out.select(
        F.coalesce("_d", "_b").alias(dep), "observed", "benchmark",
        X.percent(F.col("observed"), F.col("benchmark")).alias("captured_pct")
    )


def urban_rural(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, area: str, urban=(1,), rural=(2,)) -> DataFrame:
    """urban, rural or unknown by a lookup of one row per key."""
    one = lookup.groupBy(F.col(lookup_key).cast("string").alias("_k")).agg(F.min(area).alias("_a"))
    out = df.join(one, F.col(key).cast("string") == F.col("_k"), "left")
    return out.withColumn(
        "urban_rural",
        F.when(F.col("_a").isin(*urban), K.URBAN).when(F.col("_a").isin(*rural), K.RURAL).otherwise(K.UNKNOWN)
    ).drop("_k", "_a")


def merged(df: DataFrame, other: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """df left-joined with other by a key taken as text; other columns that both have get the suffixes. Null keys are equal and
    rows of equal key are paired, as in the reference."""
    both = {c.lower() for c in df.columns} & {c.lower() for c in other.columns} - {key.lower()}

    def named(c: str, suffix: str):
        return F.col(f"`{c}`").alias(c + suffix if c.lower() in both else c)

    own = df.select(*(F.col(c).cast("string").alias(c) if c == key else named(c, suffixes[0]) for c in df.columns))
    theirs = other.select(F.col(key).cast("string").alias("_k"), *(named(c, suffixes[1]) for c in other.columns if c != key))
    return own.join(theirs, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def demand_analysis(
    demand: DataFrame, routing: DataFrame, weights: DataFrame, areas: DataFrame, key: str = "demand_id",
    status: str = "routing_status_car", time: str = "travel_time_min_car"
) -> DataFrame:
    """The master table: demand with its routing (clashing names end in _routing), its population and analysis_weight, its
    urban_rural (unknown where there is none), t_min and ht_population_weight; no demand row is lost (J10)."""
    linked = weights.select(key, "population", "population_match_status", "analysis_weight")
    df = merged(merged(merged(demand, routing, key, ("", "_routing")), linked, key), areas, key)
    return df.withColumns(
        {
            "urban_rural": F.coalesce("urban_rural", F.lit(K.UNKNOWN)), "t_min": X.access_time(status, time),
            "ht_population_weight": F.col("analysis_weight")
        }
    )


def unmatched_kinds(df: DataFrame, key: str, secondary: str, pop: DataFrame, pop_key: str) -> DataFrame:
    """Unmatched rows: A no key, C the secondary key would match, B the rest."""
    keys = pop.select(F.col(pop_key).cast("string").alias("_k")).distinct()
    rows = df.where(F.col("match_status") == K.UNMATCHED).join(keys, F.col(secondary).cast("string") == F.col("_k"), "left")
    return rows.withColumn("unmatched_kind", F.when(F.col(key).isNull(), "A").when(F.col("_k").isNotNull(), "C").otherwise("B")).drop("_k")
