"""Ordered statistics over weights. Rows are first summed by value and stored once, then numbered in two steps: sums of value
ranges, and running sums within a range, so no task sorts a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X


def by_value(df: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group and value: v, w. Ties don't matter to what follows; only positive weights count."""
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull() & (F.col(weight) > 0))
    return rows.groupBy(*groups, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))


def _range(v: Column, cuts: Sequence[float], at: int = 0) -> Column:
    """The number of cuts that are less than v, as a balanced tree of comparisons (compiled, unlike a fold over an array)."""
    if not cuts:
        return F.lit(at)
    k = len(cuts) // 2
    return F.when(v > cuts[k], _range(v, cuts[k + 1 :], at + k + 1)).otherwise(_range(v, cuts[:k], at))


def running(rows: DataFrame, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """rows (v, w) with cw, cwv: sums up to and with v, in order of v, and tw, twv: those of all.

    Values are cut into buckets at approximate quantiles; running sums are taken within a bucket, and what the buckets
    before it hold, one row a bucket and group, is added: the sort is spread over buckets, as many as there are shuffle
    partitions unless told, and the result is exact."""
    from ..sources import io

    io.checkpoint_dir(rows.sparkSession)
    buckets = buckets or max(8, min(1024, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.checkpoint()  # read three times below
    wv = F.col("w") * F.col("v")
    found = rows.agg(F.percentile_approx(F.col("v").cast("double"), [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first().q or []
    dealt = rows.withColumn("_b", _range(F.col("v").cast("double"), sorted(set(found))))
    sums = dealt.groupBy(*groups, "_b").agg(F.sum("w").alias("sw"), F.sum(wv).alias("swv"))  # at most `buckets` rows a group
    all_ = Window.partitionBy(*groups)
    before = all_.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *groups, "_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("sw", "swv")),
        F.sum("sw").over(all_).alias("tw"), F.sum("swv").over(all_).alias("twv")
    )
    within = Window.partitionBy(*groups, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("cw", F.sum("w").over(within)).withColumn("cwv", F.sum(wv).over(within))
    out = dealt.join(sums if groups else F.broadcast(sums), [*groups, "_b"])
    return out.withColumn("cw", F.col("cw") + F.col("_sw")).withColumn("cwv", F.col("cwv") + F.col("_swv")).drop("_b", "_sw", "_swv")


def weighted_median(df: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """The lower weighted median: the first value whose running weight reaches half of all."""
    rows = running(by_value(df, value, weight, groups), groups)
    return rows.groupBy(*groups).agg(F.min(F.when(F.col("cw") * 2 >= F.col("tw"), F.col("v"))).alias("weighted_median"))


def weighted_gini(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: gini (trapezoid; 1 where all values are 0, null without rows), n_included, population_included, and the share of
    weight left out for want of a value (W2)."""
    rows = running(by_value(df, value, weight))
    wv = F.col("w") * F.col("v")
    area = F.sum(F.col("w").cast("double") * (2 * F.col("cwv") - wv).cast("double"))
    sums = rows.agg(area.alias("a"), F.max("tw").alias("sw"), F.max("twv").alias("swv"))
    w = F.col(weight)
    has = F.col(value).isNotNull() & (w > 0)
    counts = df.agg(
        F.count_if(has).alias("n_included"), F.coalesce(F.sum(F.when(has, w)), F.lit(0)).alias("population_included"),
        F.sum(F.when(w > 0, w)).alias("_all")
    )
    gini = F.when(F.col("swv") == 0, F.lit(1.0)).otherwise(1 - X.ratio(F.col("a"), F.col("sw").cast("double") * F.col("swv").cast("double")))
    left_out = 100.0 - X.percent(F.col("population_included"), F.nullif("_all", F.lit(0)))
    return sums.crossJoin(F.broadcast(counts)).select(
        gini.alias("gini"), "n_included", "population_included", left_out.alias("pct_population_excluded")
    )


def lorenz_curve(df: DataFrame, value: str, weight: str) -> DataFrame:
    """ord, cum_population, cum_value from (0, 0) on, a point per value; empty without rows."""
    rows = running(by_value(df, value, weight))
    points = rows.select(
        F.col("v").cast("double").alias("ord"), X.ratio(F.col("cw"), F.col("tw")).alias("cum_population"),
        X.ratio(F.col("cwv"), F.col("twv")).alias("cum_value")
    )
    origin = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(-1.0).alias("ord"), F.lit(0.0).alias("cum_population"), F.lit(0.0).alias("cum_value")
    )
    return origin.unionByName(points)


def weighted_ecdf(df: DataFrame, value: str, weight: str, groups: Sequence[str]) -> DataFrame:
    """Cumulative share of weight by value within each group."""
    rows = running(by_value(df, value, weight, groups), groups)
    return rows.select(*groups, "v", X.percent(F.col("cw"), F.col("tw")).alias("cum_pct"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """A row for each row that has a value, in order i / n of all; rows of one value have the shares of their places."""
    rows = running(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w")))
    places = F.explode(F.sequence(F.col("cw") - F.col("w") + 1, F.col("cw"))).alias("i")
    return rows.select("v", "tw", places).select("v", X.ratio(F.col("i"), F.col("tw")).alias("share"))


def rank_gaps(
    df: DataFrame, keys: Sequence[str], mean: str = "weighted_mean", share: str = "share_with_time_pct",
    least_share: float = 50.0
) -> DataFrame:
    """All districts, longest mean first, unknown means before all; a warning where too little is known (W6). Districts are areas:
    the window without a partition sorts one row for each."""
    order = Window.orderBy(F.col(mean).desc_nulls_first(), *keys)
    warn: Column = F.col(share).isNull() | (F.col(share) < least_share)
    return df.withColumn("rank", F.row_number().over(order)).withColumn("low_coverage_warning", warn)


def split_gaps(df: DataFrame, keys: Sequence[str], status: str = "district_status", mean: str = "weighted_mean") -> tuple[DataFrame, DataFrame]:
    """Districts that can be ranked, with ranks; and the rest."""
    from .. import constants as K

    good = df.where((F.col(status) == K.COMPUTABLE) & F.col(mean).isNotNull())
    ranked = good.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(mean), *keys)))
    return ranked, df.where(~((F.col(status) == K.COMPUTABLE) & F.col(mean).isNotNull())).orderBy(status, *keys)


def worst_district(df: DataFrame, keys: Sequence[str], mean: str = "weighted_mean") -> DataFrame:
    """The first of the ranked (K4); no sort, one aggregate."""
    best = F.max_by(F.struct(*keys, F.col(mean)), F.col(mean))
    return df.where(F.col(mean).isNotNull()).agg(best.alias("r")).where("r is not null").select("r.*")


def rank_candidates(df: DataFrame, by: str, key: str, n: int, ascending: bool = False) -> DataFrame:
    """The first n by a score, with their rank."""
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), F.col(key)]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
