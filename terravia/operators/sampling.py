"""Proportional stratified sampling with design weights; quotas in whole numbers, without loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quotas(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """strata with quota: everything where n is at least the total, else largest remainders (ties by key).

    The total is one aggregate; the extra units go by rank of remainder, and strata are few (one row each), so the
    one window without a partition sorts strata, not records."""
    total = strata.agg(F.sum(size).alias("_total"))
    df = strata.crossJoin(F.broadcast(total))
    product = (F.col(size) * F.lit(n)).cast("decimal(38,0)")
    df = df.withColumn(
        "_floor",
        F.when(F.col("_total") <= n, F.col(size)).otherwise(F.expr(f"cast(floor(cast({size} as decimal(38,0)) * {n} / _total) as bigint)"))
    )
    df = df.withColumn("_rest", F.when(F.col("_total") <= n, F.lit(0)).otherwise(product - F.col("_floor") * F.col("_total")).cast("decimal(38,0)"))
    left = df.agg((F.lit(n) - F.sum("_floor")).alias("_left"))
    nth = F.row_number().over(Window.orderBy(F.desc("_rest"), F.col(key)))
    df = df.crossJoin(F.broadcast(left)).withColumn("_nth", nth)
    extra = ((F.col("_total") > n) & (F.col("_nth") <= F.col("_left"))).cast("long")
    return df.withColumn("quota", F.least(F.col("_floor") + extra, F.col(size)).cast("long")).drop("_total", "_floor", "_rest", "_left", "_nth")


#: Strata over this size are cut by a quantile of the hash before they are sorted; the quantile's rank is off by 1 / ACCURACY at most.
LARGE, ACCURACY = 20_000, 10_000


def draw(key: str, seed: int) -> Column:
    """A number from the key and the seed, by which records are drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A simple random sample of its quota from each stratum, with stratum_n, stratum_sample_n, inclusion_prob and
    design_weight. The order within a stratum is that of a seeded hash, so it is the same in any partitioning. Of a large stratum
    only the rows up to a quantile of the hash, a little over its quota, are sorted; the sample is exact."""
    h = draw(key, seed)
    total = df.count()
    share = min(1.0, n / max(1, total) + 1 / ACCURACY + 2 / LARGE)  # quotas are in proportion, but for one unit
    cut = F.when(F.count(F.lit(1)) > LARGE, F.percentile_approx(h, share, ACCURACY)).alias("_cut")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_n"), cut)
    plan = quotas(sizes, stratum, "stratum_n", n).withColumnRenamed("quota", "stratum_sample_n")
    some = df.join(plan, stratum).where(F.col("_cut").isNull() | (h <= F.col("_cut"))).drop("_cut")  # a row a stratum: Spark sees their size
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(h, F.col(key)))
    out = some.withColumn("_at", at).where(F.col("_at") <= F.col("stratum_sample_n")).drop("_at")
    return out.withColumn(
        "inclusion_prob", F.col("stratum_sample_n") / F.col("stratum_n")
    ).withColumn("design_weight", F.col("stratum_n") / F.col("stratum_sample_n"))


def sample_if_needed(df: DataFrame, stratum: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """Samples only above ``most`` records; else every weight is 1."""
    if df.limit(most + 1).count() > most if most < 1 << 31 else df.count() > most:
        return stratified_sample(df, stratum, key, most, seed)
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("stratum_n"))
    out = df.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    return out.withColumns({"stratum_sample_n": F.col("stratum_n"), "inclusion_prob": F.lit(1.0), "design_weight": F.lit(1.0)})
