"""What if a facility were upgraded: times are minima over known ones, nothing is routed anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def scenario_time(baseline: DataFrame, matrix: DataFrame, selected: Sequence[str] | None, time: str = "t_min") -> DataFrame:
    """baseline with scenario_t: the least of the baseline and the times to selected facilities."""
    if not selected:
        return baseline.withColumn("scenario_t", F.col(time))
    best = matrix.where(F.col("facility_id").isin(list(selected))).groupBy("demand_id").agg(F.min("travel_time_min").alias("_b"))
    return baseline.join(best, "demand_id", "left").withColumn("scenario_t", F.least(F.col(time), F.col("_b"))).drop("_b")


def band_summary(t: Column, w: Column, suffix: str = "") -> list[Column]:
    """Population by bands over all weight, and the mean."""
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    both = t.isNotNull() & w.isNotNull()
    return [
        F.sum(w).alias(
            f"total_population{suffix}"
        ), part(t <= 30).alias(f"pop_le_30{suffix}"), part(t <= 60).alias(f"pop_le_60_cum{suffix}"), part(t <= 120).alias(f"pop_le_120_cum{suffix}"), part(t > 120).alias(f"pop_gt_120{suffix}"),
        part(t.isNull()).alias(f"pop_no_time_estimate{suffix}"), part((t > 30) & (t <= 60)).alias(f"pop_30_60_only{suffix}"), X.ratio(
            F.sum(F.when(both, t * w)), F.nullif(F.sum(F.when(both, w)), F.lit(0))
        ).alias(f"weighted_mean{suffix}"),
    ]


def baseline_vs_scenario(
    demand: DataFrame, matrix: DataFrame, selected: Sequence[str] | None, time: str = "t_min",
    weight: str = "calibrated_weight"
) -> DataFrame:
    """One row: both summaries, the gains, and the weight that gets a time at all (X3). Both sides in one pass, so nobody is
    counted twice."""
    rows = scenario_time(demand, matrix, selected, time)
    t, s, w = F.col(time), F.col("scenario_t"), F.col(weight)
    new = F.coalesce(F.sum(F.when(t.isNull() & s.isNotNull(), w)), F.lit(0)).alias("population_newly_routed")
    out = rows.agg(*band_summary(t, w, "_baseline"), *band_summary(s, w, "_scenario"), new)
    gains = {
        f"pop_gain_{a}": F.col(f"pop_{b}_scenario") - F.col(f"pop_{b}_baseline") for a,
        b in (("le_30", "le_30"), ("le_60", "le_60_cum"), ("le_120", "le_120_cum"))
    }
    return out.withColumns(gains).withColumn("weighted_mean_reduction_min", F.col("weighted_mean_baseline") - F.col("weighted_mean_scenario"))


def candidate_scores(demand: DataFrame, matrix: DataFrame, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """What each candidate alone would gain (X4): one join of the matrix with the baseline and one aggregate of differences, in
    place of a simulation for each candidate."""
    all_ = demand.where(F.col(weight).isNotNull())
    has = F.col(time).isNotNull()
    base = all_.agg(F.sum(F.when(has, F.col(time) * F.col(weight))).alias("base_tw"), F.sum(F.when(has, F.col(weight))).alias("base_w"))
    best = matrix.where(F.col("travel_time_min").isNotNull()).groupBy("facility_id", "demand_id").agg(F.min("travel_time_min").alias("m"))
    better = best.join(
        all_.select("demand_id", F.col(time).alias("t"), F.col(weight).alias("w")), "demand_id"
    ).where(F.col("t").isNull() | (F.col("m") < F.col("t")))
    gain = lambda cut: F.sum(F.when((F.col("m") <= cut) & (F.col("t").isNull() | (F.col("t") > cut)), F.col("w")))
    sums = better.groupBy("facility_id").agg(
        gain(30).alias("g30"), gain(60).alias("g60"), gain(120).alias("g120"),
        F.sum(F.when(F.col("t").isNull(), F.col("w"))).alias("new_w"),
        F.sum((F.col("m") - F.coalesce("t", F.lit(0))) * F.col("w")).alias("d_tw")
    )
    ids = matrix.select("facility_id").distinct()
    zero = F.lit(0)
    rows = ids.join(sums, "facility_id", "left").crossJoin(F.broadcast(base))
    before = X.ratio(F.col("base_tw"), F.nullif("base_w", F.lit(0)))
    after = X.ratio(
        F.coalesce("base_tw", zero) + F.coalesce("d_tw", zero),
        F.nullif(F.coalesce("base_w", zero) + F.coalesce("new_w", zero), F.lit(0))
    )
    return rows.select(
        "facility_id", F.coalesce("g30", zero).alias("pop_gain_le_30"), F.coalesce("g60", zero).alias("pop_gain_le_60"),
        F.coalesce("g120", zero).alias("pop_gain_le_120"), (before - after).alias("weighted_mean_reduction_min")
    )


def improvement_top(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "weighted_mean", n: int = 10) -> DataFrame:
    """Districts whose mean falls most."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    return b.join(a, list(keys)).withColumn(
        "improvement", F.col("before") - F.col("after")
    ).where("improvement > 0").orderBy(F.desc("improvement"), *keys).limit(n)
