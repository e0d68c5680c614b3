"""Horvitz-Thompson and calibrated weights, and what they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X


def analysis_weight(status: str = "match_status", population: str = "population", design: str = "design_weight") -> Column:
    """Population times design weight where matched, else null."""
    return F.when(F.col(status) == K.MATCHED, F.col(population) * F.col(design))


def calibration_factors(df: DataFrame, known: DataFrame, groups: Sequence[str], weight: str, known_value: str) -> DataFrame:
    """A row per group of either side: ht_total, known_population, calibration_factor, calibration_status.
    Null groups are left out."""
    some = F.lit(True)
    for g in groups:
        some = some & F.col(g).isNotNull()
    ht = df.where(some).groupBy(*groups).agg(F.sum(weight).alias("_ht"))
    out = ht.join(known.where(some).select(*groups, F.col(known_value).alias("known_population")), list(groups), "full_outer")
    total = F.coalesce("_ht", F.lit(0))
    impossible = F.coalesce((F.col("known_population") > 0) & (total == 0), F.lit(False))
    return out.select(
        *groups, total.alias("ht_total"), "known_population",
        F.when(~impossible, X.ratio(F.col("known_population"), F.nullif(total, F.lit(0)))).alias("calibration_factor"),
        F.when(impossible, K.NO_SAMPLE).otherwise(K.CALIBRATED).alias("calibration_status")
    )


def calibrated(df: DataFrame, factors: DataFrame, groups: Sequence[str], weight: str) -> DataFrame:
    """df with its group's factor, status and calibrated_weight. Groups are areas: one row each; Spark decides by their
    size whether to broadcast them."""
    return df.join(factors, list(groups), "left").withColumn("calibrated_weight", F.col(weight) * F.col("calibration_factor"))


def effective_sample_size(w: Column) -> Column:
    """(sum w)^2 / sum w^2 of positive weights (A10)."""
    w = F.when(w > 0, w)
    return X.ratio(F.pow(F.sum(w).cast("double"), F.lit(2.0)), F.sum(w * w))


def effective_sizes(df: DataFrame, dep: str, columns: Sequence[str]) -> DataFrame:
    """TOTAL and each department in one rollup."""
    rows = df.where(F.col(dep).isNotNull()).rollup(dep).agg(
        F.grouping(dep).alias("_g"), *(effective_sample_size(F.col(c)).alias(f"n_eff_{c}") for c in columns)
    )
    return rows.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(dep)).alias("scope"), *(f"n_eff_{c}" for c in columns))


def verify_design_weights(
    df: DataFrame, stratum: str, prob: str = "inclusion_prob", weight: str = "design_weight", tolerance: float = 1e-8
) -> DataFrame:
    """Whether weight is 1 / prob everywhere and one number in each stratum (P20)."""
    by = df.groupBy(stratum).agg(
        F.max(F.abs(F.lit(1.0) / F.col(prob) - F.col(weight))).alias("d"),
        F.bool_and(F.abs(F.lit(1.0) / F.col(prob) - F.col(weight)) <= tolerance + 1e-5 * F.abs(F.col(weight))).alias("ok"),
        F.count_distinct(weight).alias("n")
    )
    return by.agg(F.max("d").alias("max_abs_diff"), F.bool_and("ok").alias("consistent"), F.bool_and(F.col("n") <= 1).alias("one_weight_per_stratum"))


def match_summary(df: DataFrame, dep: str) -> DataFrame:
    """TOTAL and each department: counts by match status, and the matched population."""
    status = F.col("match_status")
    rows = df.rollup(dep).agg(
        F.grouping(dep).alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(status == K.MATCHED).alias("n_matched"), F.count_if(
            status == K.UNMATCHED
        ).alias("n_unmatched"),
        F.count_if(status == K.AMBIGUOUS).alias("n_ambiguous"), F.sum(F.when(status == K.MATCHED, F.col("population"))).alias("population_matched"),
    )
    rows = rows.where((F.col("_g") == 1) | F.col(dep).isNotNull())
    return rows.select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(dep)).alias("scope"), "n", "n_matched", "n_unmatched",
        "n_ambiguous", X.percent(F.col("n_matched"), F.col("n")).alias("pct_matched"), "population_matched"
    )


def representativeness(df: DataFrame, dep: str, weight: str) -> DataFrame:
    """TOTAL and each department: sample, weight, and its share of TOTAL (null on TOTAL)."""
    rows = df.rollup(dep).agg(
        F.grouping(dep).alias("_g"), F.count(F.lit(1)).alias("n"), F.count(weight).alias("n_with_weight"),
        F.sum(weight).alias("total_weight")
    )
    rows = rows.where((F.col("_g") == 1) | F.col(dep).isNotNull())
    total = df.agg(F.sum(weight).alias("_all"))
    share = F.when(F.col("_g") == 0, X.percent(F.col("total_weight"), F.col("_all")))
    return rows.crossJoin(F.broadcast(total)).select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(dep)).alias("scope"), "n", "n_with_weight", "total_weight",
        share.alias("pct_of_total")
    )


def compare_totals(a: DataFrame, b: DataFrame, groups: Sequence[str], value_a: str, value_b: str) -> DataFrame:
    """Totals of two sources by group from either side, with ratio and difference."""
    x = a.groupBy(*groups).agg(F.sum(value_a).alias("a"))
    y = b.groupBy(*groups).agg(F.sum(value_b).alias("b"))
    out = x.join(y, list(groups), "full_outer")
    return out.select(
        *groups, "a", "b", X.ratio(F.col("a"), F.col("b")).alias("ratio"),
        X.percent(F.col("a") - F.col("b"), F.col("b")).alias("diff_pct")
    )
