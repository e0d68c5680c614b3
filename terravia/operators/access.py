"""Weighted access times and coverage bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X


def _mean_columns(t: Column, w: Column) -> list[Column]:
    both = t.isNotNull() & w.isNotNull()
    return [
        F.count(F.lit(1)).alias("n_cp"),
        F.count(w).alias("n_cp_with_weight"),
        F.count_if(both).alias("n_cp_with_time"),
        F.sum(w).alias("total_pop"),
        F.coalesce(F.sum(F.when(both, w)), F.lit(0)).alias("pop_with_time"),
        X.ratio(F.sum(F.when(both, t * w)), F.sum(F.when(both, w))).alias("weighted_mean"),
        X.percent(F.coalesce(F.sum(F.when(both, w)), F.lit(0)), F.nullif(F.sum(w), F.lit(0))).alias("share_with_time_pct"),
    ]


def weighted_mean_access(df: DataFrame, groups: Sequence[str] = (), time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Mean time by group, or of all (scope total). The total weight is null where no row has one, the weight with a time is 0
    then; null groups stay (A1)."""
    columns = _mean_columns(F.col(time), F.col(weight))
    return df.groupBy(*groups).agg(*columns) if groups else df.agg(*columns).select(F.lit("total").alias("scope"), "*")


def band_weights(time: str, weight: str, with_none: bool = False) -> list[Column]:
    """A conditional sum for each band: one pass, no join."""
    b = X.band(time)
    names = [*K.BANDS, K.NO_TIME] if with_none else K.BANDS
    return [F.coalesce(F.sum(F.when(b == name, F.col(weight))), F.lit(0)).alias(name) for name in names]


def _long(one: DataFrame, names: Sequence[str], total: Column) -> DataFrame:
    rows = F.array(
        *(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("band"), F.col(f"`{n}`").cast("double").alias("population")) for i, n in enumerate(names))
    )
    return one.withColumn("_total", total).select(F.inline(rows), F.col("_total")).select(
        "ord", "band", "population", X.percent(F.col("population"), F.nullif(F.col("_total"), F.lit(0.0))).alias("pct")
    ).orderBy("ord")


def _sum(names: Sequence[str]) -> Column:
    return sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")).cast("double")


def bands_of_timed(df: DataFrame, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Reading A: the four bands over rows with a time and a weight (A2)."""
    return _long(df.agg(*band_weights(time, weight)), K.BANDS, _sum(K.BANDS))


def bands_of_all(df: DataFrame, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Reading B: five bands over all rows with a weight."""
    names = [*K.BANDS, K.NO_TIME]
    return _long(df.agg(*band_weights(time, weight, True)), names, _sum(names))


def cumulative_columns(time: str, weight: str) -> list[Column]:
    t, w = F.col(time), F.col(weight)
    conditions = (t <= 30, t <= 60, t <= 120, t > 120, t.isNull())
    return [F.coalesce(F.sum(F.when(c, w)), F.lit(0)).alias(n) for c, n in zip(conditions, K.CUMULATIVE, strict=True)]


def bands_cumulative(df: DataFrame, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Reading B, cumulative."""
    one = df.agg(*cumulative_columns(time, weight), F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("_all"))
    return _long(one, K.CUMULATIVE, F.col("_all"))


def bands_wide(df: DataFrame, groups: Sequence[str], time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Reading A by group: pop_<band> and pct_<band> (A3)."""
    rows = df.groupBy(*groups).agg(*band_weights(time, weight))
    total = F.nullif(_sum(K.BANDS), F.lit(0.0))
    return rows.select(
        *groups, *(F.col(f"`{b}`").cast("double").alias(f"pop_{b}") for b in K.BANDS),
        *(X.percent(F.col(f"`{b}`"), total).alias(f"pct_{b}") for b in K.BANDS)
    )


def district_metrics(df: DataFrame, groups: Sequence[str], time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Mean access and cumulative shares of all weight, in one aggregate (A4)."""
    rows = df.groupBy(*groups).agg(*_mean_columns(F.col(time), F.col(weight)), *cumulative_columns(time, weight))
    names = {"<=30": "pct_le_30", "<=60 (cum)": "pct_le_60", "<=120 (cum)": "pct_le_120", ">120": "pct_gt_120", "sin_tiempo_estimable": "pct_no_time"}
    return rows.withColumns({v: X.percent(F.col(f"`{k}`"), F.nullif(F.col("total_pop"), F.lit(0))) for k, v in names.items()}).drop(*names)


def _with_total(rows: DataFrame, df: DataFrame, weight: str) -> DataFrame:
    return rows.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))))


def completeness(df: DataFrame, status: str, weight: str = "weight") -> DataFrame:
    """By routing status: records, weight, and their shares (A5)."""
    rows = _with_total(df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("population")), df, weight)
    return rows.select(
        status, "n", "population", X.percent(F.col("population"), F.nullif("_w", F.lit(0))).alias("pct_population"),
        X.percent(F.col("n"), F.col("_n")).alias("pct_n")
    )


def unroutable_concentration(df: DataFrame, groups: Sequence[str], status: str, weight: str = "weight") -> DataFrame:
    """By group and status (routed ones too), with the share of the whole weight."""
    rows = _with_total(df.groupBy(*groups, status).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("population")), df, weight)
    return rows.select(*groups, status, "n", "population", X.percent(F.col("population"), F.nullif("_w", F.lit(0))).alias("pct_of_total"))


def urban_rural_summary(df: DataFrame, time: str = "t_min", weight: str = "weight", kind: str = "urban_rural") -> DataFrame:
    """urban, rural and unknown, each even if empty: mean, counts, and reading A's shares."""
    out = None
    for name in (K.URBAN, K.RURAL, K.UNKNOWN):  # three rows of one aggregate each, over the same scan
        mine = F.col(kind) == name
        t, w = F.when(mine, F.col(time)), F.when(mine, F.col(weight))
        both = t.isNotNull() & w.isNotNull()
        bands = [F.sum(F.when(X.band(t) == b, w)) for b in K.BANDS]
        total = F.sum(F.when(both, w))
        fields = F.struct(
            F.lit(name).alias("urban_rural"), F.count_if(mine).alias("n_cp"), F.count_if(both).alias("n_cp_with_time"), X.ratio(
                F.sum(F.when(both, t * w)), total
            ).alias("weighted_mean"),
            *(
                F.coalesce(X.percent(b, F.nullif(total, F.lit(0))), F.when(total > 0, F.lit(0.0))).alias(f"pct_{n}") for b,
                n in zip(bands, K.BANDS, strict=True)
            ),
            X.percent(F.count_if(mine & F.col(time).isNull()), F.nullif(F.count_if(mine), F.lit(0))).alias("pct_without_route"),
        )
        out = [*(out or []), fields]
    rows = df.agg(F.array(*out).alias("r")).select(F.inline("r"))
    return rows.withColumns(
        {
            "cum_pct_le_60": F.col("`pct_<=30`") + F.col("`pct_>30_<=60`"),
            "cum_pct_le_120": F.col("`pct_<=30`") + F.col("`pct_>30_<=60`") + F.col("`pct_>60_<=120`")
        }
    )


def urban_rural_coverage(df: DataFrame, weight: str = "weight", kind: str = "urban_rural") -> DataFrame:
    """One row: weight by kind and the share that is known."""
    w, known = F.col(weight), F.col(kind).isin(K.URBAN, K.RURAL)
    part = lambda n: F.coalesce(F.sum(F.when(F.col(kind) == n, w)), F.lit(0))
    return df.agg(
        part(K.URBAN).alias("urban"), part(K.RURAL).alias("rural"), part(K.UNKNOWN).alias("unknown"),
        X.percent(F.sum(F.when(known, w)), F.nullif(F.sum(w), F.lit(0))).alias("pct_classified")
    )


def compare_weights(df: DataFrame, dep: str, weight_a: str, weight_b: str, time: str = "t_min") -> DataFrame:
    """TOTAL and each department: the mean by either weight and their difference, in one rollup."""
    def mean(w):
        both = F.col(time).isNotNull() & F.col(w).isNotNull()
        return X.ratio(F.sum(F.when(both, F.col(time) * F.col(w))), F.sum(F.when(both, F.col(w))))

    rows = df.where(F.col(dep).isNotNull()).rollup(dep).agg(
        F.grouping(dep).alias("_g"), mean(weight_a).alias("mean_ht"), mean(weight_b).alias("mean_calibrated")
    )
    return rows.select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(dep)).alias("scope"), "mean_ht", "mean_calibrated",
        (F.col("mean_calibrated") - F.col("mean_ht")).alias("difference")
    )


def summary(df: DataFrame, time: str = "t_min", weight: str = "weight", match: str = "match_status") -> DataFrame:
    """The one-row summary."""
    both = F.col(time).isNotNull() & F.col(weight).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_demand"), F.count_if(F.col(match) == K.MATCHED).alias("n_matched"), X.percent(
            F.count_if(F.col(match) == K.MATCHED), F.count(F.lit(1))
        ).alias("pct_matched"),
        F.sum(weight).alias("population"), X.ratio(
            F.sum(F.when(both, F.col(time) * F.col(weight))), F.sum(F.when(both, F.col(weight)))
        ).alias("weighted_mean"),
        X.percent(F.sum(F.when(both, F.col(weight))), F.nullif(F.sum(weight), F.lit(0))).alias("pct_with_time"),
    )


def top_extreme(df: DataFrame, key: str, time: str = "t_min", n: int = 20) -> DataFrame:
    """The n longest times (K1)."""
    return df.where(F.col(time).isNotNull()).orderBy(F.desc(time), key).limit(n)


def extreme_ratio(df: DataFrame, ratio: str = "foot_over_car_ratio", threshold: float = 100.0) -> DataFrame:
    return df.where(F.col(ratio) > threshold).orderBy(F.desc(ratio))


def kpi_header(df: DataFrame, time: str = "t_min", weight: str = "calibrated_weight", threshold: float = 60) -> DataFrame:
    """The indicators with the weighted median."""
    from . import inequality

    return kpis(df, time, weight, threshold).crossJoin(F.broadcast(inequality.weighted_median(df, time, weight)))  # one row each


def track_impact(before: int, after: int) -> dict[str, float]:
    """What a change brings, from counts before and after."""
    return {"before": before, "after": after, "gain": after - before, "gain_pct": 100.0 * (after - before) / before if before else None}


def kpis(df: DataFrame, time: str = "t_min", weight: str = "calibrated_weight", threshold: float = 60) -> DataFrame:
    """One row of indicators; the whole frame is the denominator."""
    t, w = F.col(time), F.col(weight)
    both = t.isNotNull() & w.isNotNull()
    some = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    all_ = F.nullif(F.sum(w), F.lit(0))
    return df.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("population_frame"), some(t <= threshold).alias("population_le"), X.percent(
            some(t <= threshold), all_
        ).alias("pct_le"),
        some(t > threshold).alias("population_gt"), some(t.isNull()).alias("population_no_time"), X.percent(
            some(t.isNull()), all_
        ).alias("pct_no_time"),
        X.ratio(F.sum(F.when(both, t * w)), F.nullif(F.sum(F.when(both, w)), F.lit(0))).alias("weighted_mean"),
    )
