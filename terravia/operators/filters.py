"""Filters with an "all" choice, lists of choices, and quality panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _chosen(values: Sequence[str] | None) -> bool:
    return bool(values) and K.ALL not in values


def scope(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose declared department is one of a study's, in any case."""
    return df.where(F.upper(F.trim(F.col(column))).isin([n.upper() for n in names]))


def by_code(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows whose code is one of a study's."""
    return df.where(F.col(column).isin(list(codes)))


def geographic(df: DataFrame, choices: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Each level filters unless nothing, or "all", is chosen."""
    for column, values in choices.items():
        if _chosen(values):
            df = df.where(F.col(column).isin(list(values)))
    return df


def facilities(
    df: DataFrame, categories: Sequence[str] | None = None, institutions: Sequence[str] | None = None,
    resolutive: bool | None = None
) -> DataFrame:
    """Facilities by category, institution and whether they are resolutive; what isn't chosen doesn't filter."""
    df = geographic(df, {"category": categories, "institution": institutions})
    return df if resolutive is None else df.where(F.col("is_resolutive") == resolutive)


def options(df: DataFrame, column: str, given: Mapping[str, Sequence[str] | None] | None = None) -> DataFrame:
    """ord, option: "all" first, then the distinct values in order."""
    found = geographic(df, given or {}).select(F.col(column).alias("option")).where("option is not null").distinct()
    first = df.sparkSession.createDataFrame([(0, K.ALL)], "ord int, option string")
    return first.unionByName(found.select(F.lit(1).alias("ord"), "option")).orderBy("ord", "option")


def upgrade_candidates(df: DataFrame) -> DataFrame:
    """Active I-3 and I-4 that may be routed to."""
    return df.where(F.col("category").isin("I-3", "I-4") & F.col("is_active") & ~F.col("qc_excluded_from_routing"))


def resolutive(df: DataFrame) -> DataFrame:
    return df.where(F.col("category").isin(*K.RESOLUTIVE) & F.col("is_active") & ~F.col("qc_excluded_from_routing"))


def key_values(df: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A (metric, value) table as one map."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value).cast("string")))).alias("report"))


def facility_quality(report: DataFrame) -> DataFrame:
    return report.where(F.col("dataset") == "facilities").select("regla", "n_afectados", "accion", "justificacion")


def routing_quality_panel(report: DataFrame) -> DataFrame:
    """Numbers for the panel from a (metric, value) table."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value").try_cast("double")))
    total = F.coalesce(F.nullif(pick("demand_total"), F.lit(0.0)), F.lit(1.0))
    return report.agg(
        pick("car_snap_failed").alias("car_snap_failed"), (
            100 * F.coalesce(pick("car_snap_failed"), F.lit(0.0)) / total
        ).alias("car_snap_failed_pct"),
        pick("car_no_route_same_department").alias("car_no_route"), (
            100 * F.coalesce(pick("car_no_route_same_department"), F.lit(0.0)) / total
        ).alias("car_no_route_pct"), total.alias("demand_total"),
    )


def population_quality_panel(calibration: DataFrame) -> DataFrame:
    bad = F.col("calibration_status") == K.NO_SAMPLE
    return calibration.agg(
        F.count_if(bad).alias("n_impossible"),
        F.coalesce(F.sum(F.when(bad, F.col("known_population"))), F.lit(0)).alias("population_impossible")
    )


def statistical_quality_panel(calibration: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    f = F.col("calibration_factor")
    return calibration.agg(F.count_if(f < low).alias("n_extreme_low"), F.count_if(f > high).alias("n_extreme_high"))
