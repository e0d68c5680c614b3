"""Data-quality rules: each adds a boolean column; nothing is dropped without a trace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import exprs as X


def coord_missing(lon: Column, lat: Column, tolerance: float = 1e-6, treat_zero: bool = True) -> Column:
    """Rule 1: no number, or both within the tolerance of 0."""
    x, y = X.number(lon), X.number(lat)
    out = x.isNull() | y.isNull()
    return (out | ((F.abs(x) <= tolerance) & (F.abs(y) <= tolerance))) if treat_zero else out


def in_bbox(lon: Column, lat: Column, bbox: Sequence[float] = K.BBOX) -> Column:
    return F.coalesce(lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3]), F.lit(False))


def coord_out_of_bbox(lon: Column, lat: Column, missing: Column, bbox: Sequence[float] = K.BBOX) -> Column:
    """Rule 2; a null point is rule 1's alone."""
    return lon.isNotNull() & lat.isNotNull() & ~missing & ~in_bbox(lon, lat, bbox)


def swapped_candidate(lon: Column, lat: Column, missing: Column, bbox: Sequence[float] = K.BBOX) -> Column:
    """Rule 3: outside as it is, inside with longitude and latitude exchanged."""
    return coord_out_of_bbox(lon, lat, missing, bbox) & in_bbox(lat, lon, bbox)


def correct_swapped(df: DataFrame, inside_swapped: Column, lon: str = "lon", lat: str = "lat", missing: str = "coord_missing") -> DataFrame:
    """Adds swap_candidate, swap_corrected and swap_ambiguous, and exchanges what is corrected: candidates whose
    exchanged point lies in their declared district."""
    df = df.withColumn("swap_candidate", swapped_candidate(F.col(lon), F.col(lat), F.col(missing)))
    df = df.withColumn("swap_corrected", F.col("swap_candidate") & F.coalesce(inside_swapped, F.lit(False)))
    df = df.withColumn("swap_ambiguous", F.col("swap_candidate") & ~F.col("swap_corrected"))
    fixed = F.col("swap_corrected")
    return df.withColumns({lon: F.when(fixed, F.col(lat)).otherwise(F.col(lon)), lat: F.when(fixed, F.col(lon)).otherwise(F.col(lat))})


def duplicate_flags(df: DataFrame, key: str, columns: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Rule 5: dup_any, dup_conflict, dup_drop (an exact copy but the first). Null keys are no duplicates."""
    columns = list(columns or df.columns)
    several = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    own = df.columns
    df = df.join(several, F.col(key) == F.col("_k"), "left")  # a null key meets nothing, so null keys need not come together
    any_ = F.col("_k").isNotNull()
    by_row = Window.partitionBy(*columns)
    df = df.withColumns({"_n_row": F.count(F.lit(1)).over(by_row), "_nth": F.row_number().over(by_row.orderBy(*(order or columns)))})
    exact = F.col("_n_row") > 1
    return df.select(*own, any_.alias("dup_any"), (any_ & ~exact).alias("dup_conflict"), (any_ & exact & (F.col("_nth") > 1)).alias("dup_drop"))


def encoding_report(df: DataFrame, columns: Sequence[str], most_pct: float = 0.0) -> DataFrame:
    """Rule 6: one row with n_values, n_flagged, pct and ok over the non-null values of all columns."""
    n = sum((F.count(F.col(c)) for c in columns), F.lit(0))
    bad = sum((F.coalesce(F.sum(X.mojibake(c).cast("long")), F.lit(0)) for c in columns), F.lit(0))
    out = df.agg(n.cast("long").alias("n_values"), bad.cast("long").alias("n_flagged"))
    pct = F.coalesce(X.percent(F.col("n_flagged"), F.nullif(F.col("n_values"), F.lit(0))), F.lit(0.0))
    return out.withColumn("pct", pct).withColumn("ok", F.col("pct") <= most_pct)


def quality_report(df: DataFrame, rules: Mapping[str, str], actions: Mapping[str, str] | None = None) -> DataFrame:
    """A row per rule: regla, n_afectados, accion; rules: name -> flag column. One pass over df."""
    one = df.agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"r{i}") for i, c in enumerate(rules.values())))
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("regla"), F.col(f"r{i}").alias("n_afectados"),
                F.lit((actions or {}).get(name, "keep_warning")).alias("accion")
            ) for i,
            name in enumerate(rules)
        )
    )
    return one.select(F.inline(rows))


def audit_detail(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Only rows with a flag, their key and flags."""
    hit = F.lit(False)
    for c in flags:
        hit = hit | F.coalesce(F.col(c), F.lit(False))
    return df.where(hit).select(F.col(key).alias("record_key"), *flags)


def alarm(n_affected: Column, n_total: Column, threshold_pct: float, label: str) -> Column:
    """A message where the share is over the threshold, else null."""
    share = X.percent(n_affected, F.nullif(n_total, F.lit(0)))
    return F.when(share > threshold_pct, F.concat(F.lit(f"ALARM {label}: "), n_affected.cast("string"), F.lit("/"), n_total.cast("string")))


def excluded_from_routing(missing: Column, out_of_bbox: Column, corrected: Column) -> Column:
    return missing | (out_of_bbox & ~corrected)


def validated(df: DataFrame, key: str, lon: str = "lon", lat: str = "lat", inside_swapped: Column | None = None) -> DataFrame:
    """Rules 5, 1, 2, 3 in this order on one plan; exact copies go, all else stays with its flags."""
    df = duplicate_flags(df, key).where(~F.col("dup_drop"))
    df = df.withColumns({lon: X.number(lon), lat: X.number(lat)})
    df = df.withColumn("coord_missing", coord_missing(F.col(lon), F.col(lat)))
    df = df.withColumn("coord_out_of_bbox", coord_out_of_bbox(F.col(lon), F.col(lat), F.col("coord_missing")))
    df = correct_swapped(df, F.lit(False) if inside_swapped is None else inside_swapped, lon, lat)
    return df.withColumn(
        "qc_excluded_from_routing",
        excluded_from_routing(F.col("coord_missing"), F.col("coord_out_of_bbox"), F.col("swap_corrected"))
    )
