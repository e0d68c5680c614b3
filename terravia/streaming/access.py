"""Access indicators kept up to date over files that keep arriving. The operators here are the batch ones, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def band_totals(rows: DataFrame, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """Weight and records by band; works on a stream (update or complete mode) as on a table."""
    return rows.groupBy(X.band(time).alias("band")).agg(F.sum(weight).alias("population"), F.count(F.lit(1)).alias("n"))


def follow(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> None:
    """Takes in all files of a folder that are new since the last call, and keeps the totals in a memory table."""
    rows = spark.readStream.schema(schema).parquet(folder)
    query = band_totals(rows).writeStream.outputMode("complete").format("memory").queryName(table).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()
