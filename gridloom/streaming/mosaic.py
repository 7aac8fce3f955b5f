"""Rasters that arrive in files: a running mosaic over a stream of cell tables.

Tasks work on tiles in bounded memory anyway; this is for data that comes over time:
each micro-batch's cells replace those of earlier batches, and batches that are run again change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "y int, x int, v float, layer long"


def cell_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files with cells (y, x, v, layer) that arrive in ``folder``."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def start_mosaic(cells: DataFrame, target: str, checkpoint: str):
    """Append each batch's top cells, one file set for each batch, until all that is there has been read.

    A batch is written under its number and replaces an earlier attempt of it.
    """

    def write(batch: DataFrame, number: int):
        top = batch.where("v is not null").groupBy("y", "x").agg(F.max(F.struct("layer", "v")).alias("t")).select("y", "x", "t.v", "t.layer")
        top.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_mosaic(spark: SparkSession, target: str) -> DataFrame:
    """The mosaic so far: of all valid cells at a place that of the highest layer."""
    df = spark.read.parquet(target)
    return df.groupBy("y", "x").agg(F.max(F.struct("layer", "v")).alias("t")).select("y", "x", F.col("t.v").alias("v"))
