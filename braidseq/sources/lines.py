"""Text files as numbered lines, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line, value``: the lines of all files under ``path``, counted from 1 in each file.

    A split counts its own lines; what lies before it is the sum over the
    file's earlier splits, one row a split.  So no file is read by one task
    alone.  Order within a split is the order of its rows' ids.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id")
    )
    return with_place(rows, "line").withColumn("line", F.col("line") + 1).select("file", "line", "value")


def with_place(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of text files (``file, split, id``, ids in the order of each split) with their place in the file, from 0, in place of ``split`` and ``id``."""
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # A row a split: as many as the reader's tasks, which the driver holds anyway.
    met = rows.join(F.broadcast(splits), ["file", "split"])
    return met.withColumn(name, F.col("id") - F.col("_first") + F.col("_before")).drop("split", "id", "_first", "_before")
