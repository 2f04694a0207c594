"""New samples as a stream into a catalogue on disk.

Each micro-batch's sources become catalogue members in a folder of their own,
named by the batch, so a batch that runs again replaces its own rows and
nothing is counted twice.  Reading the catalogue regroups all members: the
representative of a molecule is the least over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalogue import catalogue_sequences, keyed


def stream_sources(sources: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream; ``trigger`` as for ``DataStreamWriter.trigger`` (default: all that is there, then stop)."""

    def put(batch: DataFrame, number: int) -> None:
        keyed(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sources.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    members = spark.read.parquet(folder)
    return catalogue_sequences(members.select("identifier", "source_sample", "original_identifier", "sequence", F.col("source_ordinal").cast("int").alias("source_ordinal")))
