"""Sessions and reliable storage for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "braidseq", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single machines; on a cluster use the session that it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )


_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may leave it unset; then driver and executors are one
    process, and a new folder of this process serves, which goes when it ends.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def many(session: SparkSession) -> int:
    """Tasks for much work on little data."""
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def pin(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: lineage ends, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: for large tables, which take a fraction of what ``pin`` writes."""
    folder = fresh_dir(df.sparkSession, what)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)
