"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin, shared_dir, stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def utf8_length(text: Column) -> Column:
    """Bytes of the UTF-8 form; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sliced(batch, column: str, most_bytes: int):
    """``batch`` in slices whose strings in ``column`` hold about ``most_bytes`` together; one long string is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def append_columns(df: DataFrame, ddl: str, column: str, start, most_bytes: int = 4_000_000) -> DataFrame:
    """``df`` with the columns of ``ddl`` computed in Arrow batches, every other column passed through.

    ``start()`` runs once a task and returns a function from an Arrow batch to
    one list or Arrow array for each new column.  It sees slices in which the
    strings of ``column`` take about ``most_bytes``, so memory does not follow
    the batch size.  Columns of ``df`` whose names clash with new ones go.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType, StructType

    new = DataType.fromDDL(ddl)
    taken = {f.name.lower() for f in new.fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    schema = StructType([*kept.schema.fields, *new.fields])
    types = [f.type for f in to_arrow_schema(new)]
    names = schema.names

    def run(batches):
        import pyarrow as pa

        work = start()
        for batch in batches:
            for part in sliced(batch, column, most_bytes):
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(work(part), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return kept.mapInArrow(run, schema)


#: Entries of vectors on a grid may not pass this in size: beyond it sums of them leave the exact numbers.
MOST_GRID = 1 << 40


def finite_vectors(df: DataFrame, column: str, scale: int, offset: int = 0) -> DataFrame:
    """The rows of ``df`` whose vector in ``column`` is not null and holds no null, NaN or infinity, each entry c as the long floor(scale * c) + offset."""
    v = F.col(f"`{column}`").cast("array<double>")
    plain = F.forall(v, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    far = F.raise_error(F.lit("an entry of a vector is too large for the grid")).cast("long")
    on_grid = F.transform(v, lambda c: F.when(F.abs(c) * scale < MOST_GRID, F.floor(c * scale).cast("long") + offset).otherwise(far))
    return df.where(v.isNotNull() & plain).withColumn(column, on_grid)


def of_common_width(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has the commonest width, of ties the largest."""
    widths = df.groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    return df.where(F.size(column) == (widths[0]["w"] if widths else 0))


def keeping_columns(docs: DataFrame, needed: list[str], work) -> DataFrame:
    """``work`` over ``docs``, with the columns of ``docs`` in their order, whatever columns ``work`` makes.

    ``work`` sees ``needed`` under their names and all others under names that
    no operator uses, so none is replaced; it may drop and repeat rows.
    """
    others = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    made = work(docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]))
    return made.select(*[F.col(f"`{others.get(c, c)}`").alias(c) for c in docs.columns])
