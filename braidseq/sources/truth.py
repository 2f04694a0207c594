"""Truth tables of relationships and junctions: tab-separated, with their errors as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import InputError

#: The columns of both tables.
RELATIONSHIP_COLUMNS = [
    "query_id", "target_id", "expected_relationship", "expected_orientation", "expected_status", "merge_allowed", "expected_overlap_length", "expected_identity",
    "query_start", "query_end", "target_start", "target_end", "ambiguity_group", "case_id", "reason",
]
JUNCTION_COLUMNS = [
    "case_id", "left_contig", "right_contig", "junction_is_true", "source_coordinate", "circular_wrap", "selected_spanning_reads", "selected_nonspanning_reads",
    "expected_read_evidence", "reason",
]


def _table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "\0").option("emptyValue", "").csv(path)
    if rows.columns != columns:
        raise InputError(f"columns {rows.columns}; expected {columns}")
    return rows


def _first(rules: list[tuple[Column, str]]) -> Column:
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out


def _truth(column: str) -> Column:
    return F.when(F.lower(column) == "true", True).when(F.lower(column) == "false", False)


def read_relationship_truth(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows with ``error`` (null: sound).  An orientation of ``.`` is null; ordered pairs must not repeat."""
    raw = _table(spark, path, RELATIONSHIP_COLUMNS)
    whole = ("expected_overlap_length", "query_start", "query_end", "target_start", "target_end")
    typed = raw.withColumns(
        {x: F.col(x).try_cast("int") for x in whole}
        | {
            "expected_identity": F.col("expected_identity").try_cast("double"), "merge_allowed": _truth("merge_allowed"),
            "expected_orientation": F.when(F.col("expected_orientation") != ".", F.col("expected_orientation")),
            "ambiguity_group": F.coalesce("ambiguity_group", F.lit("")),
        }
    )
    malformed = F.col("merge_allowed").isNull() | F.col("expected_identity").isNull()
    for x in whole:
        malformed = malformed | F.col(x).isNull()
    error = _first([
        (malformed, "a value is malformed"),
        (~F.col("expected_status").isin("VALID", "FORBIDDEN", "AMBIGUOUS"), "status"),
        (~F.coalesce("expected_orientation", F.lit("+")).isin("+", "-"), "orientation"),
        ((F.col("expected_identity") < 0) | (F.col("expected_identity") > 100), "identity"),
        ((F.col("query_start") < 0) | (F.col("query_end") < F.col("query_start")) | (F.col("target_start") < 0) | (F.col("target_end") < F.col("target_start")), "interval"),
    ])
    return _repeats(typed.withColumn("error", error), ["query_id", "target_id"], "repeated pair")


def read_junction_truth(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows with ``error`` (null: sound); neither cases nor ordered pairs may repeat."""
    raw = _table(spark, path, JUNCTION_COLUMNS)
    counts = ("source_coordinate", "selected_spanning_reads", "selected_nonspanning_reads")
    typed = raw.withColumns({x: F.col(x).try_cast("int") for x in counts} | {x: _truth(x) for x in ("junction_is_true", "circular_wrap")})
    malformed, negative = F.col("junction_is_true").isNull() | F.col("circular_wrap").isNull(), F.lit(False)
    for x in counts:
        malformed, negative = malformed | F.col(x).isNull(), negative | (F.col(x) < 0)
    typed = typed.withColumn("error", _first([(malformed, "a value is malformed"), (negative, "a number is negative")]))
    return _repeats(_repeats(typed, ["case_id"], "repeated case"), ["left_contig", "right_contig"], "repeated pair")


def _repeats(rows: DataFrame, key: list[str], what: str) -> DataFrame:
    """Marks all rows whose key occurs more than once; only repeated keys are joined back."""
    named = {x: f"__{x}" for x in key}
    twice = rows.groupBy(*key).count().where("count > 1").select(*[F.col(x).alias(y) for x, y in named.items()], F.lit(what).alias("__what"))
    same = None
    for x, y in named.items():
        one = F.col(x).eqNullSafe(F.col(y))
        same = one if same is None else same & one
    return rows.join(twice, same, "left").withColumn("error", F.coalesce("error", "__what")).drop(*named.values(), "__what")
