"""Letters of texts as bases, and the members of a catalogue, made once."""

from pyspark.sql import functions as F

from braidseq.functions.sequences import text_as_sequence
from braidseq.operators import catalogue, mutations


def _translates(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("translate(")


def test_letters_need_no_translation_of_single_characters(spark):
    texts = ["Abc xyz", "", None, "äK-zİ", "A1b2\U0001f600c", "zZ\n\t"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    made = rows.select("i", text_as_sequence(F.col("text")).alias("s"), F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("plain"))
    assert all(r["s"] == r["plain"] for r in made.collect())
    assert _translates(rows.select(text_as_sequence(F.col("text")))) == 0


def test_members_do_not_make_the_digests_again(spark):
    rows = [("a", "s", "x", "ACGTT", 0), ("b", "s", "y", "AACGT", 0), ("c", "t", "z", "GGG", 0)]
    sources = spark.createDataFrame(rows, "identifier string, source_sample string, original_identifier string, sequence string, source_ordinal int")
    members = catalogue.catalogue_members(sources)
    assert _translates(members) == 0
    assert {(r["source_id"], r["representative"], r["group_size"], r["length"]) for r in members.collect()} == {("a", False, 2, 5), ("b", True, 2, 5), ("c", True, 1, 3)}


def test_a_row_of_truth_does_not_judge_the_edits_again(spark):
    whole = spark.createDataFrame([("a", "ACGTACGT")], "identifier string, sequence string")
    edits = spark.createDataFrame([("a", 2, "substitution", 1, "T"), ("a", 5, "deletion", 2, None)], "identifier string, position int, kind string, length int, bases string")
    edited, truth = mutations.apply_edits(whole, edits)
    assert "reason" not in truth._jdf.queryExecution().optimizedPlan().toString()
    assert edited.first()["sequence"] == "ACTTAT"
    assert {(r["position"], r["old"], r["new"], r["edited_position"]) for r in truth.collect()} == {(2, "G", "T", 2), (5, "CG", "", 5)}
