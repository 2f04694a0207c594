"""The registered queries of this subpackage: each applies one operator to whole tables and derives the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_contamination, with_verdict
from .gif import read_payload, store_as_gif
from .maxent import remainder as crc_remainder
from .maxent import score_language_model, train_language_model
from .mixing import mix_sources
from .pii import KINDS, find_pii
from .sharding import shard_by_bytes
from .simhash import hexadecimal, near_components
from .tokens import count_tokens
from .toxicity import THRESHOLD, remainder, score_toxicity, train_toxicity
from .url_cascade import Rule, judge_urls
from .vector_codes import compress_vectors
from .whitening import whiten
from .zip_warc import archive_pages, read_packages

URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_<kind>`` count the base spans, which ``base_sha256`` digests; ``spans`` holds the added ones too."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("simhash")).alias("fingerprint"), "component_id")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_verdict(find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_as_gif(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = read_payload(stored).drop("media")
    levels = lambda colour: f"array_join(transform(sequence(0, 15), i -> aggregate(frames, 0L, (n, f) -> n + f.{colour}[i])), ',')"
    folded = [F.concat(F.lit(f"{c}="), F.expr(levels(c))) for c in ("red", "green", "blue")]
    time = F.concat(F.lit("ms="), F.expr("aggregate(frames, 0, (n, f) -> n + f.delay_ms)"))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), time, *folded)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    model = train_language_model(docs.where(~held_out))
    scored = score_language_model(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_simhash, op3_tokens, op4_sharding, op5_toxicity, op6_mixing, op7_zip_warc, op8_decontaminate, op9_gif, op10_url_cascade, op11_language_model, op12_whitening, op13_vector_codes)
}
