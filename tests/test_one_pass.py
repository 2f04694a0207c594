"""Candidates with their diagonals from one meeting of places, canonical forms made once, and results that nobody asks for."""

import random
import struct

from pyspark.sql import functions as F

from braidseq.config import RunConfig
from braidseq.functions.sequences import canonical, canonical_packed, strand, turned_where, reverse_complement, unpacked
from braidseq.operators import catalogue, minimisers, reconcile
from braidseq.session import pin
from test_seeds import mutated


def test_places_meet_once_for_candidates_and_diagonals(spark, monkeypatch):
    """Places met a second time for the diagonals, and each place of each pair was a row: most of the JVM's time."""
    config = RunConfig(min_shared=3, min_overlap=100, min_containment=50, max_frequency=40)
    rows = [(f"ctg_{i:02d}", s, len(s)) for i, s in enumerate(mutated(random.Random(15)))]
    lists = minimisers.seed_lists(minimisers.numbered(spark.createDataFrame(rows, "sequence_id string, sequence string, length int").repartition(3)), config)
    plain = pin(minimisers.candidates_of(lists, config))
    wanted = {}
    for r in minimisers.place_pairs(lists, plain).collect():
        plus = r["relative"] == "+"
        line = 2 * (r["query_position"] + (-r["target_position"] if plus else r["target_position"])) + (not plus)
        wanted.setdefault((r["query_id"], r["target_id"]), set()).add(line)
    assert len(wanted) > 20
    for added, pair_rows, batch in ((1_000_000, 100_000, 10_000), (50, 7, 5)):
        monkeypatch.setattr(minimisers, "ADDED", added)
        monkeypatch.setattr(minimisers, "PAIR_ROWS", pair_rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = minimisers.lined_candidates(lists, config).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert sorted(repr(r[:-1]) for r in found) == sorted(repr(tuple(r)) for r in plain.collect())
        for r in found:
            lines = struct.unpack(f"<{len(r['lines']) // 8}q", bytes(r["lines"]))
            assert len(lines) == len(set(lines)) and set(lines) == wanted[r["query_id"], r["target_id"]]


def test_codes_of_pairs_are_distinct_for_wide_numbers():
    import numpy as np

    rng = np.random.default_rng(3)
    for parts, rows in ((4, 50), (1 << 20, 1 << 30)):
        q, t = ((rng.integers(0, parts, 500) << 33) + rng.integers(0, rows, 500) for _ in range(2))
        q[250:], t[250:] = q[:250], t[:250]
        assert len(set(minimisers._pair_codes(q, t).tolist())) == len(set(zip(q.tolist(), t.tolist())))


def test_both_strands_are_made_once(spark):
    """The catalogue had each sequence turned by the JVM, a letter at a time, for its digest, its strand and its letters."""
    texts = ["ACGTT", "AACGT", "ACGT", "", None, "acgtRyN", "ACä-GT", "TTTT", "NNA"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sequence string")
    made = rows.select("i", canonical_packed("sequence").alias("f"), canonical(F.col("sequence")).alias("c"), strand(F.col("sequence")).alias("s"), F.sha2(canonical(F.col("sequence")), 256).alias("d"), F.length("sequence").alias("n"), turned_where("sequence", F.col("i") % 2 == 1).alias("t"), F.when(F.col("i") % 2 == 1, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("plain"))
    for r in made.collect():
        assert (r["f"]["digest"], "+" if r["f"]["plus"] else "-", r["f"]["length"]) == (r["d"], r["s"], r["n"])
        assert r["t"] == r["plain"] and (None if r["c"] is None else unpacked(bytes(r["f"]["packed"])).decode()) == r["c"]
    sources = rows.where("sequence is not null").selectExpr("cast(i as string) as identifier", "'s' as source_sample", "cast(i as string) as original_identifier", "sequence", "0 as source_ordinal")
    assert "translate(" not in catalogue.catalogue_sequences(sources)._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_is_asked_for_is_worked_out(spark):
    """Every query of a reconciliation ran all of it, paths, provenance and members too."""
    sequences = spark.createDataFrame([("a", "ACGT", 4)], "sequence_id string, sequence string, length int")
    from braidseq.operators import hits

    none = hits.classify_pairs(spark.createDataFrame([], "query_id string, target_id string, query_length int, query_start int, query_end int, orientation string, target_length int, target_start int, target_end int, matching_bases int, alignment_block_length int"), RunConfig())
    assert set(reconcile.reconcile(sequences, None, none, RunConfig(), ("edges",))) == {"edges"}
    assert set(reconcile.reconcile(sequences, None, none, RunConfig(), ("components",))) == {"edges", "labels", "components"}


def test_seed_measures_need_no_row_a_minimiser(spark):
    """A run's statistics stored a row for each distinct minimiser, only to count them."""
    from braidseq.operators import statistics

    every = spark.createDataFrame([(f,) for f in (1, 1, 1, 2, 5, 5, 9)], "frequency long")
    run = statistics.RunStatistics()
    run.pinned("rows", every, statistics.seed_measures(5))
    run.pinned("counts", every.groupBy("frequency").agg(F.count("*").alias("n")), statistics.seed_measures(5, "n"))
    assert run.values("rows") == run.values("counts")
    assert run.values("counts")["unique_minimisers"] == 7 and run.values("counts")["pair_bound"] == 21 and run.values("counts")["discarded_minimisers"] == 1


def test_windows_share_the_hashes_of_their_kmers(spark):
    """Each k-mer was hashed again for every window of a sweep."""
    rows = [(f"ctg_{i:02d}", s, len(s)) for i, s in enumerate(mutated(random.Random(16)))] + [("ctg_98", "ACGTTGCAAC" * 3, 30), ("ctg_99", "ACGTTGCAACGTACGGATTAC", 21)]
    numbers = minimisers.numbered(spark.createDataFrame(rows, "sequence_id string, sequence string, length int").repartition(3))
    together = minimisers.seed_lists(numbers, RunConfig(window=10, max_frequency=7), counted=True, windows=(5, 10))
    columns = ["key", "frequency", "keys", "places"]
    for i, w in enumerate((5, 10)):
        alone = minimisers.seed_lists(numbers, RunConfig(window=w, max_frequency=7), counted=True)
        kept = [sorted(map(repr, x.where("key is not null").select(*columns).collect())) for x in (together.where(f"window = {i}"), alone)]
        assert kept[0] == kept[1] and len(kept[0]) > 100
        counts = [sorted(map(tuple, x.groupBy("frequency").agg(F.sum("keys")).collect())) for x in (together.where(f"window = {i}"), alone)]
        assert counts[0] == counts[1]
