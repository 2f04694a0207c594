"""Edits, validation, samples, statistics, readers with errors by line."""

import gzip
import hashlib
import random

import pytest

from braidseq.config import InputError, RunConfig
from braidseq.operators import aligner, evidence, hits, minimisers, mutations, scoring, statistics, validation
from braidseq.sources import alignments, sequences, sinks
from braidseq.sources.synthetic import END_TOLERANCE, MIN_OVERLAP, synthetic_cases

EDIT = "identifier string, position int, kind string, length int, bases string"


def test_edits_equal_brute_force_and_places_are_lifted(spark):
    rng, rows, edits = random.Random(3), [], []
    for i in range(12):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 200, 900])))
        rows.append((f"s{i}", s))
        at = 0
        while at + 4 < len(s) and rng.random() < 0.95:
            kind = rng.choice(["substitution", "insertion", "deletion"])
            bases = {"substitution": "ACGT"["ACGT".index(s[at]) - 1], "insertion": "GATTACA"[: rng.randint(1, 7)], "deletion": None}[kind]
            edits.append((f"s{i}", at, kind, rng.randint(1, 3), bases))
            at += rng.randint(4, 40)
    want, truth, index = {}, set(), {}
    for name, s in rows:
        letters = [[i] for i in range(len(s) + 1)]
        text, origin, shift = "", [], 0
        own = sorted(e[1:] for e in edits if e[0] == name)
        at = 0
        for position, kind, length, bases in own:
            text += s[at:position]
            origin += range(at, position)
            removed = {"substitution": 1, "insertion": 0, "deletion": length}[kind]
            new = bases or ""
            truth.add((name, position, kind, s[position : position + removed], new, len(text)))
            text += new
            origin += [position if kind == "substitution" else None] * len(new)
            at = position + removed
        want[name], index[name] = text + s[at:], origin + list(range(at, len(s)))
        assert letters and shift == 0
    table = spark.createDataFrame(rows, "identifier string, sequence string")
    edited, made = mutations.apply_edits(table, spark.createDataFrame(edits, EDIT))
    assert {r["identifier"]: r["sequence"] for r in edited.collect()} == want
    assert {(r["identifier"], r["position"], r["kind"], r["old"], r["new"], r["edited_position"]) for r in made.collect()} == truth
    assert mutations.edit_errors(table, spark.createDataFrame(edits, EDIT)).count() == 0
    places = [(name, a, b) for name, s in rows if len(s) > 10 for a, b in [sorted((rng.randint(0, len(s)), rng.randint(0, len(s)))) for _ in range(20)] if a < b]
    lifted = mutations.lift(made, spark.createDataFrame(places, "identifier string, start int, end int")).collect()
    for r in lifted:
        inside = [k for k, o in enumerate(index[r["identifier"]]) if o is not None and r["start"] <= o < r["end"]]
        if inside:
            assert r["edited_start"] <= inside[0] and r["edited_end"] >= inside[-1] + 1
            gaps = [o for o in index[r["identifier"]][r["edited_start"] : r["edited_end"]] if o is not None]
            assert gaps == [index[r["identifier"]][k] for k in inside]


def test_edits_that_break_a_rule(spark):
    table = spark.createDataFrame([("a", "ACGTACGTAC")], "identifier string, sequence string")
    edits = [("a", 0, "substitution", 1, "A"), ("a", 9, "deletion", 5, None), ("a", -1, "insertion", 1, "A"), ("b", 0, "deletion", 1, None), ("a", 1, "odd", 1, None), ("a", 3, "insertion", 0, ""), ("a", 5, "deletion", 2, None), ("a", 6, "substitution", 1, "A"), ("a", 8, "insertion", 0, "TT")]
    got = sorted((r["position"], r["reason"]) for r in mutations.edit_errors(table, spark.createDataFrame(edits, EDIT)).collect())
    assert got == [(-1, "outside the sequence"), (0, "the base stays the same"), (0, "unknown sequence"), (1, "unknown kind"), (3, "nothing is added or removed"), (5, "overlaps another edit"), (6, "overlaps another edit"), (9, "outside the sequence")]
    edited, truth = mutations.apply_edits(table, spark.createDataFrame(edits, EDIT))
    assert [r["sequence"] for r in edited.collect()] == ["ACGTACGTTTAC"] and truth.count() == 1


def test_planted_substitutions(spark):
    table = spark.createDataFrame([("a", "ACGTN" * 100), ("b", "C" * 31)], "identifier string, sequence string")
    planted = mutations.planted_substitutions(table, 31, 5)
    assert planted.groupBy("identifier").count().select("count").distinct().collect() == [(31,)]
    edited, truth = mutations.apply_edits(table, planted)
    assert truth.count() == 62 and mutations.edit_errors(table, planted).count() == 0
    for r in edited.collect():
        old = {"a": "ACGTN" * 100, "b": "C" * 31}[r["identifier"]]
        assert sum(x != y for x, y in zip(old, r["sequence"])) == 31
    with pytest.raises(InputError):
        mutations.planted_substitutions(table, 32)


def test_suffix_and_prefix_are_merged(spark):
    rows = [("ACGT", "GTCC", 2), ("ACGT", "GACC", 2), ("ACGT", "GT", 3), ("ACGT", "CC", 0), ("A", "C", None)]
    got = mutations.merge_suffix_prefix(spark.createDataFrame(rows, "left_sequence string, right_sequence string, overlap int")).collect()
    assert [(r["merged"], r["reason"]) for r in got] == [("ACGTCC", None), (None, "overlap sequences differ"), (None, "overlap outside the sequences"), ("ACGTCC", None), (None, "overlap outside the sequences")]


def test_a_sound_dataset_has_no_errors(spark):
    s = {"l": "ACGTACGTAC", "r": "GTACCCCC", "t": "GGGGGTAC"}
    table = spark.createDataFrame(list(s.items()), "identifier string, sequence string")
    contigs = spark.createDataFrame([(k, len(v), False, None, None) for k, v in s.items()], "identifier string, length int, circular_wrap boolean, source_start int, source_end int")
    rows = [("c1", "l", "r", validation.MERGING, "+", 0, 4, True), ("c2", "l", "t", validation.MERGING, "-", 4, 8, True)] + [(f"x{i}", "l", "r", kind, "+", 0, 1, False) for i, kind in enumerate(validation.CLASSES)]
    relations = spark.createDataFrame(rows, "case_id string, query_id string, target_id string, relationship_type string, orientation string, target_start int, target_end int, merge_allowed boolean")
    muts = spark.createDataFrame([("c1", "substitution")] * 2, "case_id string, kind string")
    counts = spark.createDataFrame([("c1", "substitution", 2), ("c2", "substitution", 0)], "case_id string, kind string, n int")
    merged = spark.createDataFrame([("c1", s["l"] + s["r"][4:]), ("c2", s["l"] + "GTACCCCC"[4:])], "case_id string, sequence string")
    pairs = spark.createDataFrame([("l", "r"), ("l", "t")], "query_id string, target_id string")
    reads = spark.createDataFrame([("f", "a"), ("f", "b")], "file string, name string")
    assert validation.validate_dataset(table, contigs, relations, muts, counts, merged, pairs, reads).collect() == []


def test_nested_samples(spark, monkeypatch):
    table = spark.range(3000).selectExpr("concat('s', id) as identifier", "id as x")
    ranked = sorted((hashlib.sha256(f"4\0s{i}".encode()).hexdigest(), f"s{i}") for i in range(3000))
    for most in (100_000, 0):
        monkeypatch.setattr(sequences, "MOST_ORDERED", most)
        for n in (1, 2, 700, 2999, 3000):
            assert {r["identifier"] for r in sequences.nested_sample(table, n, 4).collect()} == {name for _, name in ranked[:n]}
    for bad in (0, 3001):
        with pytest.raises(InputError):
            sequences.nested_sample(table, bad)
    with pytest.raises(InputError, match="repeat"):
        sequences.nested_sample(table.unionByName(table.limit(1)), 5)


def test_many_samples_are_one_scan(spark, tmp_path):
    manifest = []
    for i in range(300):
        path = tmp_path / f"s {i}.fa{'.gz' if i % 50 == 0 else ''}"
        text = "".join(f">c{k} about {k}\nAC\nGT{'A' * k}\n" for k in range(3))
        path.write_bytes(gzip.compress(text.encode()) if i % 50 == 0 else text.encode())
        manifest.append({"sample": f"s{i:03d}", "contigs": str(path)})
    found = sequences.scan_samples(spark, manifest)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2  # one scan and the count of its splits
    rows = found.collect()
    assert len(rows) == 900 and len({r["identifier"] for r in rows}) == 900
    assert all(r["sequence"] == "ACGT" + "A" * r["source_ordinal"] and r["identifier"] == f"{r['source_sample']}:c{r['source_ordinal']}" and r["description"] == f"about {r['source_ordinal']}" for r in rows)
    assert sequences.load_samples(spark, manifest[:2]).count() == 6


def test_sam_errors_by_line(spark, tmp_path):
    path = tmp_path / "x.sam"
    record = lambda name="n", flag=0, ref="r", at=3, quality=60, steps="4M": f"{name}\t{flag}\t{ref}\t{at}\t{quality}\t{steps}\t*\t0\t0\tACGT\tIIII"
    path.write_text("\n".join(["@HD\tVN:1", "@SQ\tSN:r\tLN:9", "@SQ\tSN:r\tLN:9", "@SQ\tSN:q", "@SQ\tSN:z\tLN:x", "@SQ\tSN:y\tLN:0", record("good"), "", "cut\t0\tr", record("flag", "x"), record("q", quality=256), record("steps", steps="4Q"), record("ref", ref="other"), record("far", at=7), record("star", steps="*"), record("second", flag=256), record("un", flag=4, ref="*", at=0)]) + "\n")
    rows = {r["line"]: (r["name"], r["error"]) for r in alignments.read_sam(spark, str(path)).collect()}
    assert rows == {
        7: ("good", None), 9: ("cut", "fewer than eleven fields"), 10: ("flag", "a number is malformed"), 11: ("q", "mapping quality"), 12: ("steps", "malformed CIGAR"),
        13: ("ref", "a reference that the header does not name"), 14: ("far", "the alignment lies outside its reference"), 15: ("star", None),
    }
    bare = tmp_path / "bare.sam"
    bare.write_text(record() + "\n")
    got = {(r["file"].rsplit("/", 1)[1], r["line"], r["error"]) for r in alignments.sam_reference_errors(spark, str(tmp_path)).collect()}
    assert got == {("x.sam", 3, "repeated reference"), ("x.sam", 4, "SN and LN are required"), ("x.sam", 5, "a length is malformed"), ("x.sam", 6, "a length is positive"), ("bare.sam", None, "no reference in the header")}
    assert [r["error"] for r in alignments.read_sam(spark, str(bare)).collect()] == [None]


def test_paf_to_scores(spark, tmp_path):
    path = tmp_path / "x.paf"
    good = "q\t100\t0\t100\t+\tt\t900\t5\t105\t100\t100\t60\ttp:A:P"
    path.write_text("\n".join([good, "", good.replace("\tt\t", "\tq\t"), "q\t1", good.replace("\t100\t100\t60", "\t101\t100\t60"), good.replace("\t100\t100\t60", "\t100\t300\t60"), good.replace("\t100\t100\t60", "\t90\t99\t60")]) + "\n")
    truth = spark.createDataFrame([("q", "t", "c", "QUERY_CONTAINED_IN_TARGET", "+", "VALID", True, ""), ("q", "u", "d", "EXACT_MATCH", "+", "VALID", True, "")],
                                  "query_id string, target_id string, case_id string, expected_relationship string, expected_orientation string, expected_status string, merge_allowed boolean, ambiguity_group string")
    counts, errors = scoring.evaluate_paf(alignments.read_paf(spark, str(path)), truth, RunConfig(min_containment=50))
    got = {(r["measure"], r["relationship_type"]): r["n"] for r in counts.collect()}
    assert (got["correct", None], got["missed", None], got["observed", None]) == (1, 1, 1)
    assert sorted((r["line"], r["error"]) for r in errors.collect()) == [(4, "fewer than twelve fields"), (5, "matching bases and block length"), (6, "a block longer than both aligned spans"), (7, "a block shorter than an aligned span")]


def test_statistics_take_no_job_of_their_own(spark):
    run = statistics.RunStatistics()
    table = spark.range(101).selectExpr("cast(id as int) as length", "if(id % 2 = 0, '+', '-') as strand")
    run.pinned("rows", table, statistics.lengths("length") | statistics.by_value("strand", "+-"))
    seen = run.values("rows")
    assert (seen["rows"], seen["bases"], seen["median"], seen["empty"], seen["strand_+"], seen["from_64_below_128"]) == (101, 5050, 50, 1, 51, 37)
    assert run.rows(spark).count() == len(seen) and run.rows(spark, seconds=True).count() == len(seen) + 1
    run.pinned("none", table.limit(0), statistics.lengths("length"))
    assert set(run.values("none").values()) == {0.0}
    frequency = spark.createDataFrame([("a", 3), ("b", 200), ("c", 1)], "value string, frequency long")
    run.pinned("seeds", frequency, statistics.seed_measures(100))
    assert run.values("seeds") == {"unique_minimisers": 3, "observations": 204, "discarded_minimisers": 1, "retained_observations": 4, "pair_bound": 3, "most_frequent": 200}
    statistics.guard_seed_pairs(run, "seeds", 3)
    for bad in (lambda: statistics.guard_seed_pairs(run, "seeds", 2), lambda: run.pinned("rows", table, {})):
        with pytest.raises(InputError):
            bad()


def test_observations_and_names(spark, tmp_path):
    truth = spark.createDataFrame([("a", "l", "r"), ("b", "l", "r")], "case_id string, left_contig string, right_contig string")
    rows = [("a", "s1", "l", "r", "x", 9, "d", 4), ("a", "s1", "l", "r", "x", 9, "d", 5), ("b", "s1", "l", "q", "x", 9, "d", 4), ("c", "s1", "l", "r", "x", 9, "d", 4)]
    seen = spark.createDataFrame(rows, "case_id string, sample string, left_contig string, right_contig string, reference string, reference_length int, reference_sha256 string, junction int")
    got = {(r["case_id"], r["reason"]) for r in evidence.observation_violations(truth, seen).collect()}
    assert got == {("a", "duplicate sample"), ("a", "not one identical provisional junction"), ("b", "pair differs from the truth"), ("c", "unknown case")}
    assert {(r["testable"], r["diagnostics"]) for r in evidence.source_evidence(seen).collect()} == {(False, evidence.NOT_TESTABLE)}
    path = tmp_path / "n.sam"
    path.write_text("".join(f"{n}\t0\tr\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\n" for n in "bab") + "cut\t0\n")
    assert [r["name"] for r in evidence.read_names(alignments.read_sam(spark, str(path))).collect()] == ["a", "b"]
    with pytest.raises(InputError, match="repeated output: a"):
        sinks.fasta_lines(spark.createDataFrame([("a", "A"), ("a", "C"), ("b", "G")], "output_sequence string, sequence string"))


def test_synthetic_cases_are_classified(spark):
    cases = synthetic_cases(spark)
    config = RunConfig(min_overlap=MIN_OVERLAP, min_containment=MIN_OVERLAP, end_tolerance=END_TOLERANCE, kmer=15, window=5, min_shared=3)
    rows = cases.collect()
    assert len(rows) == 13
    table = spark.createDataFrame([(f"{r['case_id']}:{side}", r[name], len(r[name])) for r in rows for side, name in (("a", "query"), ("b", "target"))], "sequence_id string, sequence string, length int")
    seeds = minimisers.sequence_minimisers(table, config.kmer, config.window, "sequence_id")
    pairs = minimisers.seed_pairs(minimisers.retained_seeds(seeds, 400)).where("substring_index(query_id, ':', 1) = substring_index(target_id, ':', 1)")
    candidates = pairs.select("query_id", "target_id").distinct()
    decided = {r["query_id"].split(":")[0]: r["relationship_type"] for r in hits.classify_pairs(aligner.aligned_hits(candidates, pairs, table, config), config).collect()}
    assert {r["case_id"]: decided.get(r["case_id"], "NO_RELATIONSHIP") for r in rows} == {r["case_id"]: r["expected"] for r in rows}
