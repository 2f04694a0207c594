"""Gapped alignment, chains, mapped reads, junctions, pileups: against brute force and planted truth."""

import random

import pytest

from braidseq.config import RunConfig
from braidseq.operators import aligner, chaining, gapped, hits, junctions, minimisers, pileup
from braidseq.operators.cardinality import exactly_one
from braidseq.operators.gapped import GAP, MATCH, MISMATCH, Task, align_all
from braidseq.operators.mapping import map_reads
from braidseq.sources import lines, pileups

NEVER = -(10**9)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def sequence(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def altered(rng, s, edits):
    t = list(s)
    for _ in range(edits):
        at, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.4:
            t[at] = rng.choice("ACGT")
        elif kind < 0.7:
            t.insert(at, rng.choice("ACGT"))
        elif len(t) > 1:
            t.pop(at)
    return "".join(t)


def brute_score(q, t, low, high, free_start, free_end):
    h = [[NEVER] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if (free_start and not (i and j)) or not (i or j):
                h[i][j] = 0
            elif low <= j - i <= high:
                best = 0 if free_start else NEVER
                if i and j:
                    best = max(best, h[i - 1][j - 1] + (MATCH if q[i - 1] == t[j - 1] else -MISMATCH))
                if i and low <= j - i + 1 <= high:
                    best = max(best, h[i - 1][j] - GAP)
                if j and low <= j - i - 1 <= high:
                    best = max(best, h[i][j - 1] - GAP)
                h[i][j] = best
    return max(map(max, h)) if free_end else h[-1][-1]


def walked_score(path, q, t):
    i, j, score, equal = path.query_start, path.target_start, 0, 0
    for letter, n in path.steps:
        for _ in range(n):
            if letter == "M":
                equal += q[i] == t[j]
                score += MATCH if q[i] == t[j] else -MISMATCH
            else:
                score -= GAP
            i, j = i + (letter != "D"), j + (letter != "I")
    assert (i, j, equal) == (path.query_end, path.target_end, path.matches)
    return score


@pytest.mark.parametrize("free_start, free_end", [(True, True), (False, False), (False, True), (True, False)])
def test_paths_have_the_best_score(free_start, free_end):
    rng = random.Random(3)
    tasks = []
    for _ in range(250):
        q = sequence(rng, rng.randint(1, 25))
        t = altered(rng, q, rng.randint(0, 6))
        off = len(t) - len(q)
        tasks.append(Task(q.encode(), t.encode(), min(0, off) - rng.randint(0, 5), max(0, off) + rng.randint(0, 5)))
    for task, path in zip(tasks, align_all(tasks, free_start, free_end)):
        best = brute_score(task.query, task.target, task.low, task.high, free_start, free_end)
        if path is None:
            assert best <= 0
        else:
            assert walked_score(path, task.query, task.target) == path.score == best


def test_empty_sides():
    assert align_all([], True, True) == [] and align_all([Task(b"", b"ACG", 0, 3)], False, False)[0].steps == (("D", 3),)
    assert align_all([Task(b"A", b"C", 0, 0)])[0] is None and align_all([Task(b"A", b"", 0, 0)])[0] is None


def test_longest_rise_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        points = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(0, 12))]
        best = 0
        ordered = sorted(set(points))
        longest = {}
        for t, q in ordered:
            longest[t, q] = 1 + max((longest[p] for p in longest if p[0] < t and p[1] < q), default=0)
            best = max(best, longest[t, q])
        run = chaining.longest_rise(points)
        assert len(run) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:])) and set(run) <= set(points)


def test_long_pairs_are_cut_at_anchors(monkeypatch):
    rng = random.Random(7)
    target = sequence(rng, 9000)
    query = altered(rng, target[500:8500], 60)
    chain, at = [], 0
    for q in range(0, len(query) - 20, 10):
        t = target.find(query[q : q + 20], at, at + 2000)
        if t >= 0:
            chain.append((t, q))
            at = t
    diagonals = [t - q for t, q in chain]
    pair = (query.encode(), target.encode(), chain, min(diagonals) - 16, max(diagonals) + 16)
    whole = chaining.paths_along([pair])[0]
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 1000)
    cut = chaining.paths_along([pair])[0]
    assert walked_score(cut, query, target) == cut.score and walked_score(whole, query, target) == whole.score
    assert cut.score >= whole.score - 10 and abs(cut.target_start - 500) < 20 and abs(cut.target_end - 8500) < 20


def test_reads_are_mapped_to_where_they_were_cut(spark):
    rng = random.Random(1)
    refs = {f"r{i}": sequence(rng, rng.randint(3000, 12000)) for i in range(6)}
    reads, truth = [], {}
    for i in range(60):
        r, n = rng.choice(list(refs)), rng.randint(150, 1500)
        at = rng.randint(0, len(refs[r]) - n)
        s = refs[r][at : at + n]
        s = altered(rng, s, n * (i % 3) // 40)
        reads.append((f"n{i}", rc(s) if i % 2 else s))
        truth[f"n{i}"] = (r, at, at + n, "+-"[i % 2])
    reads += [("stranger", sequence(rng, 800)), ("short", "ACGT"), ("empty", "")]
    found = map_reads(spark.createDataFrame(reads, "name string, sequence string"), spark.createDataFrame(list(refs.items()), "reference string, sequence string")).collect()
    assert sorted(h["query_id"] for h in found) == sorted(truth)
    by_name = dict(reads)
    for h in found:
        r, start, end, strand = truth[h["query_id"]]
        assert (h["target_id"], h["orientation"], h["alignment_type"]) == (r, strand, "P") and abs(h["target_start"] - start) < 16 and abs(h["target_end"] - end) < 16
        q = by_name[h["query_id"]]
        q = rc(q) if strand == "-" else q
        offset = len(q) - h["query_end"] if strand == "-" else h["query_start"]
        path = gapped.Path(h["score"], offset, offset + h["query_end"] - h["query_start"], h["target_start"], h["target_end"], h["matching_bases"], tuple((k, n) for n, k in pileup.cigar_steps(h["cigar"])))
        assert walked_score(path, q, refs[r]) == h["score"]


def test_repeats_compete(spark):
    rng = random.Random(2)
    unit = sequence(rng, 300)
    refs = spark.createDataFrame([("r", unit + sequence(rng, 500) + unit), ("poly", "A" * 4000)], "reference string, sequence string")
    reads = spark.createDataFrame([("x", unit, "r"), ("y", rc(unit), "r"), ("a", "A" * 200, "poly"), ("t", "T" * 200, "poly"), ("none", "C" * 200, "poly")], "name string, sequence string, reference string")
    got = {h["query_id"]: (h["orientation"], h["target_start"], h["mapping_quality"], h["cigar"]) for h in map_reads(reads, refs).collect()}
    assert got == {"x": ("+", 0, 0, "300M"), "y": ("-", 0, 0, "300M"), "a": ("+", 0, 0, "200M"), "t": ("-", 0, 0, "200M")}


def test_planted_gaps_are_found(spark):
    rng = random.Random(4)
    whole = [sequence(rng, 4000) for _ in range(8)]
    rows = [(f"w{i}", s) for i, s in enumerate(whole)]
    for i, s in enumerate(whole):
        part = s[900:2500]
        part = part[:700] + part[709:] if i % 2 else part[:700] + "ACGTACGTA" + part[700:]
        rows.append((f"p{i}", rc(part) if i % 3 == 0 else part))
    sequences = spark.createDataFrame([(a, b, len(b)) for a, b in rows], "sequence_id string, sequence string, length int")
    config = RunConfig()
    seeds = minimisers.sequence_minimisers(sequences, config.kmer, config.window, "sequence_id")
    pairs = minimisers.seed_pairs(minimisers.retained_seeds(seeds, config.max_frequency))
    candidates = minimisers.candidate_pairs(pairs, sequences.select("sequence_id", "length"), config)
    plain = hits.classify_pairs(aligner.diagonal_hits(candidates, pairs, sequences, config), config).where("status = 'candidate'")
    both = {(r["query_id"], r["target_id"]): r for r in hits.classify_pairs(aligner.aligned_hits(candidates, pairs, sequences, config), config).collect()}
    assert plain.count() == 0 and set(both) == {(f"p{i}", f"w{i}") for i in range(8)}
    for (p, _), r in both.items():
        i = int(p[1:])
        assert (r["relationship_type"], r["orientation"]) == ("QUERY_CONTAINED_IN_TARGET", "-" if i % 3 == 0 else "+")
        assert abs(r["target_start"] - 900) <= 2 and abs(r["target_end"] - 2500) <= 2


def test_exactly_one(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("a", "u"), ("b", "v"), ("b", "w"), (None, "n")], "k string, y string")
    met, odd = exactly_one(left, right, ["k"])
    assert [tuple(r) for r in met.collect()] == [("a", 1, "u")]
    assert sorted((r["x"], r["matches"]) for r in odd.collect()) == [(2, 2), (3, 0), (4, 0)]


def junction_tables(spark):
    rng = random.Random(6)
    s = {x: sequence(rng, n) for x, n in (("l", 2500), ("r", 2500), ("m", 1500), ("tiny", 40))}
    s["r"] = s["l"][-500:] + s["r"][500:]
    truth = [("true", "l", "r", True), ("odd", "l", "m", False), ("none", "l", "m", False), ("twice", "l", "m", False), ("type", "l", "m", False), ("lost", "l", "gone", False), ("short", "tiny", "m", False), ("far", "m", "tiny", False)]
    relations = [(c, a, b, junctions.JOINING, "+", 500 if c != "short" else 10) for c, a, b, _ in truth if c != "none"]
    relations += [("twice", "l", "m", junctions.JOINING, "+", 500)]
    relations = [(c, a, b, "EXACT_MATCH" if c == "type" else k, o, e) for c, a, b, k, o, e in relations]
    return s, (
        spark.createDataFrame(truth, "case_id string, left_contig string, right_contig string, junction_is_true boolean"),
        spark.createDataFrame(relations, "case_id string, query_id string, target_id string, relationship_type string, orientation string, target_end int"),
        spark.createDataFrame(list(s.items()), "identifier string, sequence string"),
    )


def test_junctions_from_references_to_evidence(spark):
    s, tables = junction_tables(spark)
    built, broken = junctions.provisional_references(*tables)
    got = {r["case_id"]: r for r in built.collect()}
    assert set(got) == {"true", "odd", "short"} and got["true"]["sequence"] == s["l"] + s["r"][500:] and got["true"]["junction"] == 2500
    assert {(r["case_id"], r["reason"]) for r in broken.collect()} == {
        ("none", "not exactly one ordered relationship"), ("twice", "not exactly one ordered relationship"), ("type", "not a forward suffix-to-prefix relationship"),
        ("lost", "unknown right sequence"), ("far", "the overlap ends outside the right sequence"),
    }
    expected = spark.createDataFrame([("true", s["l"]), ("odd", "ACGT")], "case_id string, sequence string")
    rest, more = junctions.provisional_references(*tables, expected)
    assert [r["case_id"] for r in rest.collect()] == ["short"]
    assert {("true", "not the expected merged sequence"), ("odd", "an artificial junction has an expected sequence")} <= {(r["case_id"], r["reason"]) for r in more.collect()}
    controls, short = junctions.negative_controls(*tables)
    reads = {r["name"]: r["sequence"] for r in controls.collect()}
    assert reads == {"odd:left-end": s["l"][-1000:], "odd:right-after-overlap": s["m"][500:1500]}
    assert ("short", "too short for control reads") in {(r["case_id"], r["reason"]) for r in short.collect()}
    rng, merged = random.Random(9), got["true"]["sequence"]
    own = [("true", f"n{i}", altered(rng, merged[2500 - 300 : 2500 + 300], i)) for i in range(4)] + [("true", "left", rc(merged[1000:1800])), ("true", "stranger", sequence(rng, 500))]
    # A read with a gap at the junction has no unbroken run over it.
    own += [("true", "broken", merged[2200:2495] + merged[2505:2900])]
    reads = controls.select("case_id", "name", "sequence").unionByName(spark.createDataFrame(own, "case_id string, name string, sequence string"))
    found = {r["case_id"]: r for r in junctions.remapping_evidence(built, reads, 50).collect()}
    assert (found["true"]["selected_reads"], found["true"]["remapped_reads"]) == (7, 6) and 1 <= found["true"]["spanning_reads"] <= 4
    assert (found["odd"]["remapped_reads"], found["odd"]["spanning_reads"]) == (2, 0)
    assert (found["short"]["selected_reads"], found["short"]["diagnostics"]) == (0, junctions.NO_READS)


def test_reads_are_selected_at_the_joined_ends(spark):
    requests = spark.createDataFrame([("c", "l", "r")], "case_id string, left_contig string, right_contig string")
    placed = [("a", "l", 900, "80M"), ("b", "l", 10, "80M"), ("c", "r", 10, "80M"), ("d", "r", 900, "80M"), ("a", "r", 0, "10M"), ("e", "x", 0, "90M")]
    reads = spark.createDataFrame([(n, n * 5) for n in "abcde"], "name string, sequence string")
    lengths = spark.createDataFrame([("l", 1000), ("r", 1000), ("x", 1000)], "reference string, length int")
    chosen = junctions.select_reads(requests, spark.createDataFrame(placed, "name string, reference string, position int, cigar string"), reads, lengths, 100)
    assert sorted(tuple(r) for r in chosen.collect()) == [("c", "a", "aaaaa"), ("c", "c", "ccccc")]


def test_depth_and_pileup_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pileup, "MOST_BINS", 2)
    rng, rows = random.Random(8), []
    for i in range(300):
        steps = rng.choice(["30M", "10M5D10M", "5S20M3I4M", "8M2500N9M", "4=1X6="])
        n = sum(k for k, x in pileup.cigar_steps(steps) if x in "MIS=X")
        rows.append((f"r{i % 2}", rng.choice([0, 5, 2040, 2045, 5000]) + rng.randint(0, 9), steps, "".join(rng.choice("ACGTNacgtR") for _ in range(n)), "".join(rng.choice("!5I") for _ in range(n)), rng.choice([0, 60, None])))
    broken = [("r0", 1, "5M", "ACGT", "IIII", 1), ("r0", None, "4M", "ACGT", "IIII", 1), ("r0", 1, "4Z", "ACGT", "IIII", 1), ("r0", 1, "4M", "ACGT", "III", 1), (None, 1, "4M", "ACGT", "IIII", 1), ("r0", 1, None, None, None, 1)]
    reads = spark.createDataFrame(rows + broken, "reference string, position int, cigar string, sequence string, qualities string, mapping_quality int").repartition(5)
    want = {}
    for ref, at, steps, bases, scores, quality in rows:
        i = 0
        for n, k in pileup.cigar_steps(steps):
            for x in range(n if k != "S" else 0):
                if k == "I":
                    continue
                cell = want.setdefault((ref, at + x), [0, {}, [], []])
                cell[0] += 1
                cell[3].append(quality or 0)
                if k in "M=X":
                    letter = bases[i + x].upper()
                    letter = letter if letter in "ACGT" else "N"
                    cell[2].append(ord(scores[i + x]) - 33)
                if k != "N":
                    letter = letter if k != "D" else "*"
                    cell[1][letter] = cell[1].get(letter, 0) + 1
            i += n if k in "MIS=X" else 0
            at += n if k in "M=XDN" else 0
    got = {(r["reference"], r["position"]): r for r in pileup.pileup_reads(reads).collect()}
    assert set(got) == set(want)
    for key, (depth, alleles, scores, qualities) in want.items():
        r = got[key]
        assert (r["depth"], r["alleles"]) == (depth, ",".join(f"{a}:{n}" for a, n in sorted(alleles.items())))
        assert r["mean_base_quality"] == (pytest.approx(sum(scores) / len(scores)) if scores else None) and r["mean_mapping_quality"] == pytest.approx(sum(qualities) / len(qualities))
    assert sorted(r["error"] for r in pileup.unplaced_reads(reads).collect()) == ["CIGAR and sequence differ in length", "malformed CIGAR", "malformed CIGAR", "no reference", "position", "sequence and qualities differ in length"]
    region = pileup.pileup_region(reads, "r0", 4990, 5010).orderBy("position").collect()
    assert [(r["position"], r["depth"]) for r in region] == [(x, want.get(("r0", x), [0])[0]) for x in range(4990, 5010)] and region[0]["mean_base_quality"] is None
    intervals = [(f"r{i % 3}", (a := rng.randint(0, 9000)), a + rng.choice([-3, 0, 1, 50, 5000])) for i in range(200)]
    depth = {}
    for ref, a, b in intervals:
        for x in range(a, b):
            depth[ref, x] = depth.get((ref, x), 0) + 1
    runs = pileup.depth_runs(spark.createDataFrame(intervals, "reference string, start int, end int")).collect()
    assert {(r["reference"], x): r["depth"] for r in runs for x in range(r["start"], r["end"])} == depth and sum(r["end"] - r["start"] for r in runs) == len(depth)
    assert pileup.pileup_reads(reads.limit(0)).count() == 0 and pileup.depth_runs(spark.createDataFrame([], "reference string, start int, end int")).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 500), ("b.txt", 7), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 507 and all(value == f"{name} {line}" for name, line, value in got)


def test_pileup_text(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("c\t1\tA\t3\t.,g\tIII\t555\nc\t2\tA\t0\t*\t*\t*\nc\t2\tA\t0\t*\t*\t*\n\nc\tx\tA\t1\t.\tI\tI\nc\t9\tA\t1\t.\tI\tI\nc\t3\tA\t-1\t.\tI\tI\nc\t4\tA\t1\t.\tI\nc\t5\tA\t1\t.\tII\tI\nc\t6\tA\t1\t.\t \tI\nd\t1\tA\t1\t.\tI\tI\n")
    rows = {r["line"]: r for r in pileups.read_mpileup(spark, str(path), spark.createDataFrame([("c", 8)], "reference string, length int")).collect()}
    assert (rows[1]["position"], rows[1]["alleles"], rows[1]["mean_base_quality"], rows[1]["mean_mapping_quality"]) == (0, "A:2,G:1", 40.0, 20.0)
    assert {k: r["error"] for k, r in rows.items()} == {
        1: None, 2: "repeated position", 3: "repeated position", 5: "invalid numeric field", 6: "unexpected reference or position", 7: "depth cannot be negative",
        8: "expected three fields and four for each sample", 9: "base and mapping quality counts differ", 10: "invalid quality encoding", 11: "unexpected reference or position",
    }
