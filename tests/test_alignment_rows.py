"""Alignments of many pairs: rows of scores that are held with their gaps, and tasks that don't follow from bytes."""

import random

from pyspark.sql import functions as F

from braidseq.operators import chaining
from braidseq.operators.gapped import GAP, MATCH, MISMATCH, Task, align_all
from braidseq.session import many


def plain(task, free_start):
    """The best score of a task with a free end, cell by cell, and where the first path with it ends."""
    never, best, end = -(1 << 40), 0 if free_start else None, None
    before = {b: 0 if free_start else (-GAP * (b + task.low) if b + task.low >= 0 else never) for b in range(task.high - task.low + 1)}
    for i, x in enumerate(task.query):
        row = {}
        for b in range(task.high - task.low + 1):
            at = i + task.low + b
            met = 0 <= at < len(task.target) and task.target[at] == x
            value = before[b] + (MATCH if met else -MISMATCH) if free_start or at >= 0 else never
            value = max(value, before.get(b + 1, never) - GAP, 0 if free_start else never)
            row[b] = max(value, row.get(b - 1, never) - GAP)
        for b, value in row.items():
            if value > best:
                best, end = value, (i + 1, i + task.low + b + 1)
        before = row
    return best, end


def test_scores_and_ends_equal_the_plain_matrix():
    rng = random.Random(41)
    tasks = []
    for _ in range(60):
        q = bytes(rng.choice(b"ACGT") for _ in range(rng.choice([1, 7, 40, 90])))
        t = bytes(x if rng.random() < 0.95 else rng.choice(b"ACGT") for x in q)
        cut, low = rng.randrange(len(t) + 1), -rng.randrange(12)
        tasks.append(Task(q, t[:cut] + bytes(rng.choice(b"ACGT") for _ in range(rng.randrange(6))) + t[cut:], low, low + rng.randrange(1, 25)))
    for task, path in zip(tasks, align_all(tasks)):
        best, end = plain(task, True)
        assert (path.score, (path.query_end, path.target_end)) == (best, end) if best else path is None


def test_alignments_are_dealt_to_many_tasks(spark):
    """Tasks were united by their bytes: one of ten ran for most of the time, with most cores idle."""
    text = "".join(random.Random(42).choice("ACGT") for _ in range(900))
    table = spark.createDataFrame([(f"s{i}", text[i:]) for i in range(4)], "sequence_id string, sequence string")
    seeds = spark.createDataFrame([("s0", "s1", "+", 21 * i, 21 * i - 1) for i in range(1, 30)], "query_id string, target_id string, orientation string, q int, t int")
    found = chaining.aligned(chaining.chains(seeds), table, table)
    assert found.rdd.getNumPartitions() == 4 * many(spark)
    assert found.select("matching_bases", F.col("cigar")).collect() == [(899, "899M")]
