"""Rounds of the near-duplicate search: nothing within a group is made again, nothing within a ball is passed over."""

import random

from pyspark.sql import functions as F

from braidseq.llm import simhash


def test_pairs_of_one_group_are_not_made(spark):
    """With groups the same pairs, but for those within a group: a cloud in one group gives none."""
    rng = random.Random(31)
    rows = [(i, rng.getrandbits(8), [rng.randrange(30) for _ in range(4)], i % 3) for i in range(400)]
    nodes = spark.createDataFrame(rows, "id long, fp long, parts array<long>, group long")
    plain = {(r["left"], r["right"]) for r in simhash._candidates(nodes.drop("group")).collect()}
    got = {(r["left"], r["right"]) for r in simhash._candidates(nodes).collect()}
    assert got == {(a, b) for a, b in plain if a % 3 != b % 3} and got != plain
    assert simhash._candidates(nodes.withColumn("group", F.lit(0).cast("long"))).count() == 0


def test_every_pair_within_a_ball_is_looked_up(spark):
    """Whatever keys they share: all pairs of different groups within four bits, and those of one fingerprint with its least."""
    rng = random.Random(32)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(1, 6))) for b in base for _ in range(4)]
    rows = [(i, fp, i if rng.random() < 0.7 else 0) for i, fp in enumerate(fps)] + [(1000 + i, fp, 1000 + i) for i, fp in enumerate(base[:5])]
    got = {(r["left"], r["right"]) for r in simhash._within_balls(spark.createDataFrame(rows, "id long, fp long, group long")).collect()}
    one = {}
    for i, fp, g in sorted(rows):
        one.setdefault(fp, (i, fp, g))
    firsts = sorted(one.values())
    wanted = {(a[0], b[0]) for a in firsts for b in firsts if a[0] < b[0] and a[2] != b[2] and (a[1] ^ b[1]).bit_count() <= 4}
    wanted |= {(one[fp][0], i) for i, fp, g in rows if one[fp][0] != i and one[fp][2] != g}
    assert got == wanted and len(wanted) > 80


def test_compared_texts_move_packed(spark, monkeypatch):
    """Of pairs that are compared, packed texts move: with all else 7.0 MB or less, where hashes of shingles made it 12.7 MB."""
    import random
    import time

    def written():
        time.sleep(1)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(400)], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(3000)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join(base[:1500])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    before = written()
    got = {r["key"]: r["component"] for r in simhash.similar_components(docs, "doc_id", "text").collect()}
    moved = written() - before
    assert moved < 9_000_000
    assert all(got[i] == got[i - i % 3] for i in range(180) if i % 3 == 1) and all(got[i] == i for i in range(2, 180, 3))
