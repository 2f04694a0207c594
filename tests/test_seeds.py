"""Seeds by batches, and candidate pairs without rows of places, against the plain joins."""

import random
import time

import pyarrow as pa

from braidseq.config import RunConfig
from braidseq.operators import minimisers
from braidseq.session import pin
from test_operators import brute_minimisers, rc


def chunk_batch(parts, w):
    n = len(parts)
    columns = [pa.array(range(n), pa.int64()), pa.array([w] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["sequence_id", "w", "first", "base", "part"])


def test_seeds_leave_in_bounded_batches(monkeypatch):
    """A batch of many chunks doesn't become one batch of all their seeds."""
    monkeypatch.setattr(minimisers, "BATCH", 200)
    rng = random.Random(5)
    parts = ["".join(rng.choice("ACGT") for _ in range(300)).encode() for _ in range(40)]
    made = list(minimisers._selected(21, 8192)([chunk_batch(parts, 10)]))
    assert len(made) > 5 and max(b.num_rows for b in made) < 200 + 280
    assert sum(b.num_rows for b in made) == sum(len(brute_minimisers(p.decode(), 21, 10)) for p in parts)


def test_long_kmers_odd_symbols_and_palindromes():
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(150)) + "N" + "ACGT" * 20 + "RY" + "".join(rng.choice("ACGT") for _ in range(90))
    for k, w in ((40, 7), (6, 1), (21, 10)):
        (batch,) = minimisers._selected(k, 8192)([chunk_batch([text.encode()], w)])
        rows = batch.to_pylist()
        found = [(r["position"], r["value"]) for r in rows]
        assert len(found) == len(set(found)) and set(found) == brute_minimisers(text, k, w)
        for r in rows:
            f = text[r["position"] : r["position"] + k]
            assert r["kmer"] == min(f, rc(f)) and r["orientation"] == ("+" if f <= rc(f) else "-")


def mutated(rng, n=60):
    """Sequences that share stretches on both strands, some of them twice."""
    stock = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(25)]
    out = []
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(30)) for _ in range(rng.randint(0, 9))]
        out.append("".join(rc(p) if rng.random() < 0.3 else p for p in parts))
    return sorted(set(out))


def test_candidates_by_numbers_equal_the_joins_of_places(spark):
    config = RunConfig(min_shared=3, min_overlap=100, min_containment=50, max_frequency=40)
    rows = [(f"ctg_{(7 * i) % 100:02d}", s, len(s)) for i, s in enumerate(mutated(random.Random(8)))]
    table = spark.createDataFrame(rows, "sequence_id string, sequence string, length int").repartition(5)
    seeds = pin(minimisers.retained_seeds(minimisers.sequence_minimisers(table, config.kmer, config.window, "sequence_id"), config.max_frequency))
    pairs = pin(minimisers.seed_pairs(seeds))
    numbers = minimisers.numbered(table)
    order = [r["name"] for r in numbers.sort("sequence_id").collect()]
    assert order == sorted(r[0] for r in rows)
    places = minimisers.seed_places(numbers, config)
    found = pin(minimisers.candidates_of(places, config))
    same = lambda a, b: sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    plain = pin(minimisers.candidate_pairs(pairs, table, config))
    assert plain.count() > 20 and same(minimisers.named(found, numbers), plain)
    assert same(minimisers.named(minimisers.shared_seeds(places), numbers), minimisers.pair_evidence(pairs))
    wanted = pairs.join(plain, ["query_id", "target_id"], "left_semi").drop("kmer")
    assert same(minimisers.named(minimisers.place_pairs(places, found), numbers), wanted)


def test_stored_seeds_take_little_disk(spark, tmp_path):
    """A seed is numbers, not names: under 40 bytes a place, where a pinned row of names took over 150."""
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(4000))
    rows = [("ctg_" + f"{i:064x}", text[: 3000 + 10 * i], 3000 + 10 * i) for i in range(60)]
    places = minimisers.seed_places(minimisers.numbered(spark.createDataFrame(rows, "sequence_id string, sequence string, length int")), RunConfig())
    places.write.parquet(f"{tmp_path}/places")
    size = sum(p.stat().st_size for p in (tmp_path / "places").glob("*.parquet"))
    assert places.count() > 30_000 and size < 40 * places.count()
    assert {k for _, k in places.dtypes} == {"bigint", "int", "boolean", "tinyint"}


def written(spark):
    """Bytes that shuffles wrote so far."""
    time.sleep(1)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_seeds_move_packed(spark):
    """Most seeds occur once; as rows each took about 17 bytes of shuffle, and the letters moved twice more at 0.7 bytes."""
    rng = random.Random(12)
    rows = [(f"ctg_{i:03d}", "".join(rng.choice("ACGT") for _ in range(10_000)), 10_000) for i in range(200)]
    table = spark.createDataFrame(rows, "sequence_id string, sequence string, length int")
    before = written(spark)
    numbers = minimisers.numbered(table)
    after = written(spark)
    assert after - before < 0.35 * 2_000_000
    lists = minimisers.seed_lists(numbers, RunConfig(), counted=True)
    seeds = lists.selectExpr("sum(keys * frequency)").first()[0]
    assert 300_000 < seeds and written(spark) - after < 9 * seeds


def test_listed_seeds_count_every_frequency_and_long_kmers(spark, monkeypatch):
    """Keys above the bound are counted in full though few of their places leave a task; k-mers of more than two bits a base in a long too."""
    rows = [(f"ctg_{i:02d}", s, len(s)) for i, s in enumerate(mutated(random.Random(13)))] + [("ctg_99", "A" * 900, 900)]
    table = spark.createDataFrame(rows, "sequence_id string, sequence string, length int").repartition(3)
    monkeypatch.setattr(minimisers, "FEW_CHUNKS", 0)
    for k in (21, 6, 31, 33):
        config = RunConfig(kmer=k, min_shared=3, min_overlap=100, min_containment=50, max_frequency=7)
        wanted = minimisers.minimiser_frequency(minimisers.sequence_minimisers(table, k, config.window, "sequence_id")).groupBy("frequency").count()
        lists = minimisers.seed_lists(minimisers.numbered(table), config, counted=True)
        assert sorted(lists.groupBy("frequency").agg({"keys": "sum"}).collect()) == sorted(wanted.collect())
        kept = lists.where("places is not null")
        assert kept.where("size(places) <> frequency or frequency not between 2 and 7").count() == 0


def test_place_pairs_of_lists_move_no_places(spark, monkeypatch):
    """Places meet in their lists, whether candidates are broadcast or not; before, every place was shuffled for each candidate of its sequence."""
    config = RunConfig(min_shared=3, min_overlap=100, min_containment=50, max_frequency=40)
    rows = [(f"ctg_{i:02d}", s, len(s)) for i, s in enumerate(mutated(random.Random(14)))]
    numbers = minimisers.numbered(spark.createDataFrame(rows, "sequence_id string, sequence string, length int").repartition(3))
    lists = minimisers.seed_lists(numbers, config)
    found = pin(minimisers.candidates_of(lists, config))
    before = written(spark)
    pairs = minimisers.place_pairs(lists, found)
    made = sorted(map(tuple, pairs.collect()))
    assert len(made) > 1000 and written(spark) - before < 1000
    monkeypatch.setattr(minimisers, "MOST_BROADCAST", 3)
    monkeypatch.setattr(minimisers, "ADDED", 50)
    assert sorted(map(tuple, minimisers.place_pairs(minimisers.places_of(lists), found).collect())) == made
