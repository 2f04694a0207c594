"""The network's gradients and accuracy, and the pipeline's stages."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from braidseq.llm import toxicity as tox
from braidseq.llm.decontaminate import find_contamination, with_verdict


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = tox.Model({}, {k: v.astype(np.float64) for k, v in tox._fresh(3, rng).items()})
    projected = rng.standard_normal((2, 5, 3 * tox._UNITS))
    ids = np.array([[1, 2, 3, 0], [4, 1, 0, 0], [0, 0, 0, 0]])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = 1 / (1 + np.exp(-model.run(projected, ids)))
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum())

    grad = model.gradient(projected, ids, label, weight)
    for name, values in [(k, model.weights[k]) for k in ("hidden", "attend", "attend_out", "attend_bias", "out", "out_bias")] + [("projected", projected)]:
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 12)]:
            before, step = values[at], 1e-3
            values[at] = before + step
            high = loss()
            values[at] = before - step
            low = loss()
            values[at] = before
            assert abs((high - low) / (2 * step) - grad[name][at]) < 5e-3, (name, at)


def test_gradients_of_the_byte_network_equal_differences():
    rng = np.random.default_rng(2)
    model = tox.Model({}, {k: v.astype(np.float64) for k, v in tox._fresh(3, rng).items()})
    words = [b"abc", b"a", b"zebra", "é".encode(), b"zz"]
    wanted = rng.standard_normal((5, 2 * tox._BYTE_UNITS))
    keep = []
    model.spell(words, keep)
    grad = model.spell_back(wanted, keep)
    for name in ("bytes", "byte_in", "byte_bias", "byte_hidden"):
        values = model.weights[name]
        places = [(b, 0) for b in b"abze"] if name == "bytes" else list(np.ndindex(values.shape))[:: max(1, values.size // 12)]
        for at in places:
            before, step = values[at], 1e-5
            values[at] = before + step
            high = float((model.spell(words) * wanted).sum())
            values[at] = before - step
            low = float((model.spell(words) * wanted).sum())
            values[at] = before
            assert abs((high - low) / (2 * step) - grad[name][at]) < 1e-6, (name, at)


def test_the_order_of_characters_counts():
    model = tox.Model({}, tox._fresh(2, np.random.default_rng(3)))
    one, two, same = model.spell([b"abcdef", b"abdcef", b"abcdef"])
    assert (one == same).all() and abs(one - two).max() > 1e-4


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 300))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zzidiot", "qqmoron", "xxstem" + rng.choice("abcdefgh") * 2])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9001, None, 0.0), (9002, "", 0.0), (None, "abc", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9001, 1, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = tox.train_toxicity(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, model).collect()}
    assert scored[9001] == scored[9002] and all(0 <= s <= 1 for s in scored.values())
    held = [(scored[i] >= tox.THRESHOLD, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == bool(y) for p, y in held]) > 0.95
    assert tox.score_toxicity(docs.where("false"), model).count() == 0


def test_held_out_figures(spark):
    """On the table of 10,000 documents; that of 1,000 holds out 14 toxic ones, too few to tell."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = tox.train_toxicity(docs, labels)
    held = labels.where(tox.remainder(F.col("doc_id")) == 2)
    scored = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs.join(held, "doc_id", "left_semi").select("doc_id", "text"), model).collect()}
    pairs = [(scored[r["doc_id"]] >= tox.THRESHOLD, r["toxic"] == 1) for r in held.collect()]
    both = sum(p and y for p, y in pairs)
    assert 2 * both / (sum(p for p, _ in pairs) + sum(y for _, y in pairs)) >= 0.75


def test_reruns_give_the_same_model(spark):
    rows = corpus(120, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    one, two = tox.train_toxicity(docs, labels), tox.train_toxicity(docs.repartition(7), labels)
    assert one.shift == two.shift and all((one.weights[k] == two.weights[k]).all() for k in one.weights)


def test_a_text_beyond_the_bytes_left_is_passed_over_whole(spark, monkeypatch):
    monkeypatch.setattr(tox, "MOST_BYTES", 3000)
    docs = spark.createDataFrame([(i, "w " * (5000 if i == 3 else 200)) for i in range(20)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = tox.training_sample(docs, labels).collect()
    assert len({r["id"] for r in rows}) == len(rows) and 3 not in {r["id"] for r in rows}
    for value in (0, 1):
        assert 0 < 400 * sum(r["label"] == value for r in rows) <= 3000
    long = tox._cutter()("x" * 100 + " y")
    assert b"".join(long) == b"x" * 100 + b"y" and max(map(len, long)) == tox.PIECE


def test_training_ignores_held_out_labels(spark):
    rows = corpus(40, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    ids = {r["id"] for r in tox.training_sample(docs, labels).collect()}
    assert ids == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    model = tox.train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert tox.score_toxicity(docs, model).first()["score"] < tox.THRESHOLD


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        before_ids, ids = [r["doc_id"] for r in docs.select("doc_id").collect()], [r["doc_id"] for r in after.select("doc_id").collect()]
        if name != "sharding":
            assert after.columns == names
        if name == "near_duplicates":
            from test_text_operators import check_kept

            rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
            check_kept([t for _, t in rows], {k for k, (i, _) in enumerate(rows) if i in set(ids)})
        if name == "decontamination":
            bad = {r["doc_id"] for r in with_verdict(find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
            assert set(ids) == set(before_ids) - bad
        if name == "mixing":
            assert set(ids) <= set(before_ids) and max(ids.count(i) for i in set(ids)) <= 2
        if name == "sharding":
            assert sorted(ids) == sorted(before_ids) and {r["shard"] for r in after.collect()} == set(range(8))
        docs = after


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like the operators' results, null and repeated ids, null, empty and long texts, ties."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    rows = [(1, "same words here and there again", "a"), (2, "same words here and there again", "a"), (None, None, None), (None, None, None), (3, "", "b"), (4, "word " * 30_000, "b"), (5, None, "a"), (5, "another text of a few words", None), (5, "another text of a few words", None)]
    clashing = ["size", "hits", "score", "target", "repetitions", "items", "n_words", "contaminated", "copy", "key", "fp", "node", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            after = stage(spark, given, sf)
            got = after.collect()
            if name == "sharding":
                assert len(got) == given.count()
                continue
            assert after.columns == docs.columns and after.schema["size"].dataType.simpleString() == "string"
            assert all(r[c] == (f"{c}-{r['doc_id']}" if r["doc_id"] is not None else c) for r in got for c in clashing)
            assert {(r["doc_id"], r["text"]) for r in got} <= {(i, t) for i, t, _ in rows}
        if name in ("toxicity", "decontamination"):
            assert len(stage(spark, docs, sf).collect()) == len(rows)
        if name == "near_duplicates":
            assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in stage(spark, docs, sf).collect()) == [(1, "same "), (3, ""), (4, "word "), (5, "anoth")]
