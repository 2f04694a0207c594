"""The language model: counts against brute force, probabilities that sum to one, gradients, and what it learns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from braidseq.llm import maxent
from braidseq.llm.maxent import score_language_model, train_language_model
from braidseq.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())) + [b" "]


def brute_base(train, texts):
    counts = Counter(t for text in train for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, [sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)) for x in texts], [sum(counts[t] > 0 for t in tokens(x)) for x in texts]


def test_query_equals_brute_force_and_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs]
    n, base, known = brute_base([d["text"] for d, h in zip(docs, held) if not h], [d["text"] for d in docs])
    got = {r["doc_id"]: r for r in QUERIES["op11_language_model"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, h, b, k in zip(docs, held, base, known):
        r = got[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(tokens(d["text"])), k, n)
        assert r["base_score"] == pytest.approx(b, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def small_model(spark, rows=None, **more):
    rows = rows or [(i, f"alpha beta gamma {'delta' if i % 2 else 'Alpha'} x{i % 7}") for i in range(400)]
    return train_language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD_WORDS", 9)
    model = small_model(spark)
    assert len(model.words) < model.distinct  # some counts are joined
    vocabulary = [r["word"].decode() for r in model.rare.collect()] + [w.decode() for w in model.words if w != b" "]
    for before in ("", "alpha", "alpha beta", "x3 unheard", "unheard unheard"):
        texts = [f"{before} {w}".strip() for w in [*vocabulary, "neverseen"]]
        docs = spark.createDataFrame(list(enumerate([before, *texts])), "doc_id long, text string")
        scores = {r["doc_id"]: r["score"] for r in score_language_model(docs, model).collect()}
        # A text ends after its last word; the end's share after each word is found by scoring the word twice.
        reader = maxent._Reader(model.words, model.counts)
        classes, inner, last = model.outlook()

        def log10_last(text, at):
            ids, lengths, toks = reader.read([text.encode()])
            p = maxent._log_probability(model.weights, reader.features(ids, lengths), classes, inner)[at] / math.log(10)
            if reader.group[ids[at]] < maxent.CLASSES - 1:
                return p
            rare = {bytes(r["word"]): r["n"] for r in model.rare.collect()}
            count = model.counts[ids[at]] if ids[at] < len(model.words) else rare.get(toks[at], 0)
            return p + math.log10(count + 0.1) - last / math.log(10)

        n = len(before.split())
        total = sum(10 ** log10_last(t, n) for t in texts) + 10 ** log10_last(before, n)
        assert total == pytest.approx(1, abs=1e-4)
        for i, text in enumerate([before, *texts]):
            assert scores[i] == pytest.approx(sum(log10_last(text, k) for k in range(len(text.split()) + 1)), abs=1e-4)


def test_zero_weights_are_the_base(spark):
    model = small_model(spark, rounds=0)
    docs = spark.createDataFrame([(1, "alpha beta nothing"), (2, None), (3, "x1 x2 x3")], "doc_id long, text string")
    for r in score_language_model(docs, model).collect():
        assert r["score"] == pytest.approx(r["base_score"], abs=1e-4)


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in range(300)]
    reader = maxent._Reader(words, np.arange(300, 0, -1))
    model = maxent.LanguageModel(45150, 300, tuple(words), np.arange(300, 0, -1), None, (rng.standard_normal((maxent.ROWS, maxent.SLOTS)) * 0.1).astype(np.float32))
    classes, inner, _ = model.outlook()
    ids = rng.integers(0, 302, 500).astype(np.int32)
    ids[ids == reader.start] = reader.unknown
    f = reader.features(ids, np.array([200, 1, 299]))
    likelihood = lambda w: maxent._log_probability(w.astype(np.float64), f, classes, inner).sum()
    for names, events, target in ((maxent.OUTER_FEATURES, np.arange(500), f["group"]), (maxent.INNER_FEATURES, np.flatnonzero(f["group"] < maxent.CLASSES - 1), f["slot"])):
        outlook = classes if names is maxent.OUTER_FEATURES else inner[f["group"][events]]
        e, _ = maxent._exps(model.weights, [f[k][events] for k in names], outlook)
        slope = -e / e.sum(axis=1, keepdims=True)
        slope[np.arange(len(events)), target[events]] += 1
        for name in names:
            rows, times, sums = maxent._added(f[name][events], slope)
            assert times.sum() == len(events)
            for row, total in list(zip(rows, sums))[:3]:
                assert np.allclose(total, slope[f[name][events] == row].sum(axis=0), atol=1e-3)
                column = int(np.abs(total).argmax())
                up, down = model.weights.astype(np.float64), model.weights.astype(np.float64)
                up[row, column] += 1e-3
                down[row, column] -= 1e-3
                assert (likelihood(up) - likelihood(down)) / 2e-3 == pytest.approx(total[column], rel=0.02, abs=0.01)
    met, spread, weights = np.zeros(maxent.ROWS), np.zeros(maxent.ROWS, np.float32), model.weights.copy()
    for _ in range(5):
        maxent._step(weights, met, spread, f, classes, inner)
    assert likelihood(weights) > likelihood(model.weights) + 50


def test_context_is_learnt(spark):
    rows = [(i, "one two three four five six" if i % 2 else "six five four three two one") for i in range(600)]
    model = small_model(spark, rows)
    got = score_language_model(spark.createDataFrame([(1, "one two three four"), (2, "one four two three")], "doc_id long, text string"), model).collect()
    base, score = ({r["doc_id"]: r[c] for r in got} for c in ("base_score", "score"))
    assert base[1] == pytest.approx(base[2]) and score[1] > score[2] + 0.5 and score[1] > base[1]


def test_language_model_on_edges(spark):
    rows = [(None, None, "c"), (None, None, "c"), (1, "", "c"), (2, "a " * 50_000, "c"), (3, "x" * 200_000, "c"), (4, "Ä   b\x0bc", "c"), (4, "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = train_language_model(docs)
    got = score_language_model(docs, model).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "n_tokens", "n_known", "base_score", "score"}
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 2, 5, 50_001] and all(r["n_known"] == r["n_tokens"] and math.isfinite(r["score"]) for r in got)
    n, base, _ = brute_base([r[1] for r in rows], [r[1] for r in rows])
    assert model.tokens == n and sorted(r["base_score"] for r in got) == pytest.approx(sorted(base))
    empty = train_language_model(docs.limit(0))
    assert score_language_model(docs.limit(0), model).count() == 0
    assert {(r["n_known"], round(r["base_score"], 9), round(r["score"], 6)) for r in score_language_model(docs, empty).collect()} == {(0, 0.0, 0.0)}


def test_short_rows_are_added_exactly_enough_and_large_logits_are_held():
    rng = np.random.default_rng(4)
    e = np.exp(rng.standard_normal((5000, maxent.SLOTS)) * 6).astype(np.float32)
    assert np.allclose(maxent._totals(e), e.sum(axis=1, dtype=np.float64), rtol=2e-6)
    weights = rng.standard_normal((50, maxent.SLOTS)).astype(np.float32) * 40
    rows = [rng.integers(0, 50, 300) for _ in range(3)]
    z = np.minimum(weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + 1, 60)
    assert np.allclose(maxent._exps(weights, rows, np.ones(maxent.SLOTS, dtype=np.float32))[1], z, atol=1e-4)
    order, times, sums = maxent._added(rows[0], e[:300])
    assert all(np.allclose(s, e[:300][rows[0] == r].sum(axis=0), rtol=1e-5) and t == (rows[0] == r).sum() for r, t, s in zip(order, times, sums))


def test_rows_are_added_with_few_moves(monkeypatch):
    """Rows that come in pairs move three times for two; they moved five times."""
    import numpy as np

    from braidseq.llm import maxent

    moved, plain = [], maxent._rows
    monkeypatch.setattr(maxent, "_rows", lambda table, at: moved.append(len(at)) or plain(table, at))
    rng = np.random.default_rng(3)
    values, rows = rng.normal(size=(600, 64)).astype(np.float32), rng.permutation(np.repeat(np.arange(300), 2)).astype(np.int32)
    found, times, total = maxent._added(rows, values)
    assert sum(moved) <= 900 and (found == np.arange(300)).all() and (times == 2).all()
    assert np.allclose(total, [values[rows == i].sum(axis=0) for i in range(300)], atol=1e-5)
