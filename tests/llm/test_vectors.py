"""Whitening and vector codes: against numpy and brute force."""

import hashlib
import math

import numpy as np
import pytest

from braidseq.llm import vector_codes, whitening
from braidseq.llm.vector_codes import compress_vectors, nearest
from braidseq.llm.whitening import fit_whitening, lattice, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x int, id string"


def table(spark, vectors, ids=None, labels=None, partitions=3):
    ids = range(len(vectors)) if ids is None else ids
    labels = labels or [None] * len(vectors)
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], label, "old", 7, "old") for i, v, label in zip(ids, vectors, labels)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def brute_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = fit - s / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("width, decay", [(24, 0.0), (40, 0.35), (3, 0.0)])
def test_whitening_equals_eigenvectors(spark, width, decay):
    rng = np.random.default_rng(width)
    vectors = rng.standard_normal((300, width)) * np.exp(-decay * np.arange(width)) * 20
    vectors[100:200] = vectors[0]  # a hot vector counts once
    k = min(4, width)
    got = whiten(table(spark, vectors), components=k).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = brute_whitening(vectors, k)
    assert len(got) == 300 * k and set(got["n"]) == {n} == {200}
    assert got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == deviation.tolist()
    own = got["whitened"].to_numpy().reshape(-1, k)
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own * signs - whitened).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k)[0], explained, rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


def test_range_finder_stops_early_or_grows(spark):
    rng = np.random.default_rng(5)
    low = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 30)) * 50
    flat = rng.standard_normal((200, 30)) * 4
    low_fit, flat_fit = (fit_whitening(lattice(table(spark, v)).select("x").distinct(), 30, components=2, oversample=4) for v in (low, flat))
    for found, vectors in ((low_fit, low), (flat_fit, flat)):
        assert np.allclose(found.values / found.trace, brute_whitening(vectors, 2)[3], rtol=1e-9) and found.identity_error < 1e-9
    assert flat_fit.expanded
    exact = (rng.integers(-9, 9, (200, 2)) @ rng.integers(-9, 9, (2, 30))) / 64
    found = fit_whitening(lattice(table(spark, exact)).select("x").distinct(), 30, components=2, oversample=4)
    assert not found.expanded and found.identity_error < 1e-9


def test_whitening_on_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 2], [3, 5], [1, 2], [4, 1], None, [1, None], [nan, 1], [inf, 1], [1, 2, 3], []]
    got = whiten(table(spark, vectors, ids=[1, None, 1, 2, 3, 4, 5, 6, 7, 8])).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {3} and sum(r["vec_id"] is None for r in got) == 2
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    same = whiten(table(spark, [[1, 2], [1, 2]])).collect()
    assert [r["whitened"] for r in same] == [None] * 4 and {r["deviation"] for r in same} == {0} and {r["explained"] for r in same} == {0.0}
    line = whiten(table(spark, [[1, 2], [2, 4], [3, 6]])).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True} and {r["identity_error"] < 1e-9 for r in line} == {True}
    for none in ([], [None], [[]]):
        assert whiten(table(spark, none)).count() == 0


def brute_codes(vectors, parts, entries, rounds):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    length = len(x[0]) // parts
    cut = [[tuple(v[p * length : (p + 1) * length]) for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes) if c[p] == e]
                if own:
                    books[p][e] = tuple(sum(z) // len(own) for z in zip(*own))
    codes = assign()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)]
    joined = ",".join(str(z) for book in books for e in book for z in e)
    return [bytes(c) for c in codes], errors, hashlib.sha256(joined.encode()).hexdigest()


@pytest.mark.parametrize("length", [1, 2, 3, 4, 8])
def test_codes_equal_brute_force(spark, length):
    rng = np.random.default_rng(length)
    vectors = np.round(rng.standard_normal((150, 4 * length)), 1)  # many ties
    vectors[50:90] = vectors[3]
    labels = [None if i % 3 == 0 else int(i % 2) for i in range(150)]
    got = compress_vectors(table(spark, vectors, labels=labels), parts=4, entries=9).orderBy("vec_id").collect()
    codes, errors, digest = brute_codes(vectors, 4, 9, 2)
    assert [bytes(r["codes"]) for r in got] == codes and [r["error"] for r in got] == errors
    assert {r["codebooks_sha256"] for r in got} == {digest}
    for r in got:
        assert r["label_error"] == sum(e for e, label in zip(errors, labels) if label == r["label"])


def test_bounds_lose_no_nearest_entry_and_spare_distances():
    rng = np.random.default_rng(2)
    taken = every = 0
    for length in (1, 2, 4, 5, 16):
        for scale in (1, 30, 60_000):
            entries = rng.integers(-scale, scale + 1, (64, length))
            x = np.concatenate([entries[rng.integers(0, 64, 200)] + rng.integers(-1, 2, (200, length)), rng.integers(-scale, scale + 1, (200, length))])
            far = ((x[:, None] - entries) ** 2).sum(axis=2)
            index, best, exact = nearest(x, entries)
            assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
            if length > 1:
                taken, every = taken + exact, every + far.size
    assert taken < 0.5 * every


def test_codes_on_edges(spark):
    nan = float("nan")
    vectors = [[1, 2, 3], None, [1, None, 2], [nan, 1, 1], [5, 5], [1, 2, 3], [0, 0, 0]]
    got = compress_vectors(table(spark, vectors, ids=[None, 1, 2, 3, 4, 5, 5]), parts=2).collect()
    assert len(got) == 3 and {r["error"] for r in got} == {0} and {len(r["codes"]) for r in got} == {2}
    assert got[0].asDict().keys() == {"vec_id", "label", "codes", "error", "label_error", "codebooks_sha256"}
    for none in ([], [None]):
        assert compress_vectors(table(spark, none)).count() == 0
    assert [bytes(r["codes"]) for r in compress_vectors(table(spark, [[]])).collect()] == [bytes(16)]


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((60, 8))
    whole = compress_vectors(table(spark, vectors), parts=4, entries=8).orderBy("vec_id").collect()
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 300)
    assert compress_vectors(table(spark, vectors), parts=4, entries=8).orderBy("vec_id").collect() == whole
