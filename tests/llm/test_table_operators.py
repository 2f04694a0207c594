"""Sharding, mixing, decontamination and URL rules: against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from braidseq.llm.decontaminate import find_contamination, with_verdict
from braidseq.llm.mixing import mix_sources
from braidseq.llm.sharding import shard_by_bytes
from braidseq.llm.url_cascade import Rule, build_cascade, judge_urls


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400) + str(i), "s", None) for i in range(600)] + [(1000 + i, "copy " * 20, "s", None) for i in range(300)] + [(None, None, None, None), (2005, "", "s", None), (2005, "", "s", None)]
    got = shard_by_bytes(docs(spark, rows).repartition(5), 8, ranges=7).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r["content"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.12 * sum(sizes) / 8
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    placed = {tuple(r) for r in shard_by_bytes(docs(spark, rows).repartition(2), 8, ranges=3).select("doc_id", "shard").collect()}
    assert placed == {(r["doc_id"], r["shard"]) for r in got}


def test_shards_of_small_tables(spark):
    assert shard_by_bytes(docs(spark, []), 8).count() == 0
    assert shard_by_bytes(docs(spark, [(1, None, None, None)]), 8).first()["slot"] == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, clamped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in clamped]
        left = budget - sum(clamped.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return clamped | target
        clamped |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    names = ["b", "a", None, "ä", "c", "empty"]
    rows = [(i, "w " * rng.randint(0, 60) if s != "empty" else None, s, "e") for i in range(3000) for s in [names[min(5, int(rng.expovariate(0.9)))]]]
    rows += [(1, None, "a", None), (None, "x y", "a", None), (None, "x y", "a", None)]
    got = mix_sources(docs(spark, rows).withColumn("size", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r["size"] * r["repetitions"] for r in own) - want[s]) <= 61
    assert max(r["repetitions"] for r in got) <= 2
    again = mix_sources(docs(spark, rows).repartition(7)).select("doc_id", "source", "size", "repetitions").collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(doc_id=r["doc_id"], source=r["source"], size=r["size"], repetitions=r["repetitions"])) for r in got)
    assert mix_sources(docs(spark, [])).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    cut = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, names = cut(text), set(), set()
    for name, item in items:
        w = cut(item)
        for window in {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else ():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names.add(name)
    return len(words), len(hit), sorted({str(n) for n in names if n is not None})


@pytest.mark.parametrize("block_windows", [100_000, 20])
def test_contamination_equals_brute_force(spark, block_windows):
    rng = random.Random(8)
    pool = ["The", "cat", "sat", "on", "a", "mat", "é", "x9"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([1, 3, 5, 12, 13, 14, 30, 40])] + [(50, None), (51, "?!"), (None, "zz yy xx ww vv uu"), (3, "repeated item text for one id")]
    texts = [None, "", "?!", "the"] + [", ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(40)] + [f"pre {t.upper() if t and k % 2 else t} post" for k, (_, t) in enumerate(items)]
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    out = with_verdict(find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_windows=block_windows))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out.collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute_hits(t, items)
        assert got[i] == (n, hit, names, hit > 0 and 20 * hit >= n), t


def test_no_benchmark_hits_nothing(spark):
    frame = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    got = with_verdict(find_contamination(frame, spark.createDataFrame([], "item_id long, text string"))).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(3, 0, False), (0, 0, False)]


def test_cascade_is_exact_over_its_universe(spark):
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:9]
    universe = [(key(i),) for i in range(20_000)] + [(None,)]
    listed = [(key(i),) for i in range(0, 20_000, 40)] + [("elsewhere",), (None,)]
    cascade = build_cascade(spark.createDataFrame(listed, "key string"), spark.createDataFrame(universe, "key string"))
    assert len(cascade.levels) > 1
    rows = spark.createDataFrame(universe, "key string").where("key is not null").withColumn("held", cascade.holds(F.col("key"))).collect()
    assert {r["key"] for r in rows if r["held"]} == {k for (k,) in listed if k} - {"elsewhere"}


def brute_verdict(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_rules_equal_brute_force(spark):
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.b.example.org", "/fr/x")]
    urls = [None, "", "no scheme", "http://", "http://net", "http://NET/", "x://a.net/?q", "http://example.net/en/1", "http://evilexample.net/en/1", "http://w.example.net/EN/", "http://example.net.org/fr/",
            "https://b.example.com/de/?x#y", "http://a.b.example.org/fr/x/1", "http://b.example.org/fr/x", "http://org/fr/", "http://u://v.net/", "http://.net/", "//net/", "http://a.net\n/x", "http://" + "a." * 3000 + "net/"]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(frame, rules).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(frame, []).collect()} == {"allow"}


def test_long_lists_of_keys(spark, monkeypatch):
    """Levels as broadcast rows, and a list cut into parts, judge as literals do."""
    from braidseq.llm import url_cascade

    listed = {f"k{i}" for i in range(0, 3000, 7)}
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,), ("k7",)], "key string"))
    keys = spark.createDataFrame([(k,) for k in listed] + [(None,), ("k7",)], "key string")
    monkeypatch.setattr(url_cascade, "LITERAL_WORDS", 0)
    cascade = build_cascade(keys, universe)
    rows = cascade.detach(cascade.attach(universe).withColumn("held", cascade.holds(F.col("key"))))
    assert rows.columns == ["key", "held"]
    assert all(r["held"] == (r["key"] in listed) for r in rows.where("key is not null").collect())
    for most in (1 << 19, 30):
        monkeypatch.setattr(url_cascade, "MOST_WORDS", most)
        assert isinstance(url_cascade.build_cascades(keys, universe), url_cascade.Cascade if most > 30 else url_cascade.Cascades)
        parts = url_cascade.listed_keys(universe.withColumn("listed", F.lit("old")), "key", keys)
        assert parts.columns == ["key", "listed"] and parts.count() == universe.count()
        assert all(r["listed"] == (r["key"] in listed) for r in parts.collect())
    assert url_cascade.listed_keys(universe.limit(0), "key", keys).count() == 0 and not any(r["listed"] for r in url_cascade.listed_keys(universe, "key", keys.limit(0)).collect())
    with pytest.raises(ValueError):
        build_cascade(keys, universe)


def test_a_long_list_passes_no_level_through_the_driver(spark, monkeypatch):
    from braidseq.llm import url_cascade

    monkeypatch.setattr(url_cascade, "LITERAL_WORDS", 500)
    monkeypatch.setattr(url_cascade, "MOST_WORDS", 4000)
    universe = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = universe.where("crc32(cast(key as binary)) % 3 = 0")
    made = url_cascade.build_cascades(keys, universe)
    assert len(made.parts) > 2 and all(len(level.words) <= 500 for one in made.parts for level in one.levels) and any(level.table is not None for one in made.parts for level in one.levels)
    judged = url_cascade.listed_keys(universe, "key", keys)
    assert judged.where("listed <> (crc32(cast(key as binary)) % 3 = 0)").count() == 0 and judged.count() == 200_000


def test_many_rules_equal_brute_force(spark, monkeypatch):
    from braidseq.llm import url_cascade

    monkeypatch.setattr(url_cascade, "LITERAL_RULES", 10)
    rules = [Rule("block" if i % 3 else "allow", f"h{i}.net", "/" if i % 2 else "/a") for i in range(400)]
    urls = [f"http://{x}h{i}.net{path}" for i in range(0, 500, 7) for x in ("", "w.", "x") for path in ("", "/", "/a", "/b")]
    frame = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1])], "page_id long, url string")
    got = judge_urls(frame, rules).collect()
    assert len(got) == len(urls) + 1 and all((r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(r["url"], rules) for r in got)


def test_mixing_replaces_columns_named_like_results(spark):
    rows = [(i, "word " * (i % 5 + 1), f"s{i % 3}") for i in range(200)]
    plain = mix_sources(docs(spark, [(i, t, s, None) for i, t, s in rows]).select("doc_id", "text", "source"))
    odd = mix_sources(spark.createDataFrame(rows, "size long, text string, target string"), "size", "text", "target")
    assert odd.columns == ["text", "size", "source_size", "target", "repetitions"]
    count = lambda df: sorted((r["size"], r["source_size"], round(r["target"], 6), r["repetitions"]) for r in df.collect())
    assert count(plain) == count(odd)


def test_buckets_of_the_sampling_order_keep_their_size():
    from braidseq.llm.mixing import BUCKET_ROWS, bucket_digits_for

    assert bucket_digits_for(10) == 3
    for rows in (10**6, 10**9, 10**12, 10**14):
        assert rows / 16 ** bucket_digits_for(rows) <= BUCKET_ROWS
