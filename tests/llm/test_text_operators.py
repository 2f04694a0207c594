"""PII, fingerprints, token counts: against brute force."""

import random
import re
from collections import Counter

import pytest

from braidseq.llm.pii import disguised_spans, find_pii, plain_spans
from braidseq.llm.simhash import ball_radii, hexadecimal, keep_one_of_each, near_components, simhash

EDGE_TEXTS = [None, "", " ", "a", "word " * 3000, "x" * 20000, "Ünï cödé " * 50]


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m.group())]


def test_plain_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b1", "@", ".", "-", "+1", "2", "25", " ", "(", "4111 1111", "1111-1111", "x.y", "192.168", "\n", "é"]) for _ in range(rng.randint(0, 25)))
        assert plain_spans(text) == brute_spans(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("see john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("ask jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("or user＠example．com", "email", "user＠example．com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("pay 4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("a a\u200bb@ex\u200bample.com", "email", "a\u200bb@ex\u200bample.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = disguised_spans(text, plain_spans(text))
    assert [(k, text[s:e]) for k, s, e in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["look at example.com", "he sat at the dot of noon", "one two three", "at ten. Then at one", "plain a@b.co here", "naïve café · 3²"])
def test_ordinary_text_gains_nothing(text):
    assert disguised_spans(text, plain_spans(text)) == []


def test_pii_on_edges_and_clashing_columns(spark):
    rows = [(i, t, "old") for i, t in enumerate(EDGE_TEXTS)] + [(None, "a@b.co", None), (None, "a@b.co", None)]
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert out.columns == ["doc_id", "text", "base_spans", "spans"]
    got = out.collect()
    assert len(got) == len(rows) and sum(len(r["spans"]) for r in got) == 2
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_fingerprint(text, k=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Ids by rows; single linkage over all pairs."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return {(prints[i][0]): min(prints[j][0] for j in range(len(prints)) if group[j] == group[i]) for i in range(len(prints))}


def some_texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    texts = list(EDGE_TEXTS)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 900))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("  ".join(copy))
    return texts


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = some_texts()
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", hexadecimal(simhash_col()).alias("f"), "component_id").collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    assert {r["doc_id"]: int(r["f"], 16) for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def simhash_col():
    from pyspark.sql import functions as F

    return F.col("simhash")


@pytest.mark.parametrize("radius, segments", [(4, 3), (4, 2), (7, 4), (3, 5), (3, 4)])
def test_every_near_pair_is_found_in_some_ball(spark, radius, segments):
    from braidseq.llm.simhash import near_links

    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(6)]
    values = set(centre)
    for c in centre:
        for _ in range(15):
            v = c
            for b in rng.sample(range(64), rng.randint(1, radius + 2)):
                v ^= 1 << b
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {frozenset((r["left"], r["right"])) for r in near_links(spark.createDataFrame(signed, "fp long"), radius, segments).collect()}
    mask = (1 << 64) - 1
    want = {frozenset((a, b)) for (a,) in signed for (b,) in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= radius}
    assert got == want
    assert sum(ball_radii(radius, segments)) + segments > radius


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (None, "p q r s t", "z"), (None, "p q r s t", "z"), (7, None, "n"), (8, "", "e"), (9, "entirely different words stand here now", "d")]
    out = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _rows string"))
    assert out.columns == ["doc_id", "text", "_rows"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == [(-1, "p q r s t"), (1, "a b c d e f"), (7, ""), (9, "entirely different words stand here now")]
    assert simhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def similar_pairs(texts):
    """Pairs of places in ``texts``, of different words, whose five-word shingles have a similarity of 0.8 or more; and the places of equal words."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) for t in texts]
    first, equal = {}, []
    for i, w in enumerate(words):
        equal.append((first.setdefault(tuple(w), i), i))
    sets = {i: {tuple(words[i][k : k + 5]) for k in range(max(1, len(words[i]) - 4))} if words[i] else set() for i in first.values()}
    often = Counter(g for s in sets.values() for g in s)
    holders, pairs = {}, []
    for i, s in sets.items():
        met = set()
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            met.update(holders.setdefault(g, []))
            holders[g].append(i)
        pairs += [(j, i) for j in met if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])]
    return pairs, equal


def brute_similar(texts):
    """The number of the least similar text, by chains of pairs, for each text."""
    pairs, equal = similar_pairs(texts)
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs + equal:
        low, high = sorted((root(a), root(b)))
        group[high] = low
    return [root(i) for i in range(len(texts))]


def clouds():
    """Copies with edits far and near, texts with one fingerprint that differ, fillers, junk."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "a", "A", "a a", "a a a a a a", "b c d"]
    for n in (30, 120, 400):
        base = [rng.choice(words) for _ in range(n)]
        for edits in [0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 8, 12, 20]:
            copy = list(base)
            for _ in range(min(edits, n // 8)):
                copy[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(copy))
    filler = ["fill"] * 300
    texts += [" ".join(filler + [rng.choice(words) for _ in range(40)]) for _ in range(5)]
    texts += [" ".join(filler + ["end"] * k) for k in range(4)]
    return texts


def check_kept(texts, kept):
    """The first text of each group of chains of similar pairs stays, and no other."""
    assert kept == set(brute_similar(texts))


def test_one_of_each_group_of_similar_texts_stays(spark):
    texts = clouds()
    ids = list(range(1000, 1000 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    check_kept(texts, {r["doc_id"] - 1000 for r in keep_one_of_each(docs).collect()})


def test_recall_of_similar_pairs_of_different_texts(spark):
    """Of all pairs of the table, found by brute force, 95 of 100 at least; and no text is joined to one that no chain of pairs reaches."""
    from braidseq.llm.simhash import similar_components

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["key"]: r["component"] for r in similar_components(docs, "doc_id", "text").collect()}
    texts = [t for _, t in rows]
    pairs, _ = similar_pairs(texts)
    together = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in pairs)
    assert len(pairs) > 30 and together >= 0.95 * len(pairs)
    group = brute_similar(texts)
    assert len({(got[i], g) for (i, _), g in zip(rows, group)}) == len(set(got.values()))


def test_unlike_texts_of_one_fingerprint_take_no_rounds(spark, monkeypatch):
    """Hundreds of texts whose fingerprint the filler decides: the number of comparisons' rounds is fixed."""
    from braidseq.llm import simhash as module

    rng, rounds = random.Random(3), []
    plain = module._similar
    monkeypatch.setattr(module, "_similar", lambda pairs, sets: rounds.append(1) or plain(pairs, sets))
    texts = [" ".join(["fill"] * 300 + [f"w{rng.randrange(10**6)}" for _ in range(200)]) for _ in range(500)]
    texts += [t.replace("fill fill", "fill", 1) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert module.simhash(docs, "text", 2).select("simhash").distinct().count() < 20
    got = {r["key"]: r["component"] for r in module.similar_components(docs, "doc_id", "text").collect()}
    assert got == {i: g for i, g in enumerate(brute_similar(texts))} and len(rounds) == 2


def test_a_hot_segment_is_split(spark, monkeypatch):
    from braidseq.llm import simhash as module

    rng = random.Random(21)
    for radius, segments in ((4, 3), (4, 2), (3, 4)):
        monkeypatch.setattr(module, "HOT_KEY", 20)
        centre = rng.getrandbits(62)
        shift, width = module._segments(segments)[1]
        mask = ((1 << width) - 1) << shift
        values = {(centre & mask) | (rng.getrandbits(62) & ~mask) for _ in range(150)}
        for v in list(values)[:40]:
            for _ in range(3):
                for b in rng.sample(range(62), rng.randint(1, radius + 1)):
                    v ^= 1 << b
                values.add(v)
        got = {frozenset((r["left"], r["right"])) for r in module.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, segments).collect()}
        assert got == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius}


def test_a_cloud_of_near_fingerprints_is_one_group(spark):
    """Half of the rows have one fingerprint, and many differ from it by a bit or two: no table holds all pairs."""
    from braidseq.llm import simhash as module

    rng = random.Random(12)
    centre = rng.getrandbits(62)
    cloud = {centre ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(600)} | {centre}
    others = {rng.getrandbits(62) for _ in range(300)}
    values = spark.createDataFrame([(v,) for v in cloud | others], "fp long")
    got = {r["fp"]: r["group"] for r in module.linked_fingerprints(values, 4).collect()}
    assert len(got) == len(cloud | others) and {got[v] for v in cloud} == {min(cloud)}
    assert all(got[v] == v for v in others)
    named = spark.createDataFrame([(v, v % 7, 20_000 if v == centre else 1) for v in cloud], "fp long, first long, n long")
    from braidseq.operators.skew import join_named

    rows = spark.range(20_000).selectExpr("id", f"{centre}L as fp").unionByName(values.where("fp <> %d" % centre).selectExpr("0L as id", "fp"))
    assert join_named(rows, named, "fp", "n", 20_000 + len(cloud)).where(f"fp = {centre}").count() == 20_000


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from braidseq.llm.tokens import Counter as TokenCounter
    from braidseq.llm.tokens import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    count, rng = TokenCounter(path), random.Random(2)
    texts = [" ", "  ", " a", "a  b", "\n", "\n \n", "<s>", "</s> x", "<0x0A>", "▁a", "a▁ b", "中文 测试", "😀👍🏽", "\r\n", "\x00", "the " * 3000, "z" * 9000]
    texts += ["".join(rng.choice("ab eiou\n\tthERTé▁中😀 ①<>/s") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert [count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(rows, path).collect()}
    n = len(library.encode("word " * 5000))
    assert got == {(1, 0, 0, False), (2, 0, 0, False), (3, 25000, n, True)}
