"""GIF and ZIP packages: round trips, hand-made files, and other libraries' readers."""

import base64
import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidseq.llm import gif
from braidseq.llm.zip_warc import DATA, INDEX, PackageReader, PackageWriter, archive_pages, read_packages


@pytest.mark.parametrize("rows", [1, 63, 64, 65, 400])
@pytest.mark.parametrize("kind", ["noise", "one", "cycle"])
def test_gif_round_trip(rows, kind):
    rng, n = random.Random(rows), rows * gif.WIDTH
    payload = {"noise": rng.randbytes(n), "one": b"a" * n, "cycle": (b"abcab" * n)[:n]}[kind]
    assert b"".join(f.samples.tobytes() for f in gif.decode(gif.encode_payload(payload))) == payload


def textbook_lzw(data, size):
    """One code after the other, as the format's description has it."""
    clear, end, out = 1 << size, (1 << size) + 1, []
    table, width, before, at = {}, size + 1, None, 0
    number = int.from_bytes(data, "little")
    while at + width <= 8 * len(data):
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)}, size + 1, None
            continue
        if code == end:
            break
        if not table:
            table = {i: bytes([i]) for i in range(clear)}
        now = table[code] if code in table else before + before[:1]
        out.append(now)
        if before is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = before + now[:1]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        before = now
    return b"".join(out)


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("kind", ["noise", "one", "cycle", "words"])
def test_codec_equals_the_textbook(size, kind):
    rng, n = random.Random(size), 30_000
    top = (1 << size) - 1
    made = {"noise": rng.randbytes(n), "one": b"\1" * n, "cycle": bytes(range(7)) * (n // 7), "words": b"".join(rng.choice([b"some ", b"word ", b"that ", b"comes "]) for _ in range(n // 5))}
    samples = bytes(b & top for b in made[kind])
    coded = gif.lzw_encode(samples, size)
    assert textbook_lzw(coded, size) == samples and gif.lzw_decode(coded, size, len(samples)) == samples


def test_random_damage_raises_nothing_else():
    rng = random.Random(3)
    whole = gif.encode_payload(b"some words " * 192 * 8)
    for _ in range(600):
        data = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.3 else whole)
        for _ in range(rng.randint(0, 4)):
            if data:
                data[rng.choice([rng.randrange(len(data)), rng.randrange(min(len(data), 900))])] = rng.randrange(256)
        try:
            list(gif.decode(bytes(data)))
        except ValueError:
            pass


def test_damaged_rows_get_an_error(spark):
    sound = gif.encode_payload(b"a" * 192)
    rows = [(1, bytearray(sound), "x"), (2, bytearray(sound[:-30]), "y"), (3, bytearray(b"no"), None), (4, None, None), (4, None, None)]
    media = spark.createDataFrame(rows, "doc_id long, media binary, frames string")
    for read in (gif.read_payload, gif.read_frames):
        got = sorted(read(media).collect(), key=lambda r: r["doc_id"])
        assert [r["error"] is None for r in got] == [True, False, False, True, True]
        assert [r["frames"] is None for r in got] == [False, True, True, True, True]


def lzw_literal(samples, size):
    """Codes of fixed width: a clear code before the width would grow."""
    codes = []
    for i, s in enumerate(samples):
        if i % ((1 << size) - 2) == 0:
            codes.append(1 << size)
        codes.append(int(s))
    codes.append((1 << size) + 1)
    bits = "".join(format(c, f"0{size + 1}b")[::-1] for c in codes)
    data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return bytes([size]) + b"".join(bytes([len(b)]) + b for b in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def frame(samples, x, y, w, h, disposal=0, transparent=None, flags=0, delay=5):
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + lzw_literal(samples, 2)


def test_disposal_transparency_and_interlace():
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 8, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    rows = [0, 4, 2, 6, 1, 3, 5, 7]
    first = frame([r % 4 for r in rows for _ in range(4)], 0, 0, 4, 8, flags=0x40)
    parts = [first, frame([1, 3], 1, 1, 2, 1, disposal=3, transparent=3), frame([2, 2], 0, 0, 2, 1, disposal=2), frame([3], 3, 7, 1, 1)]
    frames = list(gif.decode(head + b"".join(parts) + b"\x3b"))
    palette = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    base = np.array([[palette[r % 4]] * 4 for r in range(8)])
    assert (frames[0].canvas[..., :3] == base).all()
    one = base.copy()
    one[1, 1] = palette[1]  # the other sample is transparent
    assert (frames[1].canvas[..., :3] == one).all()
    two = base.copy()  # the frame before was taken back
    two[0, :2] = palette[2]
    assert (frames[2].canvas[..., :3] == two).all()
    three = base.copy()
    three[0, :2] = 0  # cleared
    three[7, 3] = palette[3]
    assert (frames[3].canvas[..., :3] == three).all() and frames[3].canvas[0, 0, 3] == 0
    assert [f.delay_ms for f in frames] == [50] * 4


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG", gif.encode_payload(b"a" * 192)[:-30]])
def test_damaged_gifs_raise(data):
    with pytest.raises(ValueError):
        list(gif.decode(data))


def test_texts_as_gifs(spark):
    texts = [None, "", "a", "é" * 500, "word " * 9000, "word " * 9000]
    docs = spark.createDataFrame([(i, t, b"old") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r["doc_id"]: r for r in gif.read_payload(gif.store_as_gif(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert rows[i]["n_bytes"] == len(raw) and rows[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and sum(map(sum, (f["red"] for f in rows[i]["frames"]))) == len(padded)
    assert rows[4]["media_sha256"] == rows[5]["media_sha256"]
    frames = gif.read_frames(gif.store_as_gif(docs)).where("doc_id = 4").first()["frames"]
    assert len(frames) == -(-45000 // (192 * 64)) and sum(frames[0]["red"]) == 192 * 64
    grey = [0] * 16
    for b in ("word " * 9000).encode().ljust(-(-45000 // 192) * 192)[: 192 * 64]:
        grey[b >> 4] += 1
    assert frames[0]["red"] == grey and frames[0]["green"] == grey[::-1] and frames[0]["delay_ms"] == 40
    assert gif.read_payload(gif.store_as_gif(docs.where("false"))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_open_elsewhere_and_by_range(zip64):
    sink = io.BytesIO()
    out = PackageWriter(sink, zip64)
    out.begin(DATA)
    places = [(out.write(x), len(x)) for x in (b"first", b"second record")]
    out.end()
    out.begin(INDEX)
    out.write("".join(f'{i} d {{"offset": "{o}", "length": "{n}"}}\n' for i, (o, n) in enumerate(places)).encode())
    out.end()
    size = out.close()
    data = sink.getvalue()
    assert size == len(data)
    with zipfile.ZipFile(io.BytesIO(data)) as other:
        assert other.testzip() is None and other.read(DATA) == b"firstsecond record"
    reader = PackageReader(lambda o, n: data[o : o + n], size)
    assert [data[e["offset"] : e["offset"] + e["length"]] for e in reader.index()] == [b"first", b"second record"]
    with pytest.raises(ValueError):
        PackageReader(lambda o, n: data[: size - 30][o : o + n], size - 30)


def test_reader_takes_other_writers_packages():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as other:
        other.writestr("archive/", "")
        other.writestr(DATA, b"abc")
        with other.open(INDEX, "w", force_zip64=True) as f:
            f.write(b'0 d {"offset": "1", "length": "2"}\n')
        other.comment = b"a comment with PK\x05\x06 in it"
    data = sink.getvalue()
    (entry,) = PackageReader(lambda o, n: data[o : o + n], len(data)).index()
    assert data[entry["offset"] : entry["offset"] + entry["length"]] == b"bc"


@pytest.mark.parametrize("zip64", [False, True])
def test_pages_round_trip(spark, zip64):
    rows = [(1, "http://a/", "one"), (2, None, "two"), (3, "x\r\ny%", "one"), (4, "u", None), (5, "u", ""), (None, "n", "lonely"), (None, "n2", "one"), (6, "é", "ü" * 3000), (3, "again", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = read_packages(archive_pages(spark, pages, zip64=zip64)).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        source = [h or "" for i, u, h in rows if i == r["page_id"] and u == r["url"]]
        payload = source[0].encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = last[source[0]]
        if first in (-1, r["page_id"]):
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == payload
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first
    assert read_packages(archive_pages(spark, pages.where("false"))).count() == 0


def test_groups_of_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    from braidseq.llm import zip_warc
    from braidseq.operators import skew

    rows = [(i, "u", f"page {i % 40 if i % 3 else 0}") for i in range(3000)] + [(None, "u", None), (5000, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plain = sorted(map(tuple, zip_warc.link_copies(pages, "page_id", "url", "html").drop("payload").collect()), key=str)
    monkeypatch.setattr(zip_warc, "BROADCAST_GROUPS", 3)
    monkeypatch.setattr(skew, "SMALL_TABLE", 10)
    assert sorted(map(tuple, zip_warc.link_copies(pages, "page_id", "url", "html").drop("payload").collect()), key=str) == plain


def test_ranges_are_read_by_several_tasks(spark):
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(3000).hex()) for i in range(300)], "page_id long, url string, html string").repartition(2)
    from braidseq.llm.zip_warc import read_packages

    read = read_packages(archive_pages(spark, pages), read_bytes=100_000)
    assert read.rdd.getNumPartitions() > 4 and read.count() == 300
    parts = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4


def test_record_ids_never_repeat(spark):
    from braidseq.llm.zip_warc import record_bytes

    row = {"page_id": None, "url": "u", "payload": b"x", "payload_bytes": 1, "payload_digest": "D", "refers_to": None, "revisit": False}
    ids = {[x for x in record_bytes(row, f"p:{i}").split(b"\r\n") if x.startswith(b"WARC-Record-ID")][0] for i in range(5)}
    assert len(ids) == 5
