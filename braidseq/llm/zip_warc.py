"""WARC records in ZIP packages: a writer of packages, and a reader that never extracts them.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member a record, and ``indexes/index.cdxj``, one line a record with
its place in the archive member.  The reader parses the end record, the ZIP64
records and the central directory, finds the members' data through their local
headers, reads the index by range, and then reads records by range.

Packages lie in the shared folder.  A task writes each under a name of its own
attempt and reports it only when it is complete; the list of packages is pinned,
so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_named
from .common import fresh_dir, pin

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its archive member has so many bytes.
PACKAGE_BYTES = 32_000_000
#: Records that one range read spans at most, and bytes.
READ_BYTES = 4_000_000
#: So many groups of copies are broadcast at most (some hundred bytes each); more are joined over a shuffle.
BROADCAST_GROUPS = 200_000
_DATE = "2024-01-01T00:00:00Z"
#: Record ids are name-based under this one.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "record")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records


def record_bytes(row: dict, place: str) -> bytes:
    """One WARC/1.1 record.  ``row``: page_id, url, payload, payload_bytes, payload_digest, refers_to.

    ``place`` tells the record from all others, whatever its page's id.  A
    response's block is an HTTP response with the payload, a revisit's is empty.
    """
    revisit = row["revisit"]
    block = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + row["payload"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, place)}>",
        f"X-Page: {'' if row['page_id'] is None else row['page_id']}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {row['refers_to']}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(value: str) -> int | None:
    return int(value) if value else None


def _one_line(url: str) -> str:
    """Header values hold no line ends: those and % as percent signs with their codes."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower case) and block of one record; ``ValueError`` if it is damaged."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block does not end where it should")
    if headers["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError("a record's block does not match its digest")
    return headers, block


# --- packages


class PackageWriter:
    """Writes the members of one package to ``sink`` one after the other, then the directory.  ``zip64``: its records even if small."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.members = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member whose size follows in a data descriptor."""
        raw = name.encode()
        self.members.append({"name": raw, "header": self.at, "crc": 0, "size": 0})
        # With a ZIP64 field, so that the descriptor's sizes have 8 bytes whatever comes.
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Appends to the member; returns where in it ``data`` begins."""
        own = self.members[-1]
        place, own["size"] = own["size"], own["size"] + len(data)
        own["crc"] = zlib.crc32(data, own["crc"])
        self._put(data)
        return place

    def end(self) -> None:
        own = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, own["crc"], own["size"], own["size"]))

    def close(self) -> int:
        """Writes the directory; returns the package's size."""
        start = self.at
        for m in self.members:
            big = self.zip64 or m["size"] >= 0xFFFFFFFF or m["header"] >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"]) if big else b""
            size, header = (0xFFFFFFFF, 0xFFFFFFFF) if big else (m["size"], m["header"])
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, header) + m["name"] + extra)
        size, count, at = self.at - start, len(self.members), start
        if self.zip64 or self.at >= 0xFFFFFFFF:
            record = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, record, 1))
            size, count, at = 0xFFFFFFFF, 0xFFFF, 0xFFFFFFFF
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, at, 0))
        return self.at


class PackageReader:
    """Reads parts of a package through ``read(offset, size)``."""

    def __init__(self, read, size: int):
        self.read = read
        self.members = {m["name"]: m for m in self._directory(size)}

    def _directory(self, size: int) -> list[dict]:
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # such bytes in a comment
        if at < 0:
            raise ValueError("no end record: not a ZIP package, or cut off")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("a damaged ZIP64 end record")
                count, length, start = struct.unpack_from("<QQQ", record, 32)
        data, out, at = self.read(start, length), [], 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            method, crc = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<I", data, at + 16)[0]
            packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode()
            fields = data[at + 46 + n : at + 46 + n + extra]
            while len(fields) >= 4:
                kind, long = struct.unpack_from("<HH", fields)
                if kind == 1:  # only those that don't fit above, in this order
                    wide = list(struct.unpack_from(f"<{long // 8}Q", fields, 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                fields = fields[4 + long :]
            out.append({"name": name, "stored": method == 0, "size": plain, "crc": crc, "header": header})
            at += 46 + n + extra + comment
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begin in the package, and their size."""
        m = self.members.get(name)
        if m is None or not m["stored"]:
            raise ValueError(f"no stored member {name}")
        local = self.read(m["header"], 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a damaged local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        return m["header"] + 30 + n + extra, m["size"]

    def index(self) -> list[dict]:
        """The records that the index names: ``offset`` in the package, ``length``."""
        start, _ = self.place(DATA)
        at, size = self.place(INDEX)
        out = []
        for line in self.read(at, size).decode().splitlines():
            entry = json.loads(line.split(" ", 2)[2])
            out.append({"offset": start + int(entry["offset"]), "length": int(entry["length"])})
        return out


def _files(uri: str):
    """pyarrow's file system for ``uri``, on any machine, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _ranged(file):
    def read(offset: int, size: int) -> bytes:
        file.seek(offset)
        data = file.read(size)
        if len(data) != size:
            raise ValueError("a package ends early")
        return data

    return read


# --- Spark jobs


def link_copies(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, sha1, refers_to, revisit`` for every row of ``pages``.

    Of equal payloads of at least ``least_bytes`` bytes the rows with the
    largest id are responses, the others revisit them.  A null id counts as the
    smallest; where a group has no other, each row is a response.  Rows with
    equal ids are rows of their own.  Groups are counted on digests, before the
    shuffle.  Up to ``BROADCAST_GROUPS`` groups of two or more are broadcast, so
    the pages don't move; beyond that hot groups are, and the others are joined
    by digest.  Ids are cast to long.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"),
    )
    large = F.col("payload_bytes") >= least_bytes
    groups = rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = pin(groups.where((F.col("n") > 1) & F.col("last").isNotNull()))
    count = copies.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if count["groups"] <= BROADCAST_GROUPS:
        met = rows.join(F.broadcast(copies.drop("n")), "sha1", "left")
    else:
        many = join_named(rows, copies, "sha1", "n", count["rows"])
        # Rows outside the groups stay; a group's rows are those with its digest and size.
        keys = copies.select("sha1")
        met = many.unionByName(rows.join(keys, "sha1", "left_anti").withColumn("last", F.lit(None).cast("long")))
    revisit = large & F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False)) & F.col("last").isNotNull()
    return met.select("page_id", "url", "payload", "payload_bytes", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_packages(linked: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes ``linked`` as packages under ``folder``; returns the pinned ``package, bytes, records``.  Partitions without rows write none."""

    def run(batches):
        import pyarrow as pa

        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        done, lines, file, out, name = [], [], None, None, None

        def finish():
            nonlocal file
            out.end()
            out.begin(INDEX)
            out.write("".join(lines).encode())
            out.end()
            size = out.close()
            file.close()
            done.append((name, size, len(lines)))
            lines.clear()
            file = None

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if file is None:
                        name = f"{folder}/{uuid.uuid4().hex}.zip"
                        file = files.open_output_stream(f"{root}/{name.rpartition('/')[2]}")
                        out = PackageWriter(file, zip64)
                        out.begin(DATA)
                    row["payload_digest"] = base64.b32encode(bytes.fromhex(row.pop("sha1"))).decode()
                    raw = gzip.compress(record_bytes(row, f"{name}:{len(lines)}"), 3, mtime=0)
                    place = out.write(raw)
                    about = {"offset": str(place), "length": str(len(raw)), "digest": f"sha1:{row['payload_digest']}"}
                    lines.append(f"{row['page_id']} {_DATE} {json.dumps(about)}\n")
                    if place + len(raw) >= package_bytes:
                        finish()
        if file is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["package", "bytes", "records"])

    return pin(linked.mapInArrow(run, "package string, bytes long, records long"))


def list_ranges(packages: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """``package, bytes, offset, lengths``: neighbouring records of a package, together ``read_bytes`` or one record."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["package"])
                with files.open_input_file(path) as file:
                    entries = sorted(PackageReader(_ranged(file), row["bytes"]).index(), key=lambda e: e["offset"])
                if len(entries) != row["records"]:
                    raise ValueError("an index does not name all records")
                spans: list[tuple[int, list[int]]] = []
                for e in entries:
                    if spans and spans[-1][0] + sum(spans[-1][1]) == e["offset"] and e["offset"] + e["length"] - spans[-1][0] <= read_bytes and len(spans[-1][1]) < 512:
                        spans[-1][1].append(e["length"])
                    else:
                        spans.append((e["offset"], [e["length"]]))
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["package"]] * n), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans], type=pa.list_(pa.int64()))],
                    names=["package", "offset", "lengths"],
                )

    return packages.mapInArrow(run, "package string, offset long, lengths array<long>")


def read_records(ranges: DataFrame) -> DataFrame:
    """The records in ``ranges``, one row each, every digest checked.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload`` (null for revisits).  Damaged packages raise ``ValueError``.
    """
    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType

    schema = to_arrow_schema(DataType.fromDDL(ddl))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["package"])
                with files.open_input_file(path) as file:
                    data = _ranged(file)(row["offset"], sum(row["lengths"]))
                records, at = [], 0
                for length in row["lengths"]:
                    headers, block = parse_record(gzip.decompress(data[at : at + length]))
                    at += length
                    records.append(_row(headers, block))
                yield pa.RecordBatch.from_pylist(records, schema=schema)

    return ranges.mapInArrow(run, ddl)


def _row(headers: dict[str, str], block: bytes) -> dict:
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    size = int(headers["x-payload-length"])
    payload = block.partition(b"\r\n\r\n")[2]
    if not revisit and (digest != digest32(payload) or size != len(payload)):
        raise ValueError("a payload does not match its digest")
    url = headers.get("warc-target-uri")
    return {
        "page_id": _page(headers["x-page"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": headers["warc-type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(headers["x-refers-to-page"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def archive_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False) -> DataFrame:
    """Writes ``pages`` as packages in the shared folder and returns the pinned list of packages.

    Null html is empty, html of any length is one record, repeated rows are
    records of their own, other columns are left out, and an empty table writes
    no package.
    """
    return write_packages(link_copies(pages, id_col, url_col, html_col), fresh_dir(spark, "warc"), zip64=zip64)


def read_packages(packages: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of ``packages``: directories and indexes first, then the ranges.

    A package or a range is a short row and much work, so both are dealt to a
    stated number of tasks: by the packages' count and by their bytes.
    """
    row = packages.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = packages.sparkSession.sparkContext.defaultParallelism
    tasks = lambda wanted: int(max(1, min(wanted, 100_000)))
    listed = list_ranges(packages.repartition(tasks(row["n"]), "package"), read_bytes)
    return read_records(listed.repartition(tasks(max(row["bytes"] // read_bytes, min(2 * cores, row["bytes"] // 100_000))), "package", "offset"))
