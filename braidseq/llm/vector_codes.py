"""Product codes of vectors: each part's nearest codebook entry by segment-mean lower bounds.

For a block of a part, the squared distance to an entry is at least the block
length times the squared difference of the means plus the squared difference
of the residuals' norms.  Bounds over ever shorter blocks, coarse to fine,
drop entries that can't be nearest; they are conservative, rounding included.
The exact integer distances of the survivors decide, ties to the lower index.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_named
from .common import finite_vectors, of_common_width, stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors a task compares at once.
BLOCK_ROWS = 4096
#: Grid values beyond this in size would overflow a squared distance.
MOST_VALUE = 1 << 26


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]``: integer vectors."""

    entries: np.ndarray

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _bounds(length: int) -> list[np.ndarray]:
    """The starts of blocks, coarse to fine: one block, two, four, as long as blocks have two components at least."""
    out, blocks = [], 1
    while length // blocks >= 2:
        out.append(np.arange(blocks) * length // blocks)
        blocks *= 2
    return out


def _features(x: np.ndarray, starts: np.ndarray):
    """Means scaled by the root of the block's length, and residual norms, of each block."""
    sizes = np.diff(np.append(starts, x.shape[1]))
    sums = np.add.reduceat(x, starts, axis=1).astype(np.float64)
    squares = np.add.reduceat(x * x, starts, axis=1).astype(np.float64)
    return sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0.0))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the index of the nearest of ``entries``, of ties the lowest, its squared distance, and how many exact distances it took."""
    n, m = len(x), len(entries)
    own = np.arange(n)
    levels = _bounds(x.shape[1])
    # Rounding of a bound is far below this share of the squared norms.
    slack = 1e-9 * ((x * x).sum(axis=1).astype(np.float64)[:, None] + (entries * entries).sum(axis=1).astype(np.float64)) + 1e-6
    if not levels:
        row, col = np.repeat(own, m), np.tile(np.arange(m), n)
    else:
        (xm, xr), (em, er) = _features(x, levels[0]), _features(entries, levels[0])
        low = (xm - em.T) ** 2 + (xr - er.T) ** 2
        least = x - entries[low.argmin(axis=1)]
        most = (least * least).sum(axis=1)
        row, col = np.nonzero(low <= most[:, None] + slack)
        for starts in levels[1:]:
            (xm, xr), (em, er) = _features(x, starts), _features(entries, starts)
            low = ((xm[row] - em[col]) ** 2 + (xr[row] - er[col]) ** 2).sum(axis=1)
            stays = low <= most[row] + slack[row, col]
            row, col = row[stays], col[stays]
    off = x[row] - entries[col]
    far = (off * off).sum(axis=1)
    # Pairs lie by row, then by entry; the nearest entry of a row always survives.
    first = np.searchsorted(row, own)
    best = np.minimum.reduceat(far, first)
    hits = np.flatnonzero(far == best[row])
    return col[hits[np.searchsorted(row[hits], own)]], best, len(row)


def _matrix(batch, width: int) -> np.ndarray:
    x = np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(batch.num_rows, width)
    if np.abs(x).max(initial=0) > MOST_VALUE:
        raise ValueError("a component is too large for exact distances")
    return x


def _blocks(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            yield whole.slice(at, BLOCK_ROWS)


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry as the floor of the mean of the parts that are nearest to it; entries without one stay."""
    entries = books.entries
    parts, m, length = entries.shape
    named = [f"s{i}" for i in range(length)]

    def run(batches):
        import pyarrow as pa

        totals = np.zeros((parts, m, length + 1), dtype=np.int64)
        for batch in _blocks(batches):
            x = _matrix(batch, parts * length).reshape(-1, parts, length)
            for p in range(parts):
                at = nearest(x[:, p], entries[p])[0]
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                met = at[order][starts]
                totals[p, met, :-1] += np.add.reduceat(x[order, p], starts, axis=0)
                totals[p, met, -1] += np.bincount(at, minlength=m)[met]
        part, entry = np.nonzero(totals[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), *(pa.array(c) for c in totals[part, entry].T)], ["part", "entry", *named, "count"])

    made = rows.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in ["part", "entry", *named, "count"]))
    new = entries.copy()
    for r in made.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in [*named, "count"])).collect():
        new[r["part"], r["entry"]] = [r[c] // r["count"] for c in named]
    return Codebooks(new)


def train_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``id, x``: they start as the parts of the ``entries`` rows with the smallest ids (nulls last; of equal ids the smaller vector first)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, width // parts)
    if np.abs(start).max(initial=0) > MOST_VALUE:
        raise ValueError("a component is too large for exact distances")
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _means(rows, books)
    return books


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``codes`` (binary, a byte a part) and ``error`` (the squared distances of all parts) in place of ``x``."""
    from pyspark.sql.types import BinaryType, LongType, StructType

    entries = books.entries
    parts, _, length = entries.shape
    kept = [c for c in rows.columns if c != "x"]
    schema = StructType([rows.schema[c] for c in kept]).add("codes", BinaryType()).add("error", LongType())

    def run(batches):
        import pyarrow as pa

        for batch in _blocks(batches):
            x = _matrix(batch, parts * length).reshape(-1, parts, length)
            found = [nearest(x[:, p], entries[p])[:2] for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], [*kept, "codes", "error"])

    return rows.select(*kept, "x").mapInArrow(run, schema)


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``<id>, <label>, codes, error, label_error, codebooks_sha256`` for each kept row of ``df``.

    Rows whose vector is null or holds a null, NaN or infinite component go.
    Of vectors of unlike widths those of the commonest width stay (of ties the
    widest); a width that ``parts`` doesn't divide is filled up with zeros.
    With fewer rows than ``entries`` the codebooks have an entry a row.  Rows
    with equal or null ids are rows of their own.  ``label_error`` sums
    ``error`` over equal labels, nulls together.  Other columns are left out,
    so none can clash.  Empty tables give empty results.  Components beyond
    2^26 / 256 in size raise a ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    named = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    rows = of_common_width(finite_vectors(named, "x", SCALE), "x")
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("x"), F.lit(parts))))
    rows = stored(rows.withColumn("x", filled), "vectors")
    first = rows.select(F.size("x").alias("w")).first()
    width = first["w"] if first else 0
    books = train_codebooks(rows, width, parts, entries, rounds) if width else Codebooks(np.zeros((parts, 0, 0), dtype=np.int64))
    if not width:  # nothing is kept, or vectors without components
        coded = rows.select("id", "label", F.lit(bytes(parts)).alias("codes"), F.lit(0).cast("long").alias("error"))
    else:
        coded = stored(encode_vectors(rows, books), "codes")
    key = F.to_json(F.struct("label"))  # nulls are a label too
    coded = coded.withColumn("_key", key)
    sums = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = join_named(coded, sums, "_key", "_n", coded.count())
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
