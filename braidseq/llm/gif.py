"""GIF: a codec for texts as 8-bit images, and a decoder of frames with their colours.

``encode_payload`` stores bytes losslessly: rows of ``WIDTH`` samples with a
colour for each byte, in timed frames of at most ``FRAME_ROWS`` rows that are
cleared after they are shown, LZW-coded.  ``decode`` reads any GIF of the 1989a
format: global and local palettes, interlace, disposal, transparency and delays,
and gives each frame's samples and the canvas after it is drawn.  What the
queries read, payload and features, they read off these canvases.  Everything
works on one image at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import append_columns

WIDTH = 192
FRAME_ROWS = 64
DELAY = 4  # hundredths of a second
_MOST = 4096
#: The palette: a byte is its red; green and blue spread the histograms.
_COLOURS = bytes(v for i in range(256) for v in (i, 255 - i, i * 5 % 256))
#: Pixels of a canvas at most; a larger one counts as damaged, as its header decides how much memory is taken.
MOST_PIXELS = 1 << 26
BINS = 16
#: Disposal methods: the frame's area is cleared, or set back to what it was.
_CLEAR, _RESTORE = 2, 3


# Codes since a clear code: the j-th has 9 bits up to the 255th, and so on; the same for reader and writer.
def _widths(first: int, count: int, size: int) -> np.ndarray:
    known = (1 << size) + 2 + np.maximum(0, np.arange(first, first + count) - 1)
    return np.minimum(12, np.frexp(np.maximum(known, 1).astype(np.float64))[1]).clip(min=size + 1)


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """LZW codes of ``samples``, each below ``2 ** size``: a clear code first and whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    codes: list[int] = []  # 256 times each code, as table keys and values are too
    table: dict[int, int] = {}
    find, put, free = table.get, codes.append, (end + 1) << 8
    if samples:
        now = samples[0] << 8
        for byte in samples[1:]:
            if (longer := find(now | byte)) is not None:
                now = longer
                continue
            put(now)
            table[now | byte] = free
            now = byte << 8
            free += 256
            if free == _MOST << 8:
                codes.append(clear << 8)
                runs.append(codes)
                codes = []
                put = codes.append
                table.clear()
                free = (end + 1) << 8
        put(now)
    runs.append([*codes, end << 8])
    values = np.concatenate([np.array([clear << 8]), *runs]).astype(np.int32) >> 8
    widths = np.concatenate([np.array([size + 1]), *[_widths(0, len(run), size) for run in runs]])
    at = np.cumsum(widths) - widths
    bits = np.zeros(int(at[-1] + widths[-1]), dtype=np.uint8)
    for b in range(int(widths.max())):
        own = widths > b
        bits[at[own] + b] = values[own] >> b & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, limit: int) -> bytes:
    """The samples of LZW codes, ``limit`` at most; codes after the end, or a stream without an end, add nothing."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")
    clear, end = 1 << size, (1 << size) + 1
    out = []
    at, done = 0, 0
    while done < limit:
        codes, at, last = _epoch(bits, at, size, clear, end)
        if len(codes):
            out.append(_expand(codes, clear))
            done += len(out[-1])
        if last != clear:
            break
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint8))[:limit].tobytes()


def _epoch(bits: np.ndarray, at: int, size: int, clear: int, end: int) -> tuple[np.ndarray, int, int]:
    """The codes up to the next clear or end code, the place after it, and which it was (-1: the data ended)."""
    found: list[np.ndarray] = []
    first = 0
    while True:
        width = int(_widths(first, 1, size)[0])
        # Codes of this width: until the table holds 2 ** width entries.
        span = max(1, (1 << width) - ((1 << size) + 2) + 1 - first) if width < 12 else _MOST
        span = min(span, (len(bits) - at) // width)
        if span <= 0:
            return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), at, -1
        block = bits[at : at + span * width].reshape(span, width)
        codes = np.zeros(span, dtype=np.int32)
        for b in range(width):
            codes |= block[:, b].astype(np.int32) << b
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            stop = int(stops[0])
            return np.concatenate([*found, codes[:stop]]), at + (stop + 1) * width, int(codes[stop])
        found.append(codes)
        at += span * width
        first += span


def _expand(codes: np.ndarray, roots: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    Table entry ``roots + 2 + k`` is what the k-th code wrote and the sample
    after it.  So the j-th code copies from where an earlier code wrote, or is
    a sample itself: its length is its distance from a sample along that chain,
    and every sample's value is found by following the copies, both by pointer
    doubling.
    """
    parent = codes - (roots + 2)
    own = np.arange(len(codes))
    literal = codes < roots
    if (np.where(literal, -1, parent) >= np.minimum(own, _MOST - roots - 2)).any() or ((codes >= roots) & (parent < 0)).any():
        raise ValueError("damaged LZW data")
    jump = np.where(literal, own, parent)
    length = np.where(literal, 0, 1)
    while True:  # steps to a sample
        further = length + length[jump]
        jump = jump[jump]
        if (further == length).all():
            break
        length = further
    length += 1
    start = np.cumsum(length) - length
    move = np.where(literal, 0, start - start[np.where(literal, 0, parent)])
    source = np.arange(int(length.sum())) - np.repeat(move, length)
    while True:  # every place to the place of a sample
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(source), dtype=np.uint8)
    value[start[literal]] = codes[literal]
    return value[source]


def encode_payload(payload: bytes) -> bytes:
    """A GIF whose samples are ``payload``, which must fill rows of ``WIDTH``."""
    rows, rest = divmod(len(payload), WIDTH)
    if rest or not rows:
        raise ValueError(f"a payload fills one or more rows of {WIDTH} bytes")
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _COLOURS]
    for top in range(0, rows, FRAME_ROWS):
        height = min(FRAME_ROWS, rows - top)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", _CLEAR << 2, DELAY, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, height, 0) + b"\x08")
        coded = lzw_encode(payload[top * WIDTH : (top + height) * WIDTH])
        parts += [bytes([len(block)]) + block for block in (coded[i : i + 255] for i in range(0, len(coded), 255))]
        parts.append(b"\0")
    parts.append(b"\x3b")
    return b"".join(parts)


@dataclass
class Frame:
    """``samples``: palette indexes of the frame's own area, row by row; ``canvas``: height x width x RGBA after drawing."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int
    samples: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray | None

    def colours(self) -> np.ndarray:
        """The frame's own area as RGB."""
        return self.palette[self.samples]

    def shown(self) -> np.ndarray:
        """The frame's own area of the canvas, RGBA."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode(data: bytes, canvases: bool = True):
    """Yields the frames of a GIF.  Damaged data raise ``ValueError``, whatever is damaged."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas too large")
    at = 13
    shared = None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), dtype=np.uint8) if canvases else None
    delay, disposal, transparent = 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21 and at + 2 <= len(data):
            label = data[at + 1 : at + 2]
            body, at = _blocks(data, at + 2)
            if label == b"\xf9" and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise ValueError("damaged GIF")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if packed & 0x80:
            palette, at = _palette(data, at, packed)
        if palette is None:
            raise ValueError("a frame without a palette")
        if at >= len(data) or not 2 <= data[at] <= 8 or w * h > MOST_PIXELS:
            raise ValueError("a frame without sound data")
        size = data[at]
        body, at = _blocks(data, at + 1)
        raw = lzw_decode(body, size, w * h)
        if len(raw) != w * h:
            raise ValueError("a frame's data end early")
        samples = np.frombuffer(raw, dtype=np.uint8)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty((h, w), dtype=np.uint8)
            plain[order] = samples.reshape(h, w)
            samples = plain.ravel()
        shown = None
        if canvas is not None:
            saved = canvas.copy() if disposal == _RESTORE else None
            area = canvas[top : top + h, left : left + w]
            part = samples.reshape(h, w)[: area.shape[0], : area.shape[1]]
            drawn = _opaque(palette)[part]
            if transparent >= 0:
                kept = part == transparent
                drawn[kept] = area[kept]
            area[:] = drawn
            shown = canvas.copy()
            if disposal == _CLEAR:
                area[:] = 0
            elif disposal == _RESTORE:
                canvas = saved
        yield Frame(left, top, w, h, delay * 10, disposal, transparent, samples, palette, shown)
        delay, disposal, transparent = 0, 0, -1
    raise ValueError("a GIF without an end")


def _opaque(palette: np.ndarray) -> np.ndarray:
    """The palette as RGBA without transparency."""
    return np.concatenate([palette, np.full((len(palette), 1), 255, dtype=np.uint8)], axis=1)


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    end = at + 3 * (2 << (flags & 7))
    colours = np.frombuffer(data[at:end], dtype=np.uint8)
    if at + len(colours) != end:
        raise ValueError("a palette ends early")
    full = np.zeros((256, 3), dtype=np.uint8)
    full[: len(colours) // 3] = colours.reshape(-1, 3)
    return full, end


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("blocks end early")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``3 x bins`` counts of red, green and blue over the pixels of an RGBA canvas that anything is drawn on."""
    seen = canvas.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    level = seen[:, :3] // (256 // bins)
    return np.stack([np.bincount(level[:, c], minlength=bins) for c in range(3)])


def _frame_row(frame: Frame) -> dict:
    red, green, blue = histogram(frame.canvas).tolist()
    return {
        "left": frame.left, "top": frame.top, "width": frame.width, "height": frame.height, "delay_ms": frame.delay_ms,
        "disposal": frame.disposal, "transparent": frame.transparent, "red": red, "green": green, "blue": blue,
    }


_FRAMES = (
    "frames array<struct<left: int, top: int, width: int, height: int, delay_ms: int, disposal: int, transparent: int, red: array<long>, green: array<long>, blue: array<long>>>, error string"
)


def store_as_gif(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (of the UTF-8 text; null: 0) and ``media``, the GIF of the text padded with spaces to full rows.

    Null and empty texts are one row of spaces.  Equal texts have equal media.
    """

    def start():
        def work(batch):
            sizes, media = [], []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(encode_payload(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH)))
            return [sizes, media]

        return work

    return append_columns(docs, "n_bytes long, media binary", text_col, start)


def read_frames(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with ``frames``, one entry a frame: place, delay, disposal, transparent index (-1: none) and the colour histograms of the canvas; and ``error``.

    Null media have null frames.  Damaged media have null frames and an
    ``error``, and end no job.  Other columns pass through; columns named like
    a result are replaced.  Repeated rows are rows of their own; empty tables
    give empty results.
    """

    def start():
        def work(batch):
            out, errors = [], []
            for media in batch.column(media_col).to_pylist():
                frames, error = None, None
                if media is not None:
                    try:
                        frames = [_frame_row(f) for f in decode(media)]
                    except ValueError as e:
                        error = str(e)
                out.append(frames)
                errors.append(error)
            return [out, errors]

        return work

    return append_columns(stored, _FRAMES, media_col, start)


def read_payload(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with what its GIFs by ``encode_payload`` hold, from the stored bytes alone, and with the columns of ``read_frames``.

    ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 16): of
    the red of each frame's own area on the canvas, after palette, transparency
    and disposal.  ``media_bytes``, ``media_sha256``: of the stored bytes.
    Null and damaged media as in ``read_frames``; the payload's columns are null
    then.
    """

    def start():
        def one(media):
            digest, size, tail, frames = hashlib.sha256(), 0, b"", []
            stored_form = len(media), hashlib.sha256(media).hexdigest()
            try:
                for f in decode(media):
                    raw = f.shown()[..., 0].tobytes()
                    digest.update(raw)
                    size, tail = size + len(raw), (tail + raw)[-16:]
                    frames.append(_frame_row(f))
            except ValueError as e:
                return None, None, None, *stored_form, None, str(e)
            return size, digest.hexdigest(), zlib.crc32(tail), *stored_form, frames, None

        def work(batch):
            rows = [(None,) * 7 if m is None else one(m) for m in batch.column(media_col).to_pylist()]
            return [list(x) for x in zip(*rows)] or [[]] * 7

        return work

    ddl = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, {_FRAMES}"
    return append_columns(stored, ddl, media_col, start)
