"""GIF media columns: LZW coding both ways, palettes, disposal and transparency, timed frames.

``payload_media`` stores bytes losslessly as the 8-bit samples of a GIF animation (rows of
576 samples, up to 64 rows a frame, grey palette).  ``decode`` is a decoder for GIF87a and
GIF89a in general: global and local palettes, interlacing, transparency, the three disposal
methods, loop counts and delays.  ``frames`` composes the canvas as a player shows it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.store import written

WIDTH, HEIGHT = 576, 64
#: Hundredths of a second that a stored frame is shown.
DELAY = 4
MOST_CODES = 4096


class BadGif(ValueError):
    """The bytes are no GIF, or one that ends early."""


# --- LZW ---------------------------------------------------------------------------------


def _widths(depth: int, n: int) -> np.ndarray:
    """Bits of each of n codes after a clear code (a reader adds an entry for all but the first)."""
    entries = (1 << depth) + 1 + np.arange(n)  # entries known before the code is read, less one for the first
    return np.minimum(np.maximum(depth + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(int) + 1), 12)


_schedule: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _plan(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(widths, bit offsets) of the codes after a clear code, until the table is full and a little on."""
    if depth not in _schedule:
        w = _widths(depth, MOST_CODES)
        _schedule[depth] = w, np.concatenate([[0], np.cumsum(w)])
    return _schedule[depth]


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """Samples below 1 << depth as one LZW code stream; a full table is cleared."""
    clear = 1 << depth
    widths, _ = _plan(depth)
    full = MOST_CODES - clear - 2
    streams: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, put, new = table.get, codes.append, clear + 2
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = new
        new += 1
        prefix = b
        if len(codes) == full:
            streams.append(codes)
            codes, new = [], clear + 2
            put = codes.append
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    streams.append(codes)
    values, sizes = [], []
    first = depth + 1
    for n, part in enumerate(streams):
        values += [clear, *part]
        sizes += [np.array([first]), widths[: len(part)]]
        first = int(widths[len(part)])  # the next clear or end code is read at the width reached
    values.append(clear + 1)
    sizes.append(np.array([first]))
    return _pack(np.array(values, np.uint32), np.concatenate(sizes))


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as bits, the least significant first."""
    place = np.arange(12)
    bits = ((values[:, None] >> place) & 1).astype(np.uint8)
    return np.packbits(bits[place < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; early ends give what there is."""
    clear, end = 1 << depth, (1 << depth) + 1
    widths, offsets = _plan(depth)
    bits = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = bits[:-3] | bits[1:-2] << 8 | bits[2:-1] << 16 | bits[3:] << 24
    total = 8 * len(data)
    roots = [bytes([i]) for i in range(clear)]
    out: list[bytes] = []
    size, at, width = 0, 0, depth + 1

    def code_at(bit: int, w: int) -> int:
        return int(words[bit >> 3]) >> (bit & 7) & ((1 << w) - 1)

    if total >= width and code_at(0, width) == clear:
        at = width
    while at < total and size < most:
        # the codes up to the next clear or end code, read as if there were none
        starts = at + offsets[:-1]
        n = int(np.searchsorted(starts + widths, total, side="right"))
        if not n:
            break
        codes = (words[starts[:n] >> 3] >> (starts[:n] & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stops[0]) if len(stops) else n
        table = [*roots, b"", b""]
        add, put = table.append, out.append
        previous = b""
        for code in codes[:used].tolist():
            if code < len(table):
                entry = table[code]
                if previous and len(table) < MOST_CODES:
                    add(previous + entry[:1])
            elif previous and code == len(table):
                entry = previous + previous[:1]
                add(entry)
            else:
                raise BadGif("LZW: a code that is not in the table")
            put(entry)
            size += len(entry)
            previous = entry
        if len(stops):
            if codes[used] == end:
                break
            at += int(offsets[used] + widths[used])
        elif n < len(widths):
            break
        else:  # a full table goes on at 12 bits
            at += int(offsets[n])
            while at + 12 <= total:
                code = code_at(at, 12)
                at += 12
                if code in (clear, end):
                    break
                previous = table[code]
                out.append(previous)
                size += len(previous)
            if at + 12 > total or code == end:
                break
    return b"".join(out)[:most]


# --- container -----------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """Rows of ``width`` samples as an animation of full-palette frames of up to ``height`` rows."""
    rows = len(samples) // width
    screen = min(rows, height)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", width.to_bytes(2, "little"), screen.to_bytes(2, "little"), b"\xf7\0\0", grey]
    for top in range(0, rows, height):
        part = samples[top * width : (top + height) * width]
        out += [b"\x21\xf9\x04\x04", delay.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image as stored: sample indices, its place, palette (256 x 3), and how it is shown."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int


def _unlaced(rows: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(rows), 0
    for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(start, len(rows), step))
        out[start::step] = rows[at : at + n]
        at += n
    return out


def decode(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """(canvas width, height, frames in order, one in memory at a time)."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")

    def number(at: int) -> int:
        return int.from_bytes(data[at : at + 2], "little")

    def table(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        colours = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        return np.concatenate([colours, np.zeros((256 - n, 3), np.uint8)]), at + 3 * n

    def chained(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    def images() -> Iterator[Frame]:
        at, palette = 13, np.zeros((256, 3), np.uint8)
        if data[10] & 0x80:
            palette, at = table(at, data[10])
        delay, disposal, transparent = 0, 0, -1
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                body, after = chained(at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                    transparent = body[3] if body[0] & 1 else -1
                at = after
            elif data[at] == 0x2C:
                if at + 10 > len(data):
                    raise BadGif("an image descriptor ends early")
                left, top, width, height, flags = number(at + 1), number(at + 3), number(at + 5), number(at + 7), data[at + 9]
                own, at = table(at + 10, flags) if flags & 0x80 else (palette, at + 10)
                depth = data[at] if at < len(data) else 0
                if not 1 <= depth <= 8:
                    raise BadGif("a sample depth that GIF does not have")
                body, at = chained(at + 1)
                flat = np.frombuffer(lzw_decode(body, depth, width * height).ljust(width * height, b"\0"), np.uint8)
                rows = flat.reshape(height, width)
                yield Frame(left, top, _unlaced(rows) if flags & 0x40 else rows, own, delay, disposal, transparent)
                delay, disposal, transparent = 0, 0, -1
            else:
                raise BadGif("an unknown block")

    return number(6), number(8), images()


def composed(width: int, height: int, images: Iterable[Frame]) -> Iterator[tuple[int, Frame, np.ndarray]]:
    """(start in hundredths of a second, image, canvas as height x width x RGBA as it is shown).

    The canvas is the player's own: it changes as soon as the next image is asked for.
    """
    canvas = np.zeros((height, width, 4), np.uint8)
    start = 0
    for f in images:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        indices = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.concatenate([f.palette, np.full((256, 1), 255, np.uint8)], axis=1)
        if 0 <= f.transparent and (shown := indices != f.transparent).sum() < indices.size:
            area[shown] = colours[indices[shown]]
        else:
            area[...] = colours.view(np.uint32).ravel()[indices].view(np.uint8).reshape(*indices.shape, 4)
        yield start, f, canvas
        start += f.delay
        if f.disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas[...] = before


def frames(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in hundredths of a second, delay, canvas as height x width x RGBA) of each frame."""
    for start, f, canvas in composed(*decode(data)):
        yield start, f.delay, canvas.copy()


def colour_histogram(pixels: np.ndarray, bits: int = 2) -> np.ndarray:
    """Counts of shown pixels by the leading bits of red, green and blue."""
    shift = np.uint8(8 - bits)
    bins = ((pixels[..., 0] >> shift).astype(np.uint16) << 2 * bits) | ((pixels[..., 1] >> shift).astype(np.uint16) << bits) | (pixels[..., 2] >> shift)
    bins[pixels[..., 3] == 0] = 1 << 3 * bits
    return np.bincount(bins.ravel(), minlength=(1 << 3 * bits) + 1)[: 1 << 3 * bits]


# --- columns -------------------------------------------------------------------------------


def _padded(data: bytes, unit: int) -> bytes:
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\xff")


_MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(_MEDIA)
    for ident, text in rows_of(batches, 64):
        data = (text or "").encode()
        media = encode(_padded(data, WIDTH))
        yield from sink.add((ident, len(data), media), len(media))
    yield from sink.end()


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to rows of 576, as a GIF.

    Null counts as empty; an empty text is one row of padding; equal texts, equal media.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_encoded, "id long, n_bytes long, media binary")


_FRAMES = pa.schema([("id", pa.int64()), ("frame", pa.int64()), ("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])


def _framed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(_FRAMES)
    for ident, media in rows_of(batches, 16):
        n = 0
        try:
            for n, (start, delay, pixels) in enumerate(frames(media or b"")):
                yield from sink.add((ident, n, start, delay, pixels.shape[1], pixels.shape[0], colour_histogram(pixels).tolist(), None), 1024)
        except BadGif as e:
            yield from sink.add((ident, None, None, None, None, None, None, str(e)))
    yield from sink.end()


def timed_frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF: start, delay, size, 64-bin colour histogram.

    What is no GIF (null included) gives a row with the reason in ``error``.
    """
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(
        _framed, "id long, frame long, start_cs long, delay_cs long, width long, height long, histogram array<long>, error string"
    )


_TIMED = pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("histogram", pa.list_(pa.int64()))])
_DIGESTS = pa.schema([
    ("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.list_(_TIMED)),
])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples read back frame by frame: never more than a frame and a text's media in memory."""
    sink = Sink(_DIGESTS)
    for ident, n_bytes, media in rows_of(batches, 16):
        whole, size, tail, timed = hashlib.sha256(), 0, b"", []
        shown = np.zeros(64, np.int64)
        for start, f, canvas in composed(*decode(media)):
            samples = f.indices.tobytes()
            whole.update(samples)
            size += len(samples)
            tail = (tail + samples[-32:])[-32:]
            colours = colour_histogram(canvas)
            shown += colours * max(1, f.delay)
            timed.append((start, f.delay, colours.tolist()))
        feature = f"frames={len(timed)};cs={sum(t[1] for t in timed)};rgb64=" + ",".join(f"{c}:{n}" for c, n in enumerate(shown.tolist()) if n)
        row = (ident, n_bytes, size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, [dict(zip(("start_cs", "delay_cs", "histogram"), t, strict=True)) for t in timed])
        yield from sink.add(row, 512 * (1 + len(timed)))
    yield from sink.end()


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a GIF in a written table, read back, played, and described.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of what the decoder returns),
    media_bytes, media_sha256, feature (frames, duration, hundredths of a second that pixels
    of each colour bin are shown), frames (start, delay and colour histogram of each, as the
    canvas stands after palette, transparency and disposal).  Null and empty texts, repeats,
    extra columns and empty tables: as payload_media.
    """
    stored = written(payload_media(docs, id_col, text_col), "media")
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_cs:long,delay_cs:long,histogram:array<long>>>"
    return stored.mapInArrow(_digested, schema).withColumnRenamed("id", id_col)
