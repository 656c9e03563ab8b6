"""Media columns: GIF images as bytes, timed frames and colour histograms.

The decoder reads LZW code streams of any code size, global and local palettes, interlaced
rows, transparency and the disposal methods, and composes each frame on the canvas. The
encoder writes byte samples as indices of a palette whose colour i is (i, i, i), so what the
decoder composes is the payload again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import as_bytes, blocks, documents, text_column

#: Samples of a row, rows of a frame, hundredths of a second that a frame shows.
WIDTH, ROWS, DELAY = 64, 1024, 10
UNIT = 64
#: Codes have 12 bits at most, so a table has 4096 entries.
FULL = 4096
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """One composed frame: RGBA canvas, its own rectangle (left, top, width, height), delay in ms."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    delay_ms: int

    def histogram(self) -> list[int]:
        """64 counts of visible pixels: two high bits of red, green and blue."""
        high = self.canvas[..., :3] >> 6
        index = (high[..., 0].astype(np.int64) << 4) | (high[..., 1] << 2) | high[..., 2]
        return np.bincount(index[self.canvas[..., 3] > 0], minlength=64).tolist()


def _widths(code_size: int) -> np.ndarray:
    """Bits of the j-th code after a clear code."""
    clear = 1 << code_size
    next_free = clear + 1 + np.arange(FULL + 2)
    return np.minimum(12, np.maximum(code_size + 1, np.floor(np.log2(next_free)).astype(np.int64) + 1))


_EDGES = {m: np.concatenate([[0], np.cumsum(_widths(m))]) for m in range(1, 12)}
_BITS = {m: _widths(m) for m in range(1, 12)}


def lzw_encode(data: bytes, code_size: int = 8) -> bytes:
    """Codes with a clear code first and whenever the table is full, packed from the lowest bit on."""
    clear = 1 << code_size
    runs: list[list[int]] = []
    out: list[int] = []
    table: dict[int, int] = {}
    get, append = table.get, out.append
    first, full = (clear + 2) << 8, FULL << 8
    free = first
    samples = iter(data)
    p = next(samples, None)
    if p is not None:
        p <<= 8
        for b in samples:
            q = get(p | b)
            if q is not None:
                p = q
                continue
            append(p >> 8)
            table[p | b] = free
            free += 256
            p = b << 8
            if free == full:
                append(clear)
                runs.append(out)
                out = []
                append = out.append
                table.clear()
                free = first
        append(p >> 8)
    append(clear + 1)
    runs.append(out)
    bits = _BITS[code_size]
    codes = np.concatenate([[clear], *runs]).astype(np.uint64)
    size = np.concatenate([bits[:1], *(bits[: len(r)] for r in runs)])
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
    word = at >> 5
    lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    group = np.bitwise_or.reduceat(codes << (at & 31).astype(np.uint64), lead)
    words[word[lead]] |= group & np.uint64(0xFFFFFFFF)
    words[word[lead] + 1] |= group >> np.uint64(32)
    return words.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


def lzw_decode(data: bytes, code_size: int) -> bytes:
    """Samples of a code stream; a stream without an end code ends with its last whole code."""
    clear, stop = 1 << code_size, (1 << code_size) + 1
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] | (raw[1:-2] << 8) | (raw[2:-1] << 16) | (raw[3:] << 24)
    edges, bits, total = _EDGES[code_size], _BITS[code_size], 8 * len(data)
    literal = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = 0
    while at < total:
        known = int(np.searchsorted(edges, total - at, "right")) - 1
        known = min(known, FULL)
        extra = max(0, (total - at - int(edges[known])) // 12) if known == FULL else 0
        offsets, size = at + edges[:known], bits[:known]
        if extra:  # a full table that no clear code has emptied
            offsets = np.concatenate([offsets, at + edges[known] + 12 * np.arange(extra)])
            size = np.concatenate([size, np.full(extra, 12)])
        codes = (window[offsets >> 3] >> (offsets & 7).astype(np.uint32)) & ((1 << size) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else len(codes)
        at = int(offsets[n]) + int(size[n]) if n < len(codes) else total
        run = codes[:n].tolist()
        if run:
            table = literal.copy()
            if run[0] >= clear:
                raise ValueError("a code stream begins with a code that no table has")
            prev = table[run[0]]
            out.append(prev)
            add, put, top = table.append, out.append, len(table)
            for code in run[1:]:
                if code < top:
                    entry = table[code]
                elif code == top and top < FULL:
                    entry = prev + prev[:1]
                else:
                    raise ValueError("a code stream has a code that no table has")
                put(entry)
                if top < FULL:
                    add(prev + entry[:1])
                    top += 1
                prev = entry
        if n < len(codes) and int(codes[n]) == stop:
            break
    return b"".join(out)


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    parts = [b"\xff" + data[255 * k : 255 * k + 255] for k in range(whole)]
    if len(data) % 255:
        parts.append(bytes([len(data) % 255]) + data[255 * whole :])
    return b"".join(parts) + b"\0"


def encode_samples(payload: bytes) -> bytes:
    """Bytes, a positive multiple of WIDTH, as a GIF of frames of at most ROWS rows."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        data = payload[WIDTH * top : WIDTH * (top + n)]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08", _sub_blocks(lzw_encode(data))]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed on the canvas. Raises ValueError if it isn't a whole GIF."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as error:
        raise ValueError("the GIF is cut short") from error


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, *_ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            if label == 0xF9 and data[at] >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", data, at + 1)
                delay, disposal, clear = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block in a GIF")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("a frame without a palette")
        code_size = data[at]
        at += 1
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        if not 1 <= code_size <= 11:
            raise ValueError("a code size that GIF doesn't have")
        samples = np.frombuffer(lzw_decode(b"".join(parts), code_size), np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame has too few samples")
        index = samples[: w * h].reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = np.empty_like(index)
            rows[order] = index
            index = rows
        if index.size and int(index.max()) >= len(palette):
            raise ValueError("a sample beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        shown = index[: max(0, height - top), : max(0, width - left)]
        box = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
        visible = slice(None) if clear is None else shown != clear
        box[..., :3][visible] = palette[shown][visible]
        box[..., 3][visible] = 255
        yield Frame(canvas.copy(), (left, top, shown.shape[1], shown.shape[0]), delay)
        if disposal == 2:
            box[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None


def samples_of(frames: list[Frame]) -> bytes:
    """The payload that `encode_samples` stored: the red samples of the frames' rectangles."""
    return b"".join(f.canvas[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames)


def feature(frames: list[Frame]) -> str:
    """Frames, canvas, duration and summed colour histogram, as bin:count of bins in use."""
    total = np.sum([f.histogram() for f in frames], axis=0)
    height, width = frames[0].canvas.shape[:2]
    bins = ",".join(f"{k}:{int(n)}" for k, n in enumerate(total) if n)
    return f"{len(frames)}x{width}x{height};{sum(f.delay_ms for f in frames)}ms;{bins}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 2 << 20):
        data, offsets = as_bytes(block.column(1))
        media, sizes = [], np.diff(offsets)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = data[a:b].tobytes()
            media.append(encode_samples(raw + b"\0" * (-len(raw) % UNIT or (UNIT if not raw else 0))))
        yield pa.record_batch([block.column(0).combine_chunks(), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as GIF images: doc_id, n_bytes (UTF-8, without padding), media.

    Bytes 0 pad a text to a positive multiple of UNIT. Null text is empty; null and repeated
    doc_id pass through; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return texts.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for raw in batch.column(2):
            media = raw.as_py()
            frames = list(decode_gif(media))
            payload = samples_of(frames)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(frames)))
        if rows:
            columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *names])


def examine_media(stored: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: payload and media digests and a feature string."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_examined, schema)


def frame_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """Timed frames of GIF columns: key, frame, start_ms, delay_ms, width, height, rgba, histogram (64 counts).

    A null or a damaged image gives one row with frame null and what is wrong in `error`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows, at = [], 0
                try:
                    if raw.as_py() is None:
                        raise ValueError("no image")
                    for n, f in enumerate(decode_gif(bytes(raw.as_py()))):
                        rows.append({"key": k.as_py(), "frame": n, "start_ms": at, "delay_ms": f.delay_ms, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "rgba": f.canvas.tobytes(), "histogram": f.histogram(), "error": None})
                        at += f.delay_ms
                except ValueError as error:
                    rows.append({"key": k.as_py(), "frame": None, "start_ms": None, "delay_ms": None, "width": None, "height": None, "rgba": None, "histogram": None, "error": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("key", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    chosen = media.select(F.col(key).cast("long").alias("key"), F.col(column).cast("binary").alias("media"))
    return chosen.mapInArrow(run, "key long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<bigint>, error string")


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as GIF images, read back."""
    return examine_media(store_texts(documents(spark, sf_dir)))
