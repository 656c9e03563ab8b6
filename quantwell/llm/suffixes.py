"""Removes text that an earlier document has, by longest-previous-factor arrays over the text that is shared.

Every window of `length` bytes has an anchor, the 16 bytes in it whose hash is smallest, so
equal windows have equal anchors. Anchors that two documents share are found first, in buckets
of hashes; of the rest of the text nothing is moved. Windows of shared anchors then go to
buckets by anchor. A bucket sorts the suffixes that begin at its windows by their first `length`
bytes and takes the longest common prefixes of neighbours, up to `length`. For each suffix the
nearest one before and the nearest one after it in that order that belong to a smaller document
(previous and next smaller value) give its longest previous factor: the larger of the least
common prefixes on the way to either. A window whose factor reaches `length` goes; the first
document keeps its copy. Suffixes are not ordered beyond `length`, nor factors followed beyond
it, as no longer match changes what goes. All windows are judged on the input. Blocks of
documents travel compressed; a bucket gets every run of windows of a block, repeated ones too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import as_bytes, binary, blocks, documents, mix64, parts_for, ragged, text_bytes

ANCHOR = 16
_PLACE_BITS = 30
_BLOCK, _HASH_BUCKET, _WINDOW_BUCKET = 3 << 20, 32 << 20, 8 << 20
#: Windows that a bucket sorts at a time.
SORTED_WINDOWS = 400_000


def _zip(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return len(arrays).to_bytes(1, "little") + zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    sizes = np.frombuffer(raw, "<i8", blob[0])
    ends = 8 * blob[0] + np.cumsum(sizes)
    return [np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, int(e - s)) for k, s, e in zip(kinds, sizes, ends, strict=True)]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR bytes at each place."""
    n = len(data) - ANCHOR + 1
    raw = np.ascontiguousarray(data)
    first = np.ndarray((n,), "<u8", raw, 0, (1,))
    second = np.ndarray((n,), "<u8", raw, 8, (1,))
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) ^ mix64(second))


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, document, first window, windows.

    Windows lie within a document; places count from the start of data.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if len(data) > 1 << _PLACE_BITS:
        raise ValueError(f"a block or a single text has more than 2**{_PLACE_BITS} bytes")
    if n < 1:
        return np.zeros(0, np.uint64), none, none, none
    hashes = _grams(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - ANCHOR + 1, 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    anchor = (best & low).astype(np.int64)
    sizes = np.diff(offsets)
    loose = np.minimum(sizes, length - 1)
    cross = ragged(offsets[1:] - loose, loose)
    anchor[cross[cross < n]] = -1
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(change, n))
    solid = anchor[change] >= 0
    start, count = change[solid], count[solid]
    return hashes[anchor[start]], np.searchsorted(offsets, start, "right") - 1, start, count


def _block_ids(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.Table]]:
    """Blocks with names made of their place and their bytes: a second read that differs gives other names, which is noticed."""
    task = TaskContext.get()
    for k, block in enumerate(blocks(batches, _BLOCK, text)):
        data, offsets = _bytes_of(block, text)
        seal = hashlib.blake2b(offsets.tobytes(), digest_size=8)
        seal.update(zlib.crc32(data).to_bytes(4, "little") + f"{task.partitionId() if task else 0}:{k}".encode())
        yield int.from_bytes(seal.digest(), "little", signed=True), block


def _bytes_of(block: pa.Table, text: int) -> tuple[np.ndarray, np.ndarray]:
    column = block.column(text)
    return as_bytes(column.fill_null("") if column.null_count else column)


def _by_bucket(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[order[a]]), order[a:b]


def _keys(block: pa.Table, key: int) -> tuple[np.ndarray, np.ndarray]:
    column = block.column(key).combine_chunks().cast(pa.int64())
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TO_BUCKET = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("packed", pa.binary())])
_TO_BLOCK = pa.schema([("block", pa.int64()), ("packed", pa.binary())])


def _anchored(names: tuple[int, int], length: int, buckets: int):
    """A block's anchors by bucket: hash, smallest and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _block_ids(batches, names[1]):
            hashes, doc, _, _ = anchor_runs(*_bytes_of(block, names[1]), length)
            keys, null = _keys(block, names[0])
            use = ~null[doc]
            hashes, key = hashes[use], keys[doc[use]]
            order = np.argsort(hashes, kind="stable")
            hashes, key = hashes[order], key[order]
            edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            if not len(edge):
                continue
            least, most, hashes = np.minimum.reduceat(key, edge), np.maximum.reduceat(key, edge), hashes[edge]
            to = (hashes >> np.uint64(33)).astype(np.int64) % buckets
            yield _rows([(k, name, _zip(hashes[i], least[i], most[i] - least[i])) for k, i in _by_bucket(to)], _TO_BUCKET)

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of a bucket's anchors, those of two documents or more, to each block that has them."""
    blobs = [_unzip(b, "<u8", "<i8", "<i8") for b in group.column("packed").to_pylist()]
    sizes = [len(b[0]) for b in blobs]
    hashes, least, more = (np.concatenate(x) for x in zip(*blobs, strict=True))
    order = np.argsort(hashes, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    several = np.minimum.reduceat(least[order], edge) < np.maximum.reduceat((least + more)[order], edge)
    found = np.empty(len(hashes), bool)
    found[order] = np.repeat(several, np.diff(np.append(edge, len(hashes))))
    ends = np.cumsum(sizes)
    rows = [(name, _zip(hashes[e - s : e][own])) for name, s, e in zip(group.column("block").to_pylist(), sizes, ends, strict=True) if (own := found[e - s : e]).any()]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), binary([r[1] for r in rows])], schema=_TO_BLOCK)


def _carried(text: int):
    """Blocks with all their columns, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _block_ids(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_table(block.combine_chunks())
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            yield _rows([(name, blob)], _TO_BLOCK)

    return run


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _windowed(names: tuple[int, int], length: int, buckets: int):
    """A block's runs of windows with shared anchors, by bucket."""

    def run(key: tuple, carried: pa.Table, shared: pa.Table) -> pa.Table:
        rows = []
        if shared.num_rows and not carried.num_rows:
            raise ValueError("two reads of the documents differ")
        if shared.num_rows:
            known = np.unique(np.concatenate([_unzip(b, "<u8")[0] for b in shared.column("packed").to_pylist()]))
            block = _opened(carried.column("packed")[0].as_py())
            data, offsets = _bytes_of(block, names[1])
            hashes, doc, start, count = anchor_runs(data, offsets, length)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            keys, null = _keys(block, names[0])
            use = (known[at] == hashes) & ~null[doc]
            hashes, doc, start, count = hashes[use], doc[use], start[use], count[use]
            for k, i in _by_bucket(mix64(hashes).astype(np.uint64).astype(np.int64) % buckets):
                size = count[i] + length - 1
                rows.append((k, carried.column("block")[0].as_py(), _zip(data[ragged(start[i], size)], count[i].astype("<u4"), keys[doc[i]], doc[i].astype("<u4"), (start[i] - offsets[doc[i]]).astype("<u4"))))
        return pa.Table.from_batches([_rows(rows, _TO_BUCKET)])

    return run


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers that aren't 0."""
    return sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))


def _previous_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the least of `common` on the way back to the nearest smaller value, 0 if there is none.

    common[i] is of the places i - 1 and i. All places jump at once: one whose candidate isn't
    smaller goes on to the candidate's own candidate, as nothing between them is smaller either.
    """
    n = len(value)
    at, least = np.arange(-1, n - 1), common.copy()
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[at[open_] >= 0]
        open_ = open_[value[at[open_]] >= value[open_]]
        via = at[open_]
        least[open_] = np.minimum(least[open_], least[via])
        at[open_] = at[via]
    least[at < 0] = 0
    return least


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of `text` at `starts`, up to `length`, its longest common prefix with a suffix of a smaller owner."""
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), ">u8", padded, 0, (1,))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else [0]
    keys = [words[starts + s].astype(np.uint64) for s in steps]
    if length < 8:
        keys = [keys[0] & ~np.uint64((1 << 8 * (8 - length)) - 1)]
    order = np.lexsort(keys[::-1])
    common = np.full(len(order), length)
    common[0] = 0
    for step, k in zip(steps[::-1], keys[::-1], strict=True):  # the first difference is written last
        ordered = k[order]
        differ = ordered[1:] ^ ordered[:-1]
        at = np.flatnonzero(differ)
        common[at + 1] = step + _common_bytes(differ[at])
    value = owner[order]
    before = _previous_smaller(value, common)
    after = _previous_smaller(value[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier_in_suffix_order(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of `text` at `starts`, whether its longest previous factor reaches `length`."""
    return longest_previous_factors(text, starts, owner, length) >= length


def _judged(length: int):
    """Windows of a bucket to remove, to the blocks they are in: document, first window, windows."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [_unzip(b, "<u1", "<u4", "<i8", "<u4", "<u4") for b in group.column("packed").to_pylist()]
        data, count, key, doc, place = (np.concatenate(x) for x in zip(*blobs, strict=True))
        count = count.astype(np.int64)
        size = count + length - 1
        edges = np.concatenate([[0], np.cumsum(size)])
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        code = runs.indices.to_numpy()
        text, text_edges = as_bytes(runs.dictionary)
        n_runs = len(text_edges) - 1
        first = np.full(n_runs, np.iinfo(np.int64).max)
        np.minimum.at(first, code, key)
        windows = np.diff(text_edges) - (length - 1)
        starts = ragged(text_edges[:-1], windows)
        owner = np.repeat(first, windows)
        earlier = np.zeros(len(starts), bool)
        lots = -(-len(starts) // SORTED_WINDOWS)
        head = mix64(np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), 0, (1,))[starts].astype(np.uint64)) % np.uint64(lots) if lots > 1 and length >= 8 else np.zeros(len(starts), np.uint64)
        for lot in range(lots):
            own = np.flatnonzero(head == lot)
            earlier[own] = earlier_in_suffix_order(text, starts[own], owner[own], length)
        window_edges = np.concatenate([[0], np.cumsum(windows)])
        later = key > first[code]  # the whole run of windows stands in an earlier document
        partly = np.flatnonzero(~later)
        flat = ragged(window_edges[code[partly]], count[partly])
        flag = earlier[flat]
        whose = np.repeat(partly, count[partly])
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(count[partly]) - count[partly], count[partly])
        fresh = flag & np.concatenate([[True], ~flag[:-1] | (whose[1:] != whose[:-1])]) if len(flag) else flag
        at = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        many = np.bincount(number[flag], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        row = np.concatenate([np.flatnonzero(later), whose[at]])
        begin = np.concatenate([place[later].astype(np.int64), place[whose[at]].astype(np.int64) + inner[at]])
        total = np.concatenate([count[later], many])
        source = np.repeat(np.arange(len(blobs)), [len(b[1]) for b in blobs])[row]
        names = group.column("block").to_pylist()
        rows = [(names[b], _zip(doc[row[i]].astype("<u4"), begin[i].astype("<u4"), total[i].astype("<u4"))) for b, i in _by_bucket(source)]
        return pa.Table.from_batches([_rows(rows, _TO_BLOCK)])

    return run


def _removed(names: tuple[int, int], length: int, finish):
    """Marks a block's removed bytes and hands (table, bytes, offsets, removed) to `finish`."""

    def run(key: tuple, carried: pa.Table, judged: pa.Table) -> pa.Table:
        block = _opened(carried.column("packed")[0].as_py())
        data, offsets = _bytes_of(block, names[1])
        depth = np.zeros(len(data) + 1, np.int32)
        for blob in judged.column("packed").to_pylist():
            doc, begin, count = (x.astype(np.int64) for x in _unzip(blob, "<u4", "<u4", "<u4"))
            np.add.at(depth, offsets[doc] + begin, 1)
            np.add.at(depth, offsets[doc] + begin + count + length - 1, -1)
        return finish(block, data, offsets, np.cumsum(depth[:-1]) > 0)

    return run


def _marked(docs: DataFrame, key: str, text: str, length: int, finish, schema: str) -> DataFrame:
    if not ANCHOR <= length:
        raise ValueError(f"length must be at least {ANCHOR}")
    names = (docs.columns.index(key), docs.columns.index(text))
    size = text_bytes(docs, text)
    hash_buckets, window_buckets = parts_for(docs.sparkSession, size, _HASH_BUCKET), parts_for(docs.sparkSession, size, _WINDOW_BUCKET)
    to_bucket, to_block = "bucket int, block long, packed binary", "block long, packed binary"
    shared = docs.mapInArrow(_anchored(names, length, hash_buckets), to_bucket).groupBy("bucket").applyInArrow(_shared, to_block)
    carried = docs.mapInArrow(_carried(names[1]), to_block)
    windows = carried.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_windowed(names, length, window_buckets), to_bucket)
    judged = windows.groupBy("bucket").applyInArrow(_judged(length), to_block)
    return carried.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(_removed(names, length, finish), schema)


def _spans(offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed runs of each document."""
    heads = np.zeros(len(gone), bool)
    heads[offsets[:-1][offsets[:-1] < len(gone)]] = True
    rise = gone.copy()
    rise[1:] &= ~gone[:-1] | heads[1:]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    return sums(gone), sums(rise)


def duplicate_report(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """What is removed from each row of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a
    smaller doc_id. Null text is empty. A row with a null doc_id is neither earlier nor later
    than any; rows of one doc_id aren't earlier than one another. Other columns are ignored.
    """

    def finish(block: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        removed, spans = _spans(offsets, gone)
        rest = data[~gone]
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
        raw = memoryview(rest.tobytes())
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [block.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string())]
        return pa.table(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _marked(chosen, "doc_id", "text", length, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_duplicates(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """The rows and columns of docs with repeated text removed from `text`; n_chars follows where text changes.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
    doc_id. A character whose bytes are removed in part goes whole. Documents of which nothing is
    left stay, empty. Null texts stay null; rows with a null doc_id stay as they are and rows of
    one doc_id aren't earlier than one another.
    """

    def finish(block: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        removed, _ = _spans(offsets, gone)
        texts = block.column("text").to_pylist()
        for i in np.flatnonzero(removed):
            a, b = offsets[i], offsets[i + 1]
            texts[i] = data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
        at = block.schema.get_field_index("text")
        block = block.set_column(at, block.schema.field(at), pa.array(texts, block.schema.field(at).type))
        k = block.schema.get_field_index("n_chars")
        if k >= 0:
            chars = [len(t) if r else c for t, r, c in zip(texts, removed, block.column(k).to_pylist(), strict=True)]
            block = block.set_column(k, block.schema.field(k), pa.array(chars, block.schema.field(k).type))
        return block

    return _marked(docs, "doc_id", "text", length, finish, docs.schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return duplicate_report(documents(spark, sf_dir))
