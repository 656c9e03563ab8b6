"""Token-id files: canonical length-limited Huffman codes in independent blocks.

The table that `write_ids` returns is the file format, a row for each block:

part, block       place of the block; blocks in this order hold ascending doc_id
first_token       ids of the part that stand before the block
block_tokens      ids of the block
doc_ids           int64 document keys, with `null_docs` marking those that are null
doc_tokens        int64 ids of each document, its end id included
payload           the documents' code streams, each padded to whole bytes
doc_bytes         int64 bytes of each stream
checkpoints       uint32 bit offsets into the payload, one for every CHECKPOINT ids of a document

A code book (id, length) stands beside it; codes follow from the lengths alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.bpe import encoder
from quantwell.llm.common import Scratch, as_bytes, binary, blocks, documents, parts_for, slices, text_bytes, text_column

#: Ids between two bit offsets; each segment is a lane of the decoder.
CHECKPOINT = 128
#: Ids of a block, but for a longer document.
BLOCK_IDS = 1 << 20
#: Bytes of text that one part of the file stands for.
PART_BYTES = 48 << 20
#: Bytes of ids that are coded at a time.
_CODED_BYTES = 2 << 20


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 where the count is 0.

    A single symbol gets one bit. Raises ValueError if 2**limit codes are too few.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for this code length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    merged: list[np.ndarray] = []  # for each level, whether an item of the sorted list is a symbol
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        merged.append(by < n)
        both = both[by]
        both = both[: len(both) // 2 * 2]
        packages = both[::2] + both[1::2]
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for symbols in reversed(merged):
        chosen = int(symbols[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size.max())
        step = np.int64(1) << (top - size)
        codes[order] = (np.concatenate([[0], np.cumsum(step)[:-1]]) >> (top - size)).astype(np.uint32)
    return codes


class Coder:
    """Array encoder and table-driven decoder of one code book."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths).astype(np.uint64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = np.int64(1) << (self.width - self.lengths[order])
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.bits = np.ones(1 << self.width, np.int64)
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(order, spans)
        self.bits[:filled] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams of documents, each from a whole byte on: bytes, byte offsets, bit offset of each id."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        doc_bytes = (ends[offsets[1:]] - ends[offsets[:-1]] + 7) >> 3
        byte_at = np.concatenate([[0], np.cumsum(doc_bytes)])
        shift = 8 * byte_at[:-1] - ends[offsets[:-1]]
        at = ends[:-1] + np.repeat(shift, np.diff(offsets))
        words = np.zeros((int(byte_at[-1]) >> 2) + 3, np.uint64)
        if len(ids):
            word, room = at >> 5, 64 - (at & 31) - size
            value = self.codes[ids] << room.astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            group = np.bitwise_or.reduceat(value, first)
            words[word[first]] |= group >> np.uint64(32)
            words[word[first] + 1] |= group & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").view(np.uint8)[: int(byte_at[-1])], byte_at, at

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of segments that begin at bit offsets `starts`; all segments advance together."""
        total = int(counts.sum())
        out = np.zeros(total, np.uint32)
        if not total:
            return out
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        order = np.argsort(-counts, kind="stable")
        place = (np.cumsum(counts) - counts)[order]
        at, left = starts[order].astype(np.int64), counts[order]
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")
        rest, mask = 32 - self.width, (1 << self.width) - 1
        for step, n in enumerate(live.tolist()):
            now = at[:n]
            code = (window[now >> 3].astype(np.int64) >> (rest - (now & 7))) & mask
            out[place[:n] + step] = self.symbol[code]
            at[:n] = now + self.bits[code]
        return out


def limit_for(vocabulary: int, limit: int | None) -> int:
    """The code limit: `limit`, or 16 bits and 2 more than a fixed-length code needs. At most 25."""
    return min(25, limit or max(16, int(vocabulary - 1).bit_length() + 2))


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenised(path: str, end_id: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        kind = _id_type(max(tokens.size, end_id + 1))
        for block in blocks(batches):
            ids, at = tokens.encode(block.column(1))
            ids = np.insert(ids, at[1:], end_id).astype(kind)
            at = at + np.arange(block.num_rows + 1)
            key = block.column(0).combine_chunks()
            known = key.fill_null(-(2**63)).to_numpy()
            part = np.where(key.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(np.array(bounds, np.int64), known, "right"))
            yield pa.record_batch([pa.array(part, pa.int32()), key, slices(ids, at)], ["part", "doc_id", "ids"])

    return run


def _counted(vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for block in blocks(batches, _CODED_BYTES, 0):
            total += np.bincount(as_bytes(block.column(0))[0].view(_id_type(vocabulary)), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return run


def token_counts(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n) over all documents, counted in each task and then summed; a row for each id at most."""
    return tokens.select("ids").mapInArrow(_counted(vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_book(counts: DataFrame, vocabulary: int, limit: int | None = None) -> np.ndarray:
    """Code lengths by id. The driver gets one row for each id of the vocabulary at most."""
    total = np.zeros(vocabulary, np.int64)
    for row in counts.toLocalIterator():
        total[row["id"]] = row["n"]
    return code_lengths(total, limit_for(vocabulary, limit))


def _coded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for block in blocks(batches, _CODED_BYTES, 2):
            data, edges = as_bytes(block.column(2))
            ids = data.view(_id_type(len(lengths)))
            at = edges // ids.itemsize
            stream, byte_at, bit_at = coder.encode(ids, at)
            sizes = np.diff(at)
            marks = -(-sizes // CHECKPOINT)
            firsts = np.concatenate([[0], np.cumsum(marks)])
            index = np.repeat(at[:-1], marks) + CHECKPOINT * (np.arange(firsts[-1]) - np.repeat(firsts[:-1], marks))
            points = (bit_at[index] - 8 * np.repeat(byte_at[:-1], marks)).astype("<u4")
            yield pa.record_batch(
                [block.column(0).combine_chunks(), block.column(1).combine_chunks(), pa.array(sizes, pa.int64()), slices(stream, byte_at), slices(points, firsts)],
                ["part", "doc_id", "n_tokens", "stream", "points"],
            )

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted streams to blocks; several parts may follow one another in a task."""
    names = ["part", "block", "first_token", "block_tokens", "doc_ids", "null_docs", "doc_tokens", "payload", "doc_bytes", "checkpoints"]
    part, number, first, held, size = -1, 0, 0, [], 0

    def block() -> pa.RecordBatch:
        docs = [x[0] for x in held]
        sizes = np.array([x[1] for x in held], "<i8")
        lengths = np.array([len(x[2]) for x in held], "<i8")
        starts = np.cumsum(lengths) - lengths
        points = [np.frombuffer(x[3], "<u4") + np.uint32(8 * s) for x, s in zip(held, starts, strict=True)]
        values = [part, number, first, size, np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), sizes.tobytes(), b"".join(x[2] for x in held), lengths.tobytes(), np.concatenate(points).astype("<u4").tobytes()]
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for p, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held and (p != part or size + row[1] > BLOCK_IDS):
                yield block()
                number, first, held, size = number + 1, first + size, [], 0
            if p != part:
                part, number, first = p, 0, 0
            held.append(row)
            size += row[1]
    if held:
        yield block()


FILE_SCHEMA = "part int, block long, first_token long, block_tokens long, doc_ids binary, null_docs binary, doc_tokens binary, payload binary, doc_bytes binary, checkpoints binary"


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 values that cut `key` into ranges of about equal counts; reads that column alone."""
    if parts < 2:
        return []
    at = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(at or []))


def write_ids(docs: DataFrame, path: str, end_id: int, scratch: Scratch, *, limit: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Encodes (doc_id, text), appends end_id to each document and writes the file.

    docs needs an integral doc_id and a text; other columns are ignored. Null text is empty, a
    null doc_id sorts first, equal ones stay as separate documents in any order. Returns the
    file's table and code lengths by id.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    size = text_bytes(docs)
    vocabulary = max(encoder(path).size, end_id + 1)
    bounds = range_bounds(texts, "doc_id", parts_for(docs.sparkSession, size, PART_BYTES))
    tokens = scratch.keep(texts.mapInArrow(_tokenised(path, end_id, bounds), "part int, doc_id long, ids binary"))
    lengths = code_book(token_counts(tokens, vocabulary), vocabulary, limit)
    coded = tokens.mapInArrow(_coded(lengths), "part int, doc_id long, n_tokens long, stream binary, points binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id")
    file = scratch.keep(ordered.mapInArrow(_filed, FILE_SCHEMA), codec="uncompressed")
    scratch.drop(tokens)
    return file, lengths


def _read(lengths: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes, widths = np.frombuffer(row["doc_tokens"], "<i8"), np.frombuffer(row["doc_bytes"], "<i8")
                points = np.frombuffer(row["checkpoints"], "<u4").astype(np.int64)
                marks = -(-sizes // CHECKPOINT)
                counts = np.full(int(marks.sum()), CHECKPOINT, np.int64)
                last = np.cumsum(marks) - 1
                counts[last] = sizes - CHECKPOINT * (marks - 1)
                data = np.frombuffer(row["payload"], np.uint8)
                if len(data) != widths.sum():
                    raise ValueError("a block's payload is cut short")
                ids = coder.decode(data, points, counts).astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["null_docs"], np.uint8) > 0)
                out = [pa.array(np.full(len(sizes), row["part"]), pa.int32()), keys, pa.array(row["first_token"] + at[:-1], pa.int64()), pa.array(sizes), pa.array(sums, pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, slices(ids, at)], [*names, "ids"]
                yield pa.record_batch(out, names)

    return run


def read_ids(file: DataFrame, lengths: np.ndarray, *, with_ids: bool = True) -> DataFrame:
    """Decodes the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (uint32 bytes)."""
    spark = file.sparkSession
    ends = file.groupBy("part").agg(F.max(F.struct("block", (F.col("first_token") + F.col("block_tokens")).alias("end"))).alias("last"))
    totals = sorted((r["part"], r["last"]["end"]) for r in ends.toLocalIterator())  # a row for each file part
    base, rows = 0, []
    for part, total in totals:
        rows.append((part, base))
        base += total
    bases = spark.createDataFrame(rows, "part int, base long")
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = file.mapInArrow(_read(lengths, with_ids), schema).join(F.broadcast(bases), "part")
    return found.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)



def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to a token file and back."""
    import public_tokenizers

    file, lengths = write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0, Scratch(spark))
    return read_ids(file, lengths, with_ids=False)
