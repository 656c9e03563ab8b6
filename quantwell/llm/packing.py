"""Best-fit packing of documents into sequences by bulk-synchronous rounds.

A round range-sorts the unplaced documents and the open gaps together, largest first, gaps
before documents of the same size. Each range then sweeps its rows in that order: a document
takes the smallest gap of its range that holds it (its successor). What a range can't place
meets the gaps that earlier ranges, whose gaps are all larger, have left over: prefix sums over
the ranges' counts tell by rank which documents get which gap, as many as surely fit, so no two
ranges claim one. Gaps are updated and the next round begins. Documents larger than every gap open sequences, as many at
a time as any packing of them needs at least, the largest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantwell.llm.bpe import encoder
from quantwell.llm.common import Scratch, blocks, documents, parts_for, slices, text_column

#: Documents and gaps of one range, while there are no more ranges than MOST_RANGES; beyond, ranges grow
#: with the table, so that the driver holds a few numbers for each of a bounded number of ranges.
RANGE_ROWS, MOST_RANGES = 16_000, 1 << 16

GAP, DOCUMENT = 0, 1
#: What a sweep says of a row: placed, left gap that holds all smaller ranges' documents, other gap, left document.
PLACED, OPEN_GAP, LOW_GAP, LEFT = 0, 1, 2, 3

_SWEPT = "what int, part int, rank long, id long, bin long, offset long, size long, used long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit within one range. Rows (kind, id, size, used) come sorted."""
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    free: dict[int, list[tuple[int, int]]] = {}  # size of a gap to its (bin, used)
    mask, left, low = 0, 0, None  # mask: bit s is set if a gap of size s is free
    for batch in batches:
        for kind, item, size, used in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            low = size
            if kind == GAP:
                free.setdefault(size, []).append((item, used))
                mask |= 1 << size
                continue
            fitting = mask >> size
            if not fitting:
                rows.append((LEFT, part, left, item, None, None, size, None))
                left += 1
                continue
            gap = size + (fitting & -fitting).bit_length() - 1
            own = free[gap]
            bin_, used = own.pop()
            if not own:
                mask ^= 1 << gap
            rows.append((PLACED, part, None, item, bin_, used, size, None))
            if gap > size:
                free.setdefault(gap - size, []).append((bin_, used + size))
                mask |= 1 << (gap - size)
        if len(rows) >= 50_000:
            yield _batch(rows)
            rows = []
    rank = 0
    for gap in sorted(free):
        for bin_, used in free[gap]:
            whole = gap >= low
            rows.append((OPEN_GAP if whole else LOW_GAP, part, rank if whole else None, bin_, None, None, gap, used))
            rank += whole
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _claims(counts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Which left documents get which left gaps.

    From (part, documents, their largest size, gaps, their smallest size) in order to (document
    part, first rank, documents, gap part, first rank, gaps, documents a gap). The nearest range
    with gaps left serves first, its smallest gaps first; a gap takes as many documents of a
    range as surely fit, as best fit would.
    """
    stack: list[list[int]] = []
    out = []
    for part, docs, largest, gaps, smallest in sorted(counts):
        at = 0
        while at < docs and stack:
            top = stack[-1]
            each = max(1, top[3] // largest)
            n = min(-(-(docs - at) // each), top[2] - top[1])
            taken = min(docs - at, n * each)
            out.append((part, at, taken, top[0], top[1], n, each))
            at, top[1] = at + taken, top[1] + n
            if top[1] == top[2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps, smallest])
    return out


def _claimed(rows: DataFrame, claims: list[tuple[int, int, int, int, int, int, int]]) -> DataFrame:
    """Adds to left documents and open gaps the number of the gap that a claim gives them, null for those without one."""
    start, table = 0, []
    for part, rank, docs, gap_part, gap_rank, gaps, each in claims:
        table += [(LEFT, part, rank, rank + docs, each, start), (OPEN_GAP, gap_part, gap_rank, gap_rank + gaps, 1, start)]
        start += gaps
    side = rows.sparkSession.createDataFrame(table, "c_what int, c_part int, c_from long, c_to long, c_each long, c_start long")  # 4 * MOST_RANGES rows at most: a claim ends a range's documents or its gaps
    on = (F.col("what") == F.col("c_what")) & (F.col("part") == F.col("c_part")) & (F.col("rank") >= F.col("c_from")) & (F.col("rank") < F.col("c_to"))
    number = F.col("c_start") + F.floor((F.col("rank") - F.col("c_from")) / F.col("c_each"))
    return rows.join(F.broadcast(side), on, "left").select("what", "part", "rank", "id", "size", "used", number.cast("long").alias("claim"))


def best_fit(items: DataFrame, capacity: int, scratch: Scratch, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Packs (id, size), 1 <= size <= capacity, ids distinct: returns (id, bin, offset), a row for each item.

    bin is the id of the item at offset 0; the items of a bin follow one another without gaps.
    An empty table gives an empty table. Building the frame runs the rounds.
    """
    spark = items.sparkSession
    docs = items.select(F.lit(DOCUMENT).alias("kind"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("used"))
    gaps = spark.createDataFrame([], docs.schema)
    placed: list[DataFrame] = []
    n_docs, n_gaps = docs.count(), 0
    while n_docs:
        parts = min(parts_for(spark, n_docs + n_gaps, range_rows), MOST_RANGES)
        by = [F.desc("size"), F.asc("kind"), F.asc("id")]
        rows = docs.unionByName(gaps)  # what fits one range needs no shuffle, and then best fit is exact
        ranged = (rows.repartitionByRange(parts, *by) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*by)
        swept = scratch.keep(ranged.mapInArrow(_sweep, _SWEPT))
        placed.append(swept.where(F.col("what") == PLACED).select("id", "bin", "offset"))
        is_left, is_open = F.col("what") == LEFT, F.col("what") == OPEN_GAP
        counts = swept.groupBy("part").agg(F.count_if(is_left).alias("docs"), F.max(F.when(is_left, F.col("size"))).alias("largest"), F.count_if(is_open).alias("gaps"), F.min(F.when(is_open, F.col("size"))).alias("smallest")).collect()
        claims = _claims([(r["part"], r["docs"], r["largest"], r["gaps"], r["smallest"]) for r in counts])
        gap_columns = ["id", "size", "used"]
        dealt = swept.where(is_left | is_open)
        if claims:
            dealt = scratch.keep(_claimed(dealt, claims))
            asks = dealt.where(is_left & F.col("claim").isNotNull()).select("rank", "id", "size", "claim")
            offers = dealt.where(is_open & F.col("claim").isNotNull()).select(F.col("id").alias("bin"), F.col("size").alias("gap"), "used", "claim")
            before = F.sum("size").over(W.partitionBy("claim").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
            met = scratch.keep(asks.withColumn("before", before).join(offers, "claim"))
            placed.append(met.select("id", "bin", (F.col("used") + F.col("before")).alias("offset")))
            filled = met.groupBy(F.col("bin").alias("id")).agg((F.first("gap") - F.sum("size")).alias("size"), (F.first("used") + F.sum("size")).alias("used"))
            dealt = dealt.where(F.col("claim").isNull())
        left = dealt.where(is_left).select("part", "rank", "id", "size")
        open_gaps = dealt.where(is_open).select(*gap_columns)
        if claims:
            open_gaps = open_gaps.unionByName(filled.select(*gap_columns))
        open_gaps = open_gaps.select(*gap_columns).unionByName(swept.where(F.col("what") == LOW_GAP).select(*gap_columns)).where("size > 0")
        standing = open_gaps.agg(F.max("size").alias("largest"), F.count("*").alias("n")).first()
        largest = standing["largest"] or 0
        misfits = left.where(F.col("size") > largest).groupBy("part").agg(F.count("*").alias("n"), F.count_if(2 * F.col("size") > capacity).alias("half"), F.sum("size").alias("size"), F.min("rank").alias("first")).orderBy("part").collect()
        must = max(sum(r["half"] for r in misfits), -(-sum(r["size"] for r in misfits) // capacity)) if misfits else 0
        upto = (-1, 0)  # misfits are the first rows of their ranges, without holes
        for r in misfits:
            if must:
                n = min(must, r["n"])
                must, upto = must - n, (r["part"], r["first"] + n)
        opened = (F.col("size") > largest) & ((F.col("part") < upto[0]) | (F.col("part") == upto[0]) & (F.col("rank") < upto[1]))
        news = left.where(opened)
        placed.append(news.select("id", F.col("id").alias("bin"), F.lit(0).cast("long").alias("offset")))
        docs = left.where(~opened).select(F.lit(DOCUMENT).alias("kind"), "id", "size", F.lit(0).cast("long").alias("used"))
        fresh = news.select("id", (F.lit(capacity) - F.col("size")).alias("size"), F.col("size").alias("used")).where("size > 0")
        rest = docs.agg(F.count("*").alias("n"), F.min("size").alias("least")).first()
        n_docs, n_gaps = rest["n"], standing["n"]
        gaps = open_gaps.unionByName(fresh).where(F.col("size") >= (rest["least"] or 0)).select(F.lit(GAP).alias("kind"), *gap_columns)
    out = placed[0] if placed else items.select("id", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset")).limit(0)
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _pieces(path: str, end_id: int, capacity: int, real: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = encoder(path), TaskContext.get().partitionId() << 36
        for block in blocks(batches):
            ids, at = tokens.encode(block.column(1))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            cuts = -(-sizes // capacity)
            piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(np.repeat(sizes, cuts) - start, capacity)
            first = np.repeat(at[:-1], cuts) + start
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            columns = {
                "id": pa.array(number + np.arange(len(piece))),
                "doc_id": block.column(0).combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), cuts))),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            number += len(piece)
            if real:
                columns["ids"] = slices(ids, np.append(first, len(ids)))
            yield pa.record_batch(list(columns.values()), list(columns))

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int, scratch: Scratch, *, real: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Tokenizes (doc_id, text), appends end_id and packs the ids into sequences of at most `capacity`.

    A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if
    real, ids (unsigned 32-bit little-endian). Only documents longer than a sequence are cut.
    Null text is empty and gives the end id alone; null and repeated doc_id pass through, each
    row being a document; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    schema = "id long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * real
    pieces = scratch.keep(texts.mapInArrow(_pieces(path, end_id, capacity, real), schema))
    places = best_fit(pieces.select("id", F.col("length").alias("size")), capacity, scratch, range_rows=range_rows)
    return pieces.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", *["ids"] * real)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1, 4096, Scratch(spark), real=False)
