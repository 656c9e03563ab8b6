"""N-gram Jaccard join: exact links between documents whose shingle sets are alike.

Three exact steps, none of which forms a list of pairs or moves a text that cannot link.

1. A document of a shingles links only with documents that lack at most a - ceil(t a) of them. So
   one with more shingles of its own than that links with nothing but its exact copies. Shingles
   are counted over all distinct sets, in a slice of the hash space that is wide enough to
   show this for nearly every document without near copies; a narrower slice only leaves more
   documents to the next step.
2. The sets that are left order their shingles from rare to frequent, by counts over those
   sets. Two that link share a shingle among the first a - ceil(t a) + 1 of each (the prefix), so a
   line that many documents have brings nothing together unless a document is hardly more than
   that line. Documents that share a prefix shingle are joined into blocks.
3. Each block is searched by T-occurrence: DivideSkip merges the short inverted lists, probes the
   long ones by binary search and keeps the documents that reach the overlap. Blocks beyond
   `search_shingles` are dealt out by pairs of chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import Scratch, as_bytes, binary, blocks, documents, mix64, parts_for, ragged, text_bytes, text_column
from quantwell.llm.graph import components

#: Shingles that one bucket counts; shingles of one search, beyond which a block is dealt out by pairs of chunks.
BUCKET_SHINGLES, SEARCH_SHINGLES = 1_500_000, 400_000
#: Rows of a table of ids up to which it is broadcast (about 100 bytes a row); beyond, the join is a shuffle.
BROADCAST_ROWS = 1 << 18
#: The counted slice of the hash space, as a multiple of the share of shingles that a link may miss.
SLICE = 2.5
_BLOCK = 3 << 20
_DIGEST = 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9FB21C651E98DF25)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all documents, and each one's first word."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] |= solid[heads]
    begins = np.flatnonzero(start)
    stop = np.flatnonzero(solid & np.concatenate([~solid[1:] | start[1:], [True]])) + 1 if len(data) else begins
    size = stop - begins
    longest = int(size.max(initial=0))
    order = np.argsort((longest - size).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")  # 16 bits are sorted by radix
    at = begins[order]
    hashes = np.zeros(len(at), np.uint64)
    live = len(at) - np.searchsorted(size[order][::-1], np.arange(1, longest + 1), "left")
    for k, n in enumerate(live.tolist()):
        h = hashes[:n]
        h ^= _BYTE[data[at[:n] + k]]
        h *= _STEP
        h ^= h >> np.uint64(29)
    out = np.empty_like(hashes)
    out[order] = mix64(hashes)
    return out, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and n + 1 offsets."""
    words, first = word_hashes(data, offsets)
    rolled = mix64(words[: max(0, len(words) - width + 1)] + np.uint64(width))
    for k in range(1, width):
        rolled = mix64(rolled * _STEP + words[k : len(words) - width + 1 + k])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:  # fewer words than a shingle has: their sequence as one
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([h]) * _STEP + w)[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), edges

def least_overlap(size: np.ndarray, p: int, q: int) -> np.ndarray:
    """The least number of shingles that a set of `size` shares with any set that it links with."""
    return -(-size * p // q)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = 8 * len(kinds)
    ends = n + np.cumsum(np.frombuffer(raw, "<i8", len(kinds)))
    return [np.frombuffer(raw[a:b], kind) for a, b, kind in zip([n, *ends[:-1].tolist()], ends.tolist(), kinds, strict=True)]


def _digests(hashes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """128-bit digests that stand for whole sets."""
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=_DIGEST).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _packed(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), binary([r[1] for r in rows])], ["block", "bucket", "packed"])


_PACKED = "block long, bucket int, packed binary"


class _Numbers:
    """Numbers of the blocks of one task; the tables that carry them are written before they are read."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next


# step 1: documents with enough shingles of their own


def _counted(width: int, p: int, q: int, buckets: int):
    """For each document its size and digest; for each block its sets (bucket -1) and the slice of their shingles by bucket."""
    edge = min(1 << 16, int(SLICE * (q - p) / q * (1 << 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        names = ["doc_id", "n_shingles", "digest", "block", "bucket", "packed"]
        for block in blocks(batches, _BLOCK):
            hashes, edges = shingle_sets(*as_bytes(block.column(1)), width)
            key, sizes = block.column(0).to_pylist(), np.diff(edges)
            digest = _digests(hashes, edges)
            own: dict[bytes, int] = {}
            for i, k in enumerate(key):
                if not sizes[i]:
                    digest[i] = b"-%d" % (k or 0)  # an empty set equals none
                elif k is not None:
                    own.setdefault(digest[i], i)
            n, none = len(key), pa.nulls
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(sizes), binary(digest), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.binary())], names)
            if not own:
                continue
            rows = np.fromiter(own.values(), np.int64, len(own))
            size = sizes[rows]
            packed = [(-1, _pack(np.frombuffer(b"".join(own), np.uint8), (size - least_overlap(size, p, q)).astype("<u4")))]
            flat = hashes[ragged(edges[rows], size)]
            slot = np.repeat(np.arange(len(rows)), size)
            held = (flat & np.uint64(0xFFFF)) < np.uint64(edge)
            flat, slot = flat[held], slot[held]
            to = (flat >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            flat, slot, to = flat[order].astype("<u4"), slot[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                first = np.flatnonzero(np.diff(slot[a:b], prepend=-1))
                packed.append((int(to[a]), _pack(slot[a:b][first].astype("<u4"), np.diff(np.append(first, b - a)).astype("<u4"), flat[a:b])))
            k = len(packed)
            table = _packed(numbers(), packed)
            yield pa.record_batch([none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), *table.columns], names)

    return run


def _alone(group: pa.Table) -> pa.Table:
    """In a bucket: for each block, how many shingles of each of its sets no other set has."""
    asked = [_unpack(blob, "<u4", "<u4", "<u4") for blob in group.column("packed").to_pylist()]
    values = np.concatenate([a[2] for a in asked])
    order = np.argsort(values, kind="stable")
    inner = values[order][1:] != values[order][:-1]
    single = np.zeros(len(values), np.int64)
    single[order] = np.append(True, inner) & np.append(inner, True)
    out, at = [], 0
    for slots, counts, _ in asked:
        total = int(counts.sum())
        starts = np.cumsum(counts.astype(np.int64)) - counts
        out.append(_pack(slots, np.add.reduceat(single[at : at + total], starts).astype("<u4")))
        at += total
    return pa.table([group.column("block"), group.column("bucket"), binary(out)], names=["block", "bucket", "packed"]).cast(_PACKED_SCHEMA)


_PACKED_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())])


def _left(group: pa.Table) -> pa.Table:
    """In a block: the digests of the sets that may link with another set."""
    blobs = dict(zip(group.column("bucket").to_pylist(), group.column("packed").to_pylist(), strict=True))
    digests, budget = _unpack(blobs.pop(-1), "u1", "<u4")
    single = np.zeros(len(budget), np.int64)
    for blob in blobs.values():
        slots, counts = _unpack(blob, "<u4", "<u4")
        single[slots] += counts
    raw = digests.tobytes()
    return pa.table([binary([raw[_DIGEST * i : _DIGEST * (i + 1)] for i in np.flatnonzero(single <= budget).tolist()])], names=["digest"])


# step 2: prefixes by rarity


def _sets(width: int):
    """Blocks of the sets that are left: nodes, numbers of copies, digests, sizes, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for block in blocks(batches, _BLOCK, 3):
            hashes, edges = shingle_sets(*as_bytes(block.column(3)), width)
            want = block.column(1).to_pylist()
            rows = np.array([i for i, d in enumerate(_digests(hashes, edges)) if d == want[i]], np.int64)
            if len(rows):
                size = np.diff(edges)[rows]
                node, copies = (block.column(k).to_numpy()[rows].astype("<i8") for k in (0, 2))
                blob = _pack(node, copies, np.frombuffer(b"".join(want[i] for i in rows), np.uint8), size.astype("<u4"), hashes[ragged(edges[rows], size)].astype("<u8"))
                yield _packed(numbers(), [(-1, blob)])

    return run


_SETS = ("<i8", "<i8", "u1", "<u4", "<u8")


def _dealt(flat: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of a block in order of (bucket, shingle), their counts, their buckets and where each bucket starts."""
    tokens, counts = np.unique(flat, return_counts=True)
    to = (tokens >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(to, kind="stable")
    return tokens[order], counts[order], to[order], np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))


def _asked(buckets: int):
    """The distinct shingles of each block and their counts there, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens, counts, to, cuts = _dealt(_unpack(blob, *_SETS)[4], buckets)
                yield _packed(number, [(int(to[a]), _pack(tokens[a:b].astype("<u4"), counts[a:b].astype("<u4"))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])

    return run


def _levels(group: pa.Table) -> pa.Table:
    """In a bucket: in how many sets each shingle that a block asks for is, up to 255."""
    asked = [_unpack(blob, "<u4", "<u4") for blob in group.column("packed").to_pylist()]
    _, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([a[1] for a in asked]))
    level = np.minimum(total, 255).astype(np.uint8)[place]
    ends = np.cumsum([len(a[0]) for a in asked]).tolist()
    out = [_pack(level[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return pa.table([group.column("block"), group.column("bucket"), binary(out)], names=["block", "bucket", "packed"]).cast(_PACKED_SCHEMA)


def _prefixes(p: int, q: int, buckets: int):
    """In a block: the shingles of prefixes that other sets have too, with their documents, by bucket."""

    def run(group: pa.Table) -> pa.Table:
        blobs = dict(zip(group.column("bucket").to_pylist(), group.column("packed").to_pylist(), strict=True))
        node, _, _, size, flat = _unpack(blobs.pop(-1), *_SETS)
        tokens, _, _, _ = _dealt(flat, buckets)
        level = np.concatenate([_unpack(blobs[b], "u1")[0] for b in sorted(blobs)])
        rank = np.argsort(tokens)
        level = level[rank][np.searchsorted(tokens[rank], flat)]
        size = size.astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, level, owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        use = order[(place <= np.repeat(size - least_overlap(size, p, q), size)) & (level[order] > 1)]
        to = (flat[use] >> np.uint64(32)).astype(np.int64) % buckets
        by = np.argsort(to, kind="stable")
        use, to = use[by], to[by]
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
        number = group.column("block")[0].as_py()
        rows = [(int(to[a]), _pack(flat[use[a:b]], node[owner[use[a:b]]])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.Table.from_batches([_packed(number, rows)])

    return run


def _meetings(group: pa.Table) -> pa.Table:
    """In a bucket: a link from each document to the smallest one that shares a prefix shingle with it."""
    token, node = (np.concatenate(x) for x in zip(*(_unpack(blob, "<u8", "<i8") for blob in group.column("packed").to_pylist()), strict=True))
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    least = np.repeat(node[starts], np.diff(np.append(starts, len(token))))
    pairs = np.stack([node, least], axis=1)[node != least]
    u, v = np.unique(pairs, axis=0).T if len(pairs) else (node[:0], least[:0])
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


# step 3: T-occurrence searches


class Index:
    """Inverted lists over the sets of one search; lists are in the order of the sets."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.owners = owner[order]
        sorted_ = flat[order]
        self.starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        self.tokens = sorted_[self.starts]
        self.counts = np.diff(np.append(self.starts, len(flat)))

    def at_least(self, query: np.ndarray, t: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets low .. high - 1 on t lists of the query or more, and on how many. DivideSkip.

        Short lists are merged: counted in a window if they fill it, else by sorting their
        runs; the work follows the lists, not the number of sets. Long lists are probed.
        """
        lists = np.searchsorted(self.tokens, query)
        by = lists[np.argsort(self.counts[lists], kind="stable")]
        n_long = min(t - 1, int(t / (math.log2(int(self.counts[by[-1]]) + 1) + 1)), int((self.counts[by] > 1).sum()))
        short, long = by[: len(by) - n_long], by[len(by) - n_long :]
        merged = self.owners[ragged(self.starts[short], self.counts[short])]
        merged = merged[(merged >= low) & (merged < high)] - low
        if len(merged) >= high - low:
            hits = np.bincount(merged, minlength=high - low)
            found = np.flatnonzero(hits >= max(1, t - n_long))
            hits = hits[found]
        else:
            found, hits = np.unique(merged, return_counts=True)
            enough = hits >= max(1, t - n_long)
            found, hits = found[enough], hits[enough]
        found = found + low
        for left, k in zip(range(n_long, 0, -1), long[::-1].tolist(), strict=True):
            if not len(found):
                break
            may = hits + left >= t
            found, hits = found[may], hits[may]
            own = self.owners[self.starts[k] : self.starts[k] + self.counts[k]]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            hits = hits + (own[at] == found)
        done = hits >= t
        return found[done], hits[done]


def search(nodes: list[int], sets: list[np.ndarray], copies: list[int], chunks: list[int] | None, p: int, q: int) -> tuple[list[int], list[int]]:
    """For each set of one block the smallest node linked with it, and with how many documents it links.

    Sets are distinct. With `chunks`, only sets of different chunks are held against each other.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    weight = np.array([copies[i] for i in order], np.int64)
    chunk = None if chunks is None else np.array([chunks[i] for i in order], np.int64)
    index, root, links = Index([sets[i] for i in order]), np.arange(len(order)), np.zeros(len(order), np.int64)
    least = least_overlap(size, p, q)
    lows = np.searchsorted(size, least)
    for x in range(1, len(order)):
        if lows[x] >= x:
            continue
        found, overlap = index.at_least(sets[order[x]], int(least[x]), int(lows[x]), x)
        linked = found[q * overlap >= p * (size[x] + size[found] - overlap)]
        if chunk is not None:
            linked = linked[chunk[linked] != chunk[x]]
        if len(linked):
            links[x] += weight[linked].sum()
            links[linked] += weight[x]
            joined = np.unique(root[np.append(linked, x)])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    smallest = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, np.array([nodes[i] for i in order], np.int64))
    roots, n_links = [0] * len(order), [0] * len(order)
    for k, i in enumerate(order):
        roots[i], n_links[i] = int(smallest[root[k]]), int(links[k])
    return roots, n_links


def _single_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of blocks, each as a row."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            node, copies, digests, size, flat = _unpack(blob, *_SETS)
            raw, sets = digests.tobytes(), flat.tobytes()
            ends = (8 * np.cumsum(size, dtype=np.int64)).tolist()
            columns = [pa.array(node), binary([raw[_DIGEST * i : _DIGEST * (i + 1)] for i in range(len(node))]), pa.array(copies), pa.array(size.astype(np.int64)), binary([sets[a:b] for a, b in zip([0, *ends], ends, strict=False)])]
            yield pa.record_batch(columns, ["node", "digest", "copies", "n", "set"])


def _searched(p: int, q: int):
    """Searches blocks, whose rows come together: root, i, j, chunk, node, digest, copies, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def found() -> pa.RecordBatch:
            chunks, nodes, copies, sets = zip(*held.values(), strict=True)
            roots, links = search(list(nodes), list(sets), list(copies), list(chunks) if at[1] != at[2] else None, p, q)
            rows = [(d, n, r, k) for d, n, r, k in zip(held, nodes, roots, links, strict=True) if k]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["digest", "node", "root", "links"])

        for batch in batches:
            for root, i, j, chunk, node, digest, copies, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != at:
                    if len(held) > 1:
                        yield found()
                    at, held = (root, i, j), {}
                held[digest] = (chunk, node, copies, np.frombuffer(raw, "<u8"))
        if len(held) > 1:
            yield found()

    return run


def jaccard_components(docs: DataFrame, scratch: Scratch, *, width: int = 5, p: int = 80, q: int = 100, search_shingles: int = SEARCH_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of (doc_id, text).

    Documents link if q * intersection >= p * union of their sets of distinct `width`-word
    shingles; component_id is the smallest doc_id that links reach, n_links the number of other
    rows that the row links with, exact copies included. Documents without words link with none. Rows
    with a null doc_id are left alone, with a null component_id; rows of one doc_id count as one
    document that has the links of each. Other columns are ignored. Building the frame runs jobs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    size = text_bytes(docs)
    buckets = parts_for(spark, size / 6 * min(1.0, SLICE * (q - p) / q), BUCKET_SHINGLES)
    met = scratch.keep(texts.mapInArrow(_counted(width, p, q, buckets), f"doc_id long, n_shingles long, digest binary, {_PACKED}"))
    rows = met.where("block is null").select("doc_id", "n_shingles", "digest")
    asked = met.where("block is not null").select("block", "bucket", "packed")
    answers = asked.where("bucket >= 0").groupBy("bucket").applyInArrow(_alone, _PACKED)
    left = asked.where("bucket < 0").unionByName(answers).groupBy("block").applyInArrow(_left, "digest binary").distinct()
    whole = rows.where(f"doc_id is not null and length(digest) = {_DIGEST}")
    groups = whole.groupBy("digest").agg(F.min("doc_id").alias("twin"), F.count("*").alias("copies"))
    groups = scratch.keep(groups.join(left.withColumn("may", F.lit(True)), "digest", "left"))

    may = groups.where("may").select("twin", "digest", "copies")
    few = may.count() <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(may) if few else may, texts["doc_id"] == may["twin"]).select("twin", "digest", "copies", "text")
    sets = scratch.keep(chosen.mapInArrow(_sets(width), _PACKED))
    held = sets.mapInArrow(_asked(buckets), _PACKED).groupBy("bucket").applyInArrow(_levels, _PACKED)
    prefixes = sets.unionByName(held).groupBy("block").applyInArrow(_prefixes(p, q, buckets), _PACKED)
    places = components(prefixes.groupBy("bucket").applyInArrow(_meetings, "u long, v long"), scratch)
    repeated = scratch.keep(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    places = places.unionByName(repeated.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

    single = sets.select("packed").mapInArrow(_single_sets, "node long, digest binary, copies long, n long, set binary")
    placed = scratch.keep(single.join(places, "node"))
    chunks = placed.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(2 * F.sum("n") / search_shingles)).cast("int").alias("k"))
    chunks = scratch.keep(chunks.withColumn("k", F.when(F.col("k") < 3, 1).otherwise(F.col("k"))))
    split = chunks.where("k > 1").limit(1).count() > 0
    tiles = placed.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("k")).cast("int"))
    tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = tiles.select("root", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "node", "digest", "copies", "set")
    dealt = tiles.repartition(parts_for(spark, size, 16 << 20), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    found = scratch.keep(dealt.mapInArrow(_searched(p, q), "digest binary, node long, root long, links long"))

    links = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if split or repeated.limit(1).count():
        again = rows.join(repeated, "doc_id").join(groups, "digest", "left").select(F.col("doc_id").alias("u"), F.coalesce("twin", "doc_id").alias("v"))
        roots = components(links.unionByName(again), scratch)
    else:  # a node is in one search
        roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = roots.groupBy(F.col("node").alias("twin")).agg(F.min("root").alias("root"))
    facts = groups.join(found.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left")
    facts = facts.where("copies > 1 or links is not null").select("digest", "twin", "copies", "links")
    final = rows.join(facts, "digest", "left").withColumn("twin", F.coalesce("twin", "doc_id")).join(roots, "twin", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "twin"))
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).otherwise(0)
    return final.select("doc_id", "n_shingles", component.alias("component_id"), n_links.cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, scratch: Scratch, *, width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of (doc_id, text, ...) without those whose component has a smaller doc_id; all columns as they are.

    Rows of the smallest doc_id of a component stay, all of them if it is repeated; so do rows
    with a null doc_id and documents without words.
    """
    groups = jaccard_components(docs, scratch, width=width, p=p, q=q)
    copies = scratch.keep(groups.where("component_id < doc_id").select(F.col("doc_id").alias("copy")).distinct())
    few = copies.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(copies) if few else copies, docs["doc_id"].cast("long") == copies["copy"], "left_anti")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at a similarity of 0.9."""
    return jaccard_components(documents(spark, sf_dir), Scratch(spark), width=3, p=90, q=100)
