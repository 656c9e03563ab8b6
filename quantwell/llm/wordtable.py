"""BPE encoding over a distinct-word table and decoding through an id-to-piece join.

Documents are cut into blocks. A block's distinct words go, packed by word hash, to buckets;
a bucket holds every occurrence of its words in the whole corpus, encodes each distinct word
once and sends the ids back to the blocks that asked. There they are joined to the words'
positions. A block ships its words once and its positions once; no row stands for a single
occurrence of a word.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.bpe import encoder, joined
from quantwell.llm.bytesplit import plain_documents
from quantwell.llm.common import as_bytes, binary, blocks, documents, parts_for, ragged, slices, text_bytes, text_column

#: Bytes of text of a block and of the text that one bucket of words stands for.
BLOCK, BUCKET = 16 << 20, 24 << 20
#: How the strings of special tokens begin.
SPECIAL = b"<|"
_PIECES: dict[str, pa.Array] = {}


def _pack(*arrays: bytes) -> bytes:
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return len(arrays).to_bytes(2, "little") + zstandard.ZstdCompressor(level=3).compress(head + b"".join(arrays))


def _unpack(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:2], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[2:])
    ends = 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n))
    return [raw[e - s : e] for e, s in zip(ends.tolist(), np.frombuffer(raw, "<i8", n).tolist(), strict=True)]


def _wide(words: list[bytes]) -> tuple[bytes, bytes]:
    return b"".join(words), np.fromiter(map(len, words), "<u4", len(words)).tobytes()


def _words(data: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _split(block: pa.Table, path: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the word of each position, each document's first position, and plain documents.

    Documents that the array splitter doesn't cover are split by the library's own
    pre-tokenizer; only one that may hold a special token is one word, the whole text, marked
    by a leading byte 0xFF, which no UTF-8 text has.
    """
    tokens = encoder(path)
    data, offsets = as_bytes(block.column(1))
    plain = plain_documents(data, offsets) if tokens.known else np.zeros(len(offsets) - 1, bool)
    sizes = np.diff(offsets)
    part = data if plain.all() else data[np.repeat(plain, sizes)]
    if len(part):
        column, firsts = tokens.words(part, np.concatenate([[0], np.cumsum(sizes[plain])]))
        words, codes = column.dictionary.to_pylist(), column.indices.to_numpy()
    else:
        words, codes, firsts = [], np.zeros(0, np.int32), np.zeros(int(plain.sum()) + 1, np.int64)
    if plain.all():
        return words, codes, firsts, plain
    split = tokens.known and tokens.library.pre_tokenizer.pre_tokenize_str
    own = []
    for i in np.flatnonzero(~plain):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        if not tokens.known or SPECIAL in raw:
            own.append([b"\xff" + raw])
        else:
            text = raw.decode()
            own.append([text[a:b].encode() for _, (a, b) in split(text)])
    known = {w: k for k, w in enumerate(words)}
    for w in itertools.chain.from_iterable(own):
        known.setdefault(w, len(known))
    counts = np.fromiter(map(len, own), np.int64, len(own))
    total = np.zeros(len(plain), np.int64)
    total[plain], total[~plain] = np.diff(firsts), counts
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(at[-1]), np.int64)
    out[ragged(at[:-1][plain], total[plain])] = codes
    out[ragged(at[:-1][~plain], counts)] = [known[w] for w in itertools.chain.from_iterable(own)]
    return list(known), out, at, plain


def _bucketed(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Blocks with names that any run over the same rows gives them."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 24
    for k, block in enumerate(blocks(batches, BLOCK)):
        yield base + k, block


def _mark(words: list[bytes]) -> int:
    """A checksum of a block's words, by which two reads of the block are held against each other."""
    return zlib.crc32(b"\xff".join(words))


def _asked(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _named(batches):
            words, *_ = _split(block, path)
            to = _bucketed(words, buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            rows = [(int(to[own[0]]), _pack(*_wide([words[i] for i in own]))) for own in np.split(order, cuts[1:]) if len(own)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([_mark(words)] * len(rows), pa.int64()), binary([r[1] for r in rows])], ["bucket", "block", "mark", "words"])

    return run


def _encoded(path: str):
    def run(group: pa.Table) -> pa.Table:
        tokens = encoder(path)
        ids: dict[bytes, bytes] = {}
        out = []
        for blob in group.column("words"):
            words = _words(*_unpack(blob.as_py()))
            new = [w for w in words if w not in ids]
            short = [w for w in new if w[:1] != b"\xff"]
            ids.update(zip(short, tokens.word_ids(short), strict=True))
            for w in new:
                if w[:1] == b"\xff":
                    ids[w] = np.array(tokens.library.encode(w[1:].decode(), add_special_tokens=False).ids, "<u4").tobytes()
            out.append(_pack(*_wide([ids[w] for w in words])))
        return pa.table([group.column("block"), group.column("bucket"), group.column("mark"), binary(out)], ["block", "bucket", "mark", "ids"])

    return run


def _positions(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _named(batches):
            words, codes, firsts, _ = _split(block, path)
            to = _bucketed(words, buckets)
            place = np.zeros(len(words), np.int64)
            place[np.argsort(to, kind="stable")] = np.arange(len(words))  # words in the order in which the buckets answer
            key = block.column(0).combine_chunks()
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            blob = _pack(key.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls.tobytes(), place[codes].astype("<u4").reshape(-1).tobytes(), firsts.astype("<i8").tobytes(), _mark(words).to_bytes(8, "little"))
            yield pa.record_batch([pa.array([name], pa.int64()), binary([blob])], ["block", "positions"])

    return run


def _pieces(path: str) -> pa.Array:
    """The bytes of each id: the id-to-piece table, as many rows as the vocabulary has."""
    if path in _PIECES:
        return _PIECES[path]
    library = encoder(path).library
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out = []
    for i in range(library.get_vocab_size(with_added_tokens=True)):
        piece = library.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode())
    _PIECES[path] = pa.array(out, pa.large_binary())
    return _PIECES[path]


def _joined(path: str, real: bool):
    def run(key: tuple, asked: pa.Table, answered: pa.Table) -> pa.Table:
        pieces = _pieces(path)
        flat = [b for _, blob in sorted(zip(answered.column("bucket").to_pylist(), answered.column("ids").to_pylist(), strict=True)) for b in _words(*_unpack(blob))]
        ids, edges = joined(flat)
        rows: dict[str, list] = {n: [] for n in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for blob in asked.column("positions").to_pylist():
            keys, nulls, codes, firsts, mark = _unpack(blob)
            if set(answered.column("mark").to_pylist()) - {int.from_bytes(mark, "little")}:
                raise ValueError("a block's words and its answers differ; its input changed between two reads")
            codes = np.frombuffer(codes, "<u4").astype(np.int64)
            firsts = np.frombuffer(firsts, "<i8")
            for keyed, null, a, b in zip(np.frombuffer(keys, "<i8").tolist(), nulls, firsts[:-1], firsts[1:], strict=True):
                own = codes[a:b]
                got = ids[ragged(edges[own], edges[own + 1] - edges[own])]
                found = pieces.take(pa.array(got))
                decoded = b"".join(found.to_pylist()) if len(got) < 8 else as_bytes(found)[0].tobytes()
                decoded = decoded.decode("utf-8", "replace")
                raw = decoded.encode()
                row = (None if null else keyed, len(got), hashlib.sha256(",".join(map(str, got.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), got.astype("<u4").tobytes() if real else None, decoded if real else None)
                for column, value in zip(rows.values(), row, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        table = pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))
        return table if real else table.drop_columns(["ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, *, real: bool = True) -> DataFrame:
    """Encodes and decodes (doc_id, text) with a byte-level tokenizer file.

    Columns: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 and,
    if real, ids (unsigned 32-bit little-endian) and decoded (the text). Null text is empty; null
    and repeated doc_id pass through, a row for each input row; other columns are ignored.
    Decoding replaces what isn't UTF-8, as the library's does.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    buckets = parts_for(docs.sparkSession, text_bytes(docs), BUCKET)
    asked = texts.mapInArrow(_asked(path, buckets), "bucket int, block long, mark long, words binary")
    answered = asked.groupBy("bucket").applyInArrow(_encoded(path), "block long, bucket int, mark long, ids binary")
    positions = texts.mapInArrow(_positions(path, buckets), "block long, positions binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * real
    return positions.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_joined(path, real), schema)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents."""
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), real=False)
