"""Token counts of a unigram tokenizer: count-only Viterbi over Aho-Corasick matches.

The vocabulary and its scores come from counts over all documents (fit_vocabulary) or from a
sentencepiece model file of unigram type. A text is prefixed with a space and every space
becomes the mark U+2581. The best
segmentation has the highest sum of scores; of equal sums the one found first wins, that is, at
each position the longest last piece. A character without a piece costs the lowest score less
10 and counts as its UTF-8 bytes if the vocabulary has byte pieces, as one piece otherwise,
neighbours taken together.

No piece spans from a character to a mark after it, so a text falls into chunks (marks and the
characters up to the next mark) that are segmented apart; each worker remembers the counts of
the chunks it has seen. A vocabulary with a piece across such a border is run over whole texts.

fit_vocabulary counts the distinct chunks of all documents, takes as seeds all characters and the
substrings and whole chunks with the most text, and twice segments all chunks and scores the
pieces by their share, keeping the most frequent after the first time. Scores are multiples of
2**-12, so that sums are exact and a chunk has the same best segmentation as within its text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import Scratch, blocks, documents, text_column

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker remembers; beyond them it starts anew.
REMEMBERED_CHUNKS = 400_000
#: Chunks longer than this are counted anew each time.
LONGEST_REMEMBERED = 64
#: Pieces of a fitted vocabulary besides the characters; seeds to choose them from.
VOCABULARY, SEEDS = 32_000, 100_000
#: Longest substring and longest whole chunk that may become a piece.
SUBSTRING, WHOLE = 4, 16
SCORE_UNIT = 2.0**-12
#: Entries of a partial count before it is passed on, chunks segmented at a time, bands of a doubling in the seeds' order.
_HELD, _AT_ONCE, _BANDS = 500_000, 2048, 16
#: Bytes of distinct chunks whose substrings are counted at a time.
_BLOCK = 2 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_COUNTERS: dict[str, "UnigramCounter"] = {}
_TOOLS: dict = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the normal and user pieces by id order, and whether all byte pieces are there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return pieces, sum(model.is_byte(i) for i in every) == 256


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def chunk_keys(text: str) -> list[str]:
    """The chunks of a marked text, each without its first mark."""
    if MARK in text or "  " in text or text[:1] in ("", " "):
        return [chunk[1:] for chunk in _CHUNK.findall(marked(text))]
    return text.split(" ")


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)
        self.alphabet = {p for p, _ in pieces if len(p) == 1}
        self.seen: dict[str, int] = {}

    def segment_count(self, text: str) -> int:
        """Pieces of the best segmentation of a marked text."""
        n = len(text)
        if not n:
            return 0
        none = float("-inf")
        if self.alphabet.issuperset(text):  # no character is unknown, so each position is reached; the start is at -1
            best, count = [none] * (n + 1), [0] * (n + 1)
            best[n] = 0.0
            for end, (length, score) in self.automaton.iter(text):
                start = end - length
                score += best[start]
                if score > best[end]:
                    best[end], count[end] = score, count[start] + 1
            return count[n - 1]
        best, count, lone = [none] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final

        def settle(upto: int) -> None:
            """Gives positions that no match has reached their unknown character."""
            nonlocal done
            while done < upto:
                done += 1
                s = best[done - 1] + self.unknown
                if not single[done] and s > best[done]:
                    size = len(text[done - 1].encode()) if self.byte_fallback else 1 - lone[done - 1]
                    best[done], count[done], lone[done] = s, count[done - 1] + size, True

        single = [False] * (n + 1)
        for end, (length, score) in self.automaton.iter(text):
            end += 1
            settle(end - 1)
            start = end - length
            if length == 1:
                single[end] = True
            s = best[start] + score
            if s > best[end]:
                best[end], count[end], lone[end] = s, count[start] + 1, False
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not self.apart:
            return self.segment_count(marked(text))
        keys, seen = chunk_keys(text), self.seen
        fresh = set(keys).difference(seen)
        for key in fresh:
            seen[key] = self.segment_count(MARK + key)
        total = sum(map(seen.__getitem__, keys))
        for key in fresh:
            if len(key) >= LONGEST_REMEMBERED:
                del seen[key]
        if len(seen) >= REMEMBERED_CHUNKS:
            seen.clear()
        return total


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(*vocabulary(path))
    return _COUNTERS[path]


def _emptied(counts: Counter) -> pa.RecordBatch:
    out = pa.record_batch([pa.array([MARK + key for key in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["chunk", "n"])
    counts.clear()
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for block in blocks(batches):
        for text in block.column(1).to_pylist():
            counts.update(chunk_keys(text))
        if len(counts) >= _HELD:
            yield _emptied(counts)
    yield _emptied(counts)


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the substrings of up to SUBSTRING characters of distinct chunks, block by block."""
    for block in blocks(batches, _BLOCK, 0):
        chunks, n = block.column(0).to_pylist(), block.column(1).to_numpy()
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        joined = "".join(chunks)
        _, letters = np.unique(np.frombuffer(joined.encode("utf-32-le"), "<u4"), return_inverse=True)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # characters from here to the end of the chunk
        weight = np.repeat(n, size)
        at, key = np.arange(len(joined)), np.zeros(len(joined), np.int64)
        for length in range(1, SUBSTRING + 1):
            use = left[at] >= length
            at, key = at[use], key[use]
            _, first, key = np.unique(key * (letters.max(initial=0) + 1) + letters[at + length - 1], return_index=True, return_inverse=True)
            total = np.bincount(key, weights=weight[at], minlength=len(first)).astype(np.int64)
            yield pa.record_batch([pa.array([joined[a : a + length] for a in at[first].tolist()], pa.string()), pa.array(total)], ["piece", "n"])


def _key(pieces: list[tuple[str, float]]) -> str:
    return hashlib.sha256(repr(pieces).encode()).hexdigest()


def _scores(counts: dict[str, int]) -> list[tuple[str, float]]:
    """Pieces with the logarithms of their shares, the most frequent first."""
    total = sum(counts.values())
    return [(p, round(math.log(n / total) / SCORE_UNIT) * SCORE_UNIT) for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def _seeds(chunks: DataFrame, scratch: Scratch, most: int) -> dict[str, int]:
    """Counts of all characters, and of the substrings with the most text: whole bands of equal weight, `most` at most."""
    short = chunks.mapInArrow(_substrings, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    whole = chunks.where(F.length("chunk").between(SUBSTRING + 1, WHOLE)).select(F.col("chunk").alias("piece"), "n")
    pieces = scratch.keep(short.unionByName(whole))
    size = F.length("piece")
    banded = pieces.withColumn("band", F.floor(F.log2(F.col("n") * size) * _BANDS))
    left, least = most, None
    for row in banded.where(size > 1).groupBy("band").count().orderBy(F.desc("band")).collect():  # as many as the doublings of the largest count
        left -= row["count"]
        if left < 0:
            break
        least = row["band"]
    chosen = banded.where((size == 1) | (F.col("band") >= least) if least is not None else size == 1)
    out = {r["piece"]: r["n"] for r in chosen.select("piece", "n").collect()}
    scratch.drop(pieces)
    return out


def _segmented(pieces: list[tuple[str, float]], key: str):
    """How often the best segmentations of chunks have each piece.

    No piece goes on across a mark and sums of scores are exact, so many chunks are segmented
    as one text, and a piece belongs to the chunk in which it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer, models

        if key not in _TOOLS:
            _TOOLS.clear()
            _TOOLS[key] = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
        width = np.array([1, *(len(p) for p, _ in pieces)], np.int64)
        total = np.zeros(len(pieces) + 1, np.int64)
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(texts), _AT_ONCE):
                some = texts[a : a + _AT_ONCE]
                ids = np.array(_TOOLS[key].encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
                ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
                whose = np.searchsorted(ends, np.cumsum(width[ids]), "left")
                np.add.at(total, ids, n[a : a + _AT_ONCE][whose])
        used = np.flatnonzero(total[1:])
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[1:][used])], ["id", "n"])

    return run


def _used(chunks: DataFrame, pieces: list[tuple[str, float]]) -> dict[str, int]:
    """How often the best segmentations of all chunks have each piece; once for a character that none has."""
    rows = chunks.mapInArrow(_segmented(pieces, _key(pieces)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # no more than pieces
    return {p: 1 for p, _ in pieces if len(p) == 1} | {pieces[r["id"]][0]: r["n"] for r in rows}


def fit_vocabulary(docs: DataFrame, scratch: Scratch, *, size: int = VOCABULARY, seeds: int = SEEDS) -> list[tuple[str, float]]:
    """(piece, score) of a unigram vocabulary of all texts of (doc_id, text): all characters, and `size` other pieces at most."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    chunks = scratch.keep(texts.mapInArrow(_chunked, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")))
    first = _used(chunks, _scores(_seeds(chunks, scratch, seeds)))
    longer = sorted((p for p in first if len(p) > 1), key=lambda p: (-first[p], p))[:size]
    kept = {p: n for p, n in first.items() if len(p) == 1} | {p: first[p] for p in longer}
    out = _scores(_used(chunks, _scores(kept))) if kept else []
    scratch.drop(chunks)
    return out


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and n_chars for each row of (doc_id, text).

    Null text is empty and has no tokens; null and repeated doc_id pass through; other columns
    are ignored.
    """
    return _counted(docs, lambda: counter(path))


def count_pieces(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """As count_tokens, by the pieces of a vocabulary without bytes."""
    key = _key(pieces)

    def own() -> UnigramCounter:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = UnigramCounter(pieces, False)
        return _COUNTERS[key]

    return _counted(docs, own)


def _counted(docs: DataFrame, tool: Callable[[], UnigramCounter]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tool()
        for block in blocks(batches):
            texts = block.column(1).to_pylist()
            yield pa.record_batch([block.column(0).combine_chunks(), pa.array([own.count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_chars long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by a unigram vocabulary fitted over all of them."""
    docs = documents(spark, sf_dir)
    return count_pieces(docs, fit_vocabulary(docs, Scratch(spark)))
