"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Each word is predicted from the two words on either side. Embeddings of the four places add up
to a hidden layer; a two-level softmax gives first the cluster of the masked word, then the
word. A document's score is the sum of the conditional log-probabilities of all its words.

The vocabulary comes from word counts over all documents. Words beyond the most frequent share
classes by hash within the network; such a word has the probability of its class, given its
context, times its own share of the class, P(class | context) P(word | class), so that all
distinct words of all documents have probabilities and these add up to 1. The shares come from a
table of the counts of all words, in buckets by hash, which grows with the input: blocks of
documents send their words to the buckets and get the logarithms back. Training goes through all words in
every round: each task starts from the round's weights and steps through its own documents;
the weights, weighted by the words seen, are then averaged in the cluster. The driver holds one
set of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import Scratch, as_bytes, binary, blocks, documents, parts_for, text_bytes, text_column
from quantwell.llm.jaccard import word_hashes

#: Places of the window, clusters, words of a cluster, hidden units.
PLACES = (-2, -1, 1, 2)
CLUSTERS, MEMBERS, HIDDEN = 32, 32, 24
WORDS = CLUSTERS * MEMBERS
#: Ids from KNOWN on stand for all other words, dealt by hash; WORDS stands for a document's border.
KNOWN = WORDS - MEMBERS
BATCH, RATE = 16384, 0.08
#: Rows of a step that are worked on at a time, in arrays that are used again.
AT_ONCE = 16384
_BLOCK, _COUNT_BUCKET = 3 << 20, 32 << 20
_SLICES, _FAN = 32, 64
#: Rows of the same word that are added by whole arrays; a power of 2.
_RUN = 8


@dataclass
class Weights:
    places: np.ndarray  # (places, WORDS + 1, HIDDEN)
    hidden: np.ndarray  # (HIDDEN,)
    cluster: np.ndarray  # (HIDDEN + 1, CLUSTERS), the last row is the bias
    member: np.ndarray  # (CLUSTERS, HIDDEN + 1, MEMBERS)

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(len(PLACES), WORDS + 1, HIDDEN), (HIDDEN,), (HIDDEN + 1, CLUSTERS), (CLUSTERS, HIDDEN + 1, MEMBERS)]

    @classmethod
    def start(cls, seed: int) -> "Weights":
        random = np.random.default_rng(seed)
        return cls(*(random.normal(0, 0.1, s).astype(np.float32) for s in cls.shapes()))

    @classmethod
    def of(cls, flat: np.ndarray) -> "Weights":
        out, at = [], 0
        for s in cls.shapes():
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s).astype(np.float32))
            at += n
        return cls(*out)

    def all(self) -> list[np.ndarray]:
        return [self.places, self.hidden, self.cluster, self.member]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.all()])


class _Space:
    """Arrays that a worker uses again in every step; fresh ones of this size would cost page faults."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = int(np.prod(shape))
        own = self.held.get((name, kind))
        if own is None or len(own) < size:
            own = self.held[(name, kind)] = np.empty(size, kind)
        return own[:size].reshape(shape)


_SPACE = _Space()


def _softmax(x: np.ndarray, own: np.ndarray, rate: float | None) -> np.ndarray:
    """Log-probability of the row `own` in each column of logits; reductions run along whole rows.

    The logits are used up. With a rate they become the gradient of the negative sum, times the rate.
    """
    at = own * x.shape[1] + np.arange(x.shape[1])
    flat = x.reshape(-1)
    x -= x.max(0)
    out = flat.take(at)
    np.exp(x, out=x)
    total = x.sum(0)
    out -= np.log(total)
    if rate is not None:
        x *= rate / total
        flat[at] -= rate
    return out


def _sums(rows: np.ndarray, ids: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the sums of their rows; the last of `rows` is zero and has no id.

    Rows of an id are brought together and filled up with the zero row to whole runs; whole
    arrays add the rows of all runs, and few sums of runs are left to be added by id.
    """
    n, width = len(ids), rows.shape[1]
    ids = ids.astype(np.uint16)
    by = np.argsort(ids, kind="stable")
    ids = ids.take(by)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sizes = np.diff(np.append(first, n))
    filled = -(-sizes // _RUN)
    starts = np.cumsum(filled) - filled
    index = np.full(_RUN * int(filled.sum()), n)
    index[np.arange(n) + np.repeat(_RUN * starts - first, sizes)] = by
    x = rows.take(index, axis=0, out=runs[: len(index)], mode="clip").reshape(-1, _RUN * width)
    half = _RUN * width
    while half > width:
        half //= 2
        x[:, :half] += x[:, half : 2 * half]
    return ids[first], np.add.reduceat(x[:, :width], starts, axis=0)


def log_probabilities(w: Weights, context: np.ndarray, target: np.ndarray, gradients: list[np.ndarray] | None = None) -> np.ndarray:
    """log P(target | context) of each row; adds the mean gradient of its negative to `gradients`."""
    out = [np.zeros(0, np.float32)]
    for a in range(0, len(target), AT_ONCE):
        out.append(_log_probabilities(w, context[a : a + AT_ONCE], target[a : a + AT_ONCE], gradients, len(target)))
    return np.concatenate(out)


def _log_probabilities(w: Weights, context: np.ndarray, target: np.ndarray, gradients: list[np.ndarray] | None, of: int) -> np.ndarray:
    """The same for some of the `of` rows of a step."""
    order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
    sides, target = [context[:, k].take(order) for k in range(len(PLACES))], target.take(order)
    cluster, member = target // MEMBERS, target % MEMBERS
    n, rate = len(target), None if gradients is None else 1 / of
    space = lambda name, *shape: _SPACE(name, shape, w.hidden.dtype)
    twice = space("twice", *w.places.shape[:2], HIDDEN + 1)  # of the places' rows; a column more for the biases
    np.multiply(w.places, 2, out=twice[:, :, :HIDDEN])
    twice[0, :, :HIDDEN] += 2 * w.hidden
    twice[:, :, HIDDEN] = 0
    h, some = space("h", n, HIDDEN + 1), space("some", n, HIDDEN + 1)
    twice[0].take(sides[0], axis=0, out=h, mode="clip")
    for k in range(1, len(PLACES)):
        h += twice[k].take(sides[k], axis=0, out=some, mode="clip")
    with np.errstate(over="ignore"):  # tanh x = 1 - 2 / (exp 2x + 1), which is faster than tanh
        np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    h[:, HIDDEN] = 1
    logits, inner = space("logits", CLUSTERS, n), space("inner", MEMBERS, n)
    np.matmul(w.cluster.T, h.T, out=logits)
    edges = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()
    parts = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
    for c, own in parts:
        np.matmul(w.member[c].T, h[own].T, out=inner[:, own])
    out = _softmax(logits, cluster, rate)
    out += _softmax(inner, member, rate)
    if gradients is not None:
        gradients[2] += h.T @ logits.T
        d = space("back", n + 1, HIDDEN + 1)
        d[n] = 0
        back = np.matmul(logits.T, w.cluster.T, out=d[:n])
        for c, own in parts:
            gradients[3][c] += h[own].T @ inner[:, own].T
            np.matmul(inner[:, own].T, w.member[c].T, out=some[own])
        back += some
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        back *= h
        runs = space("runs", n + _RUN * w.places.shape[1], HIDDEN + 1)
        for k in range(len(PLACES)):
            ids, sums = _sums(d, sides[k], runs)
            gradients[0][k][ids] += sums[:, :HIDDEN]
        gradients[1] += sums[:, :HIDDEN].sum(0)
    scores = np.empty(n, np.float32)
    scores[order] = out
    return scores


def word_ids(hashes: np.ndarray, vocabulary: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of word hashes: `ids` of the sorted `vocabulary`, and by hash of all others."""
    out = KNOWN + (hashes % np.uint64(MEMBERS)).astype(np.int64)
    if not len(vocabulary):
        return out
    heads = (vocabulary >> np.uint64(48)).astype(np.int64)  # the first word with each head of 16 bits, then the few others
    at = np.searchsorted(heads, np.arange(1 << 16)).take((hashes >> np.uint64(48)).astype(np.int64))
    for k in range(int(np.bincount(heads).max())):
        hit = np.flatnonzero(vocabulary.take(at + k, mode="clip") == hashes)
        out[hit] = ids.take(at[hit] + k, mode="clip")
    return out


def examples(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of all words; documents begin at `first` and don't see one another."""
    reach = max(PLACES)
    sizes = np.diff(first)
    place = np.arange(len(ids)) + reach * (1 + np.repeat(np.arange(len(sizes)), sizes))
    line = np.full(len(ids) + reach * (len(sizes) + 1), WORDS, np.int32)
    line[place] = ids
    return np.stack([line[place + k] for k in PLACES], axis=1), ids


def train(w: Weights, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> tuple[Weights, int]:
    """Adagrad steps through all examples; returns the new weights and the number of examples."""
    w = Weights(*(x.copy() for x in w.all()))
    squares = [np.full(x.shape, 1e-6, np.float32) for x in w.all()]
    seen = 0
    for context, target in batches:
        for a in range(0, len(target), BATCH):
            gradients = [np.zeros(x.shape, np.float32) for x in w.all()]
            log_probabilities(w, context[a : a + BATCH], target[a : a + BATCH], gradients)
            for x, g, s in zip(w.all(), gradients, squares, strict=True):
                s += g * g
                x -= rate * g / np.sqrt(s)
        seen += len(target)
    return w, seen


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, _BLOCK, 1):
            words, n = np.unique(word_hashes(*as_bytes(block.column(1)))[0], return_counts=True)
            to = (words >> np.uint64(40)).astype(np.int64) % buckets
            rows = [(k, words[own].tobytes() + zstandard.compress(n[own].astype("<u4").tobytes(), 1)) for k in np.unique(to) if len(own := np.flatnonzero(to == k))]
            sizes = [int((to == k).sum()) for k, _ in rows]
            yield pa.record_batch([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array(sizes, pa.int64()), binary([r[1] for r in rows])], ["bucket", "n", "packed"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    words, counts = [], []
    for n, blob in zip(group.column("n").to_pylist(), group.column("packed").to_pylist(), strict=True):
        words.append(np.frombuffer(blob, "<u8", n))
        counts.append(np.frombuffer(zstandard.decompress(blob[8 * n :]), "<u4"))
    found, where = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(counts).astype(np.int64))
    return pa.table([group.column("bucket")[:1], binary([found.tobytes()]), binary([total.tobytes()])], ["bucket", "words", "counts"])


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """Hashes in order and counts of all words of all texts (doc_id, text), a row for each bucket."""
    return texts.mapInArrow(_counted(buckets), "bucket int, n long, packed binary").groupBy("bucket").applyInArrow(_summed, "bucket int, words binary, counts binary")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8")


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, counts in _totals(batches):
        best = np.lexsort((words, -counts))[:KNOWN]
        yield pa.record_batch([pa.array(words[best].view(np.int64)), pa.array(counts[best])], ["word", "n"])


def most_frequent(counts: DataFrame) -> list[int]:
    return [r["word"] for r in counts.mapInArrow(_best, "word long, n long").orderBy(F.desc("n"), "word").limit(KNOWN).collect()]


def vocabulary(texts: DataFrame, size: int) -> list[int]:
    """Hashes of the KNOWN most frequent words of all texts (doc_id, text), the most frequent first; ties by hash."""
    return most_frequent(word_counts(texts, parts_for(texts.sparkSession, size, _COUNT_BUCKET)))


def class_totals(counts: DataFrame, known: list[int]) -> np.ndarray:
    """Words of each hash class in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS, np.int64)
        for words, n in _totals(batches):
            np.add.at(total, word_ids(words, *_table(known)), n)
        yield pa.record_batch([pa.array(range(MEMBERS), pa.int32()), pa.array(total[KNOWN:])], ["class", "n"])

    out = np.zeros(MEMBERS, np.int64)
    for r in counts.mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def _examples_of(batches: Iterator[pa.RecordBatch], words: np.ndarray, ids: np.ndarray):
    for block in blocks(batches, _BLOCK, 1):
        hashes, first = word_hashes(*as_bytes(block.column(1)))
        yield block, first, *examples(word_ids(hashes, words, ids), first)


def _table(known: list[int]) -> tuple[np.ndarray, np.ndarray]:
    words = np.array(known, np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], order.astype(np.int64)


def _stepped(known: list[int], flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = _table(known)
        w, seen = train(Weights.of(flat), ((c, t) for *_, c, t in _examples_of(batches, words, ids)))
        parts = np.array_split(w.flat(), _SLICES)
        fan = TaskContext.get().partitionId() % _FAN
        yield pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.array([fan] * _SLICES, pa.int32()), pa.array([seen] * _SLICES, pa.int64()), binary([p.astype("<f4").tobytes() for p in parts])], ["slice", "fan", "n", "weights"])

    return run


def _averaged(group: pa.Table) -> pa.Table:
    n = group.column("n").to_pylist()
    total = sum(n)
    mean = sum(k / total * np.frombuffer(b, "<f4").astype(np.float64) for k, b in zip(n, group.column("weights").to_pylist(), strict=True)) if total else np.frombuffer(group.column("weights")[0].as_py(), "<f4")
    return pa.table([group.column("slice")[:1], group.column("fan")[:1], pa.array([total], pa.int64()), binary([mean.astype("<f4").tobytes()])], ["slice", "fan", "n", "weights"])


def fit(texts: DataFrame, known: list[int], *, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Weights after `rounds` rounds over all of (doc_id, text)."""
    flat, schema = Weights.start(seed).flat(), "slice int, fan int, n long, weights binary"
    for _ in range(rounds):
        steps = texts.mapInArrow(_stepped(known, flat), schema)
        mean = steps.groupBy("slice", "fan").applyInArrow(_averaged, schema).groupBy("slice").applyInArrow(_averaged, schema)
        rows = {r["slice"]: r["weights"] for r in mean.collect()}  # one set of weights
        if rows:
            flat = np.concatenate([np.frombuffer(rows[k], "<f4") for k in sorted(rows)])
    return flat


def _class_scores(batches: Iterator[pa.RecordBatch], known: list[int], flat: np.ndarray):
    """Blocks with their words' hashes and ids, offsets of documents, and sums of log P(id | context) by document."""
    words, ids = _table(known)
    w = Weights.of(flat)
    for block in blocks(batches, _BLOCK, 1):
        hashes, first = word_hashes(*as_bytes(block.column(1)))
        own = word_ids(hashes, words, ids)
        context, target = examples(own, first)
        yield block, hashes, own, first, _by_document(log_probabilities(w, context, target), first)


def _by_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values.astype(np.float64))])
    return sums[first[1:]] - sums[first[:-1]]


def _rows(doc_id: pa.Array, n: np.ndarray, total: np.ndarray) -> list[pa.Array]:
    mean = np.where(n > 0, total / np.maximum(n, 1), 0.0)
    return [doc_id, pa.array(n, pa.int64()), pa.array(np.round(total, 3)), pa.array(np.round(mean, 5))]


_NAMES = ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"]


def _scored(known: list[int], flat: np.ndarray):
    """Scores by words and classes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, first, total in _class_scores(batches, known, flat):
            yield pa.record_batch(_rows(block.column(0).combine_chunks(), np.diff(first), total), _NAMES)

    return run


#: Rows of a block: bucket -1 has its documents (ids; words, words of classes and scores of each; places of the latter words among those sent), others the words sent to a bucket or the logarithms that come back.
_PASSED = "block long, bucket int, data binary, more binary, ids array<long>"


def _passed(known: list[int], flat: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (block, hashes, own, first, total) in enumerate(_class_scores(batches, known, flat)):
            rare = own >= KNOWN
            words, where = np.unique(hashes[rare], return_inverse=True)
            to = (words >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            sent = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            n_rare = np.diff(np.concatenate([[0], np.cumsum(rare)])[first])
            head = np.concatenate([np.diff(first), n_rare]).astype("<i8").tobytes() + total.astype("<f8").tobytes()
            data = [head, *(words[order[edges[b] : edges[b + 1]]].tobytes() for b in sent)]
            more = [zstandard.compress(place[where].astype("<u4").tobytes(), 1)] + [None] * len(sent)
            ids = pa.array([block.column(0).to_pylist()] + [None] * len(sent), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([task + k] * len(data), pa.int64()), pa.array([-1, *sent], pa.int32()), binary(data), binary(more), ids], ["block", "bucket", "data", "more", "ids"])

    return run


def _shares(totals: np.ndarray):
    """log P(word | class) of the words that blocks have sent to a bucket."""

    def run(sent: pa.Table, counts: pa.Table) -> pa.Table:
        words, n = next(_totals(iter(counts.combine_chunks().to_batches())))
        out = []
        for data in sent.column("data").to_pylist():
            own = np.frombuffer(data, "<u8")
            out.append(np.log(n[np.searchsorted(words, own)] / totals[own % np.uint64(MEMBERS)]).astype("<f4").tobytes())
        return pa.table([sent.column("block"), sent.column("bucket"), binary(out)], ["block", "bucket", "data"])

    return run


def _finished(group: pa.Table) -> pa.Table:
    group = group.sort_by("bucket")
    data = group.column("data").to_pylist()
    doc_id = group.column("ids")[0].values
    size = len(doc_id)
    n, n_rare = np.frombuffer(data[0], "<i8", 2 * size).reshape(2, size)
    logs = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(x, "<f4") for x in data[1:])])
    place = np.frombuffer(zstandard.decompress(group.column("more")[0].as_py()), "<u4")
    total = np.frombuffer(data[0], "<f8", size, 16 * size) + _by_document(logs[place], np.concatenate([[0], np.cumsum(n_rare)]))
    return pa.table(_rows(doc_id, n, total), _NAMES)


def score(docs: DataFrame, scratch: Scratch | None = None, *, rounds: int = 2, seed: int = 7) -> DataFrame:
    """Trains on all rows of (doc_id, text) and scores them: doc_id, n_words, log_likelihood, mean_log_likelihood.

    Null or empty texts have no words and score 0; null and repeated doc_id pass through; other
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    buckets = parts_for(docs.sparkSession, text_bytes(docs), _COUNT_BUCKET)
    counts = scratch.keep(word_counts(texts, buckets))
    known = most_frequent(counts)
    flat = fit(texts, known, rounds=rounds, seed=seed)
    passed = scratch.keep(texts.mapInArrow(_passed(known, flat, buckets), _PASSED))
    sent = passed.where("bucket >= 0").select("block", "bucket", "data").groupBy("bucket")
    back = sent.cogroup(counts.groupBy("bucket")).applyInArrow(_shares(class_totals(counts, known)), "block long, bucket int, data binary")
    both = passed.where("bucket < 0").unionByName(back, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(_finished, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents."""
    return score(documents(spark, sf_dir))
