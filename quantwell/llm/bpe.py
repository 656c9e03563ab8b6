"""Tokenizer words and their ids: splitting by arrays, one library call for each new word."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from quantwell.llm.bytesplit import is_space, lowered, plain_documents, word_starts
from quantwell.llm.common import as_bytes, ragged

#: Words of each of the two generations that a worker remembers. Words in use move to the younger
#: one; when that is full, the older one goes, so memory is bounded.
REMEMBERED_WORDS = 200_000

_ENCODERS: dict[str, "WordEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers have for each byte: itself if it is printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


def encoder(path: str) -> "WordEncoder":
    """The encoder of a tokenizer file, one for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Encodes whole texts as the tokenizers library does, without special tokens added.

    Texts that the array splitter covers are cut into words; the library encodes each word
    that is new to this worker. All other texts go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        normalizer, splitter = str(self.library.normalizer), str(self.library.pre_tokenizer)
        self.lower = "Lowercase" in normalizer
        known = "ByteLevel(" in splitter and ("NFC" in normalizer and "Removed" in splitter if self.lower else normalizer == "None" and "use_regex=True" in splitter and "add_prefix_space=False" in splitter)
        self.known = known and all(t.content.startswith("<|") for t in self.library.get_added_tokens_decoder().values())
        self.model = self._model() if self.known and not self.lower else None
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _model(self):
        """The library's tokenizer without its splitter, for words that are split already and spelt in byte letters."""
        raw = json.loads(self.library.to_str())
        model = type(self.library).from_str(json.dumps(raw | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        pieces = model.get_vocab()
        self.lengths = np.zeros(max(pieces.values()) + 1, np.int64)
        self.lengths[list(pieces.values())] = list(map(len, pieces))
        return model

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the splitter leaves whole, end to end, and offsets."""
        if self.model is not None:
            found = self.model.encode_batch_fast([[w.decode("latin-1").translate(_LETTERS) for w in words]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            at = np.concatenate([[0], np.cumsum(self.lengths[ids])])  # bytes before each id; pieces of a word are its bytes
            edges = np.concatenate([[0], np.searchsorted(at, ends)])
            if at[-1] == ends[-1] and np.array_equal(at[edges[1:]], ends):
                return ids, edges
        found = self.library.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of plain documents as a dictionary column, and each document's first word."""
        if self.lower:
            data = lowered(data)
        starts = word_starts(data, offsets, spaced=not self.lower)
        ends = np.append(starts[1:], len(data))
        if self.lower:
            solid = ~is_space(data[starts])
            keep = np.repeat(solid, ends - starts)
            data, sizes = data[keep], (ends - starts)[solid]
            firsts = np.searchsorted(starts[solid], offsets)
            edges = np.concatenate([[0], np.cumsum(sizes)])
        else:
            firsts = np.searchsorted(starts, offsets)
            edges = np.append(starts, len(data))
        column = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return column.dictionary_encode(), firsts

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit integers."""
        if len(self.seen) + len(words) > REMEMBERED_WORDS:
            self.old, self.seen = self.seen, {}
        seen, old = self.seen, self.old
        out = list(map(seen.get, words))
        absent = [k for k, ids in enumerate(out) if ids is None]
        new = []
        for w in map(words.__getitem__, absent):
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                seen[w] = ids
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            ids, at = self._encoded(some)
            raw, edges = ids.tobytes(), (4 * at).tolist()
            seen.update(zip(some, map(raw.__getitem__, map(slice, edges, edges[1:])), strict=False))
        for k in absent:
            out[k] = seen[words[k]]
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        data, offsets = as_bytes(column)
        plain = plain_documents(data, offsets) if self.known else np.zeros(len(offsets) - 1, bool)
        if plain.all():
            return self._plain(data, offsets)
        sizes = np.diff(offsets)
        part = data[np.repeat(plain, sizes)]
        ids, at = self._plain(part, np.concatenate([[0], np.cumsum(sizes[plain])]))
        pieces, lengths, k = [], np.zeros(len(plain), np.int64), 0
        for i, fast in enumerate(plain):
            if fast:
                piece, k = ids[at[k] : at[k + 1]], k + 1
            else:
                piece = np.array(self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            pieces.append(piece)
            lengths[i] = len(piece)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        column, firsts = self.words(data, offsets)
        flat, edges = joined(self.word_ids(column.dictionary.to_pylist()))
        codes = column.indices.to_numpy()
        counts = np.diff(edges)[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat[ragged(edges[codes], counts)], ends[firsts]

    def counts(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """How often each id occurs in all texts."""
        data, offsets = as_bytes(column)
        plain = plain_documents(data, offsets) if self.known else np.zeros(len(offsets) - 1, bool)
        out = np.zeros(self.size, np.int64)
        sizes = np.diff(offsets)
        part = data if plain.all() else data[np.repeat(plain, sizes)]
        if len(part):
            words, _ = self.words(part, np.concatenate([[0], np.cumsum(sizes[plain])]))
            flat, edges = joined(self.word_ids(words.dictionary.to_pylist()))
            times = np.bincount(words.indices.to_numpy(), minlength=len(edges) - 1)
            out += np.bincount(flat, np.repeat(times, np.diff(edges)), self.size).astype(np.int64)
        for i in np.flatnonzero(~plain):
            ids = self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids
            out += np.bincount(np.array(ids, np.int64), minlength=self.size)
        return out


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words end to end, and offsets."""
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]) // 4
    return np.frombuffer(b"".join(ids), "<u4"), edges
