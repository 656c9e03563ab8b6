"""Token files, word tables, token counts and packing against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from quantwell.llm import huffman, packing, unigram, wordtable
from quantwell.llm.bpe import WordEncoder, encoder
from quantwell.llm.common import Scratch

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["'", "s", "t", "re", "ll", "'s", " ", "  ", "\n", "a", "Z", "É", "é", "ß", "1", "2", ",", ".", "\t", "d", "ve", "\x1c", "<|endoftext|>", "€", "ñ", "\xa0", "×", "İ", "中"]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_encode_as_the_library_does(path):
    random.seed(3)
    texts = ["".join(random.choice(BITS[: 20 + 9 * (k % 2)]) for _ in range(random.randint(0, 40))) for k in range(1500)]
    ids, at = encoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(path, texts)



def test_words_are_encoded_without_being_split_again():
    tool = WordEncoder(BYTE)
    text = "".join(random.Random(6).choice(["a", "Ze", "0", "9!", " ", "  ", "\t\n", "é", "ß", "Привет", "中文", "🙂", "\u00ad", "\x7f", "'s"]) for _ in range(4000))
    words = sorted({text[a:b].encode() for _, (a, b) in tool.library.pre_tokenizer.pre_tokenize_str(text)}) + [b"x" * 3000]
    want = [np.array(tool.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    whole, tool.library = tool.library, None  # the library's own splitter is not called
    assert tool.word_ids(words) == want == tool.word_ids(words)
    tool.library, tool.seen, tool.lengths = whole, {}, np.zeros_like(tool.lengths)  # pieces that don't tell the words' ends
    assert tool.word_ids(words) == want


def kraft(lengths):
    return sum(2.0 ** -int(x) for x in lengths if x)


def test_code_lengths_are_optimal_within_the_limit():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    assert (counts * huffman.code_lengths(counts, 16)).sum() == 7 + 7 + 12 + 20 + 32 + 48 + 64 + 64
    limited = huffman.code_lengths(counts, 3)
    assert limited.tolist() == [3] * 8
    for limit in (4, 5, 16):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and kraft(lengths) == 1
    assert huffman.code_lengths(np.array([0, 7, 0]), 8).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_coder_round_trip():
    random.seed(1)
    ids = np.array(random.choices(range(300), weights=[1 / (k + 1) ** 2 for k in range(300)], k=5000), np.uint32)
    coder = huffman.Coder(huffman.code_lengths(np.bincount(ids, minlength=400), 12))
    offsets = np.array([0, 0, 10, 4000, 5000])
    data, byte_at, bit_at = coder.encode(ids, offsets)
    for a, b, start in zip(offsets[:-1], offsets[1:], byte_at):
        assert coder.decode(data, np.array([8 * start]), np.array([b - a])).tolist() == ids[a:b].tolist()


def test_token_file(spark, odd, none):
    rows, docs = odd
    file, lengths = huffman.write_ids(docs, BYTE, 0, Scratch(spark))
    got = huffman.read_ids(file, lengths).collect()
    want = sorted(((k is not None, k or 0, ids + [0]) for (k, _), ids in zip(rows, library(BYTE, [t for _, t in rows]))), key=lambda x: x[:2])
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda x: x[2])
    assert [f[:2] for f in found] == [w[:2] for w in want]
    start = 0
    for f, w in zip(found, want):
        raw = np.array(w[2], "<u4").tobytes()
        assert f[2:] == (start, len(w[2]), zlib.crc32(raw), raw)
        start += len(w[2])
    file, lengths = huffman.write_ids(none, BYTE, 0, Scratch(spark))
    assert huffman.read_ids(file, lengths).count() == 0


def test_word_table(odd, none):
    rows, docs = odd
    tool = Tokenizer.from_file(BYTE)
    want = sorted((k or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), np.array(ids, "<u4").tobytes(), tool.decode(ids, skip_special_tokens=False)) for (k, _), ids in zip(rows, library(BYTE, [t for _, t in rows])))
    got = wordtable.encode_decode(docs, BYTE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert wordtable.encode_decode(none, BYTE).count() == 0


def test_word_table_in_many_scripts(spark):
    random.seed(8)
    bits = ["the ", "don’t ", "— ", "Привет, ", "мир ", "中文字符", "。", "日本語 ", "αβγ ", "١٢٣ ", "½ ", "\u00a0", "\u2003 ", "e\u0301 ", "😀👩‍👩‍👧 ", "\n\n", "  ", "हिन्दी ", "שלום ", "'s ", "12 ", "<", "| "]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(120)] + ["— <|endoftext|> é", "<| — |>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tool = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in wordtable.encode_decode(docs, BYTE).collect()}
    assert got == {k: (ids, tool.decode(ids, skip_special_tokens=False)) for k, ids in enumerate(library(BYTE, texts))}
    words, codes, at, plain = wordtable._split(pa.table([pa.array([0]), pa.array(["Привет — мир"])], names=["doc_id", "text"]), BYTE)
    assert not plain.any() and words == ["Привет".encode(), " —".encode(), " мир".encode()] and at.tolist() == [0, 3]


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_counts_as_the_library_does(fallback):
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -3.0), ("▁a", -2.5), ("bb", -2.0), ("abb", -3.0), ("é", -2.0)]
    extra = [(f"<0x{i:02X}>", -60.0) for i in range(256)] if fallback else []
    tool = Tokenizer(models.Unigram([("<unk>", -50.0), *extra, *pieces], unk_id=0, byte_fallback=fallback))
    own = unigram.UnigramCounter(pieces, fallback)
    own.unknown = min([s for _, s in extra + pieces] + [-50.0]) - 10
    random.seed(2)
    for _ in range(800):
        text = "".join(random.choice("aabb é中😀") for _ in range(random.randint(0, 25)))
        assert own.count(text) == (len(tool.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0), text


def test_pieces_over_marks_are_counted_whole():
    pieces = [("a", -2.0), ("▁", -2.0), ("a▁a", -1.0)]
    own = unigram.UnigramCounter(pieces, False)
    assert not own.apart
    assert own.count("a a") == 2


def test_count_tokens(odd, none):
    rows, docs = odd
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = unigram.count_tokens(docs, path).collect()
    own = unigram.counter(path)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_chars) for r in got) == sorted((k or 0, own.count(t or ""), len(t or "")) for k, t in rows)
    assert unigram.count_tokens(none, path).count() == 0


def test_op8_counts_by_a_unigram_vocabulary_of_all_documents(spark, odd, none, tmp_path):
    rows, docs = odd
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for _, t in rows]
    pieces = unigram.fit_vocabulary(docs, Scratch(spark))
    scores = dict(pieces)
    assert len(scores) == len(pieces) and set("".join(map(unigram.marked, texts))) <= set(scores) and {"▁über", "▁the", "▁token"} <= set(scores)
    tool = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    want = sorted((k or 0, len(tool.encode(unigram.marked(t), add_special_tokens=False).ids), len(t)) for (k, _), t in zip(rows, texts))
    got = unigram.op8_token_counts(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_chars) for r in got) == want
    assert unigram.fit_vocabulary(none, Scratch(spark)) == [] and unigram.count_pieces(none, []).count() == 0


@pytest.mark.parametrize("range_rows", [7, 50, 10_000])
def test_best_fit(spark, range_rows):
    random.seed(range_rows)
    sizes = [random.choice([3, 17, 17, 17, 40, random.randint(1, 100)]) for _ in range(400)]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    rows = packing.best_fit(items, 100, Scratch(spark), range_rows=range_rows).collect()
    assert sorted(r.id for r in rows) == list(range(400))
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.bin, []).append((r.offset, sizes[r.id], r.id))
    for key, own in bins.items():
        at = 0
        for offset, size, item in sorted(own):
            assert offset == at and (offset or item == key)
            at += size
        assert at <= 100
    gaps: list[int] = []
    for size in sorted(sizes, reverse=True):  # best fit decreasing, one by one
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else 100) - size)
    assert -(-sum(sizes) // 100) <= len(bins) <= 1.02 * len(gaps) + 1, (len(bins), len(gaps))


def test_pack_documents(spark, odd, none):
    rows, docs = odd
    got = packing.pack_documents(docs, WORD, 1, 4096, Scratch(spark)).collect()
    want = []
    for (k, _), ids in zip(rows, library(WORD, [t for _, t in rows])):
        ids = np.array([*ids, 1], "<u4")
        want += [(k or 0, n, 4096 * n, len(p), zlib.crc32(p.tobytes()), p.tobytes()) for n in range(-(-len(ids) // 4096)) for p in [ids[4096 * n : 4096 * n + 4096]]]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    assert packing.pack_documents(none, WORD, 1, 4096, Scratch(spark)).count() == 0
