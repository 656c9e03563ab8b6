"""The pipeline on a small table of planted cases, each stage on what the one before it kept."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quantwell.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n=120):
    random.seed(seed)
    syllables = ["ra", "to", "mi", "len", "so", "ka", "ter", "du", "vi", "pon", "gel", "a", "us"]
    return " ".join("".join(random.choice(syllables) for _ in range(random.randint(1, 4))) for _ in range(n))


def planted():
    passage = prose(99, 60)
    clean = [prose(k) for k in range(8)]
    near = clean[0].split(" ")
    near[7] = "changed"
    return {
        **dict(enumerate(clean)), 10: " ".join(near), 11: clean[1], 12: prose(20).upper() + "!", 13: "too short", 14: None, 15: "one and the same line\n" * 30,
        16: prose(21) + " " + passage, 17: passage + " " + prose(22), 18: prose(23) + ' api_key = "Zx81kQpW02Lm" ' + prose(24, 20),
    }


def test_stages_and_run(spark, tmp_path):
    texts = planted()
    rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in texts.items()]
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, scratch, seen = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    assert set(seen["quality_rules"]) == set(texts) - {12, 13, 14, 15}
    assert set(seen["ngram_jaccard"]) == set(seen["quality_rules"]) - {10, 11}
    deduped = seen["suffix_array_dedup"]
    assert set(deduped) == set(seen["ngram_jaccard"])
    assert deduped[16].text == texts[16] and deduped[17].text.strip() == prose(22) and deduped[17].n_chars == len(deduped[17].text)
    assert all(deduped[k].text == texts[k] for k in range(8))
    found = seen["secret_scan"]
    assert found[18].text == texts[18].replace("Zx81kQpW02Lm", "[SECRET]") and found[18].n_chars == len(found[18].text)
    assert all(found[k].text == deduped[k].text for k in found if k != 18)
    tool = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in packed) == sorted(found)
    for r in packed:
        want = [*tool.encode(found[r.doc_id].text, add_special_tokens=False).ids, corpus_pipeline.END_ID]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.length == len(want) and r.offset + r.length <= corpus_pipeline.CAPACITY


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == COLUMNS and docs.count() == 0
