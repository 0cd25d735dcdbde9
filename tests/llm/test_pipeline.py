import os
import re
import zlib

import corpus_pipeline
import fixtures as fx
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from snippetry.llm import mixing, queries
from snippetry.session import stage


def contaminated(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.lowered(text))
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    by_stage = []
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, folder), "pipeline-test")
        by_stage.append(docs.collect())
        if len(by_stage) < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    known, single, clean, mixed, tokens = by_stage
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    judge = fx.brute_language([(r["text"], r["lang"]) for r in given])
    judged = {r["doc_id"]: judge(r["text"]) for r in given}
    assert {r["doc_id"] for r in known} == {d for d, j in judged.items() if j and j[1] >= corpus_pipeline.MIN_SCORE}
    roots = fx.brute_components([(r["doc_id"], r["text"]) for r in known], 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(set(roots))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.lowered(r["text"]))
        windows |= {tuple(words[i : i + 10]) for i in range(max(len(words) - 9, 1))} if words else set()
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not contaminated(r["text"], windows)}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(clean)).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(d for d, n in copies.items() for _ in range(n))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"], add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tokens) == sorted(want)


def test_run_equals_the_stages_on_the_given_table(spark, folder):
    got = queries.pipeline(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_a_finished_stage_leaves_only_its_output(spark, folder):
    docs = stage(corpus_pipeline.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "kept-output")
    first = list(corpus_pipeline._last[-1].paths)
    assert first and all(os.path.isdir(p.removeprefix("file:")) for p in first)
    after = stage(corpus_pipeline.join_near_copies(spark, docs, folder), "kept-output")
    assert not any(os.path.isdir(p.removeprefix("file:")) for p in first) and after.count() > 0


def test_odd_and_empty_documents_pass_all_stages(spark, folder):
    for docs in (fx.documents(spark), fx.documents(spark).where("false")):
        for name, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, folder), "pipeline-test")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
