import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mosaiq.llm import chosen_path, decontam, langid, line_chunks, queries
from mosaiq.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, corpus, empty):
    docs = corpus
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == corpus.columns, name
        got = {r["doc_id"] for r in out.collect()}
        assert got <= ids, name
        docs, ids = out, got
        assert stage(spark, empty, SF).count() == 0
    assert {0, 9, 11, 13} <= ids and not {3, 4, 6, 7} & ids and 2 not in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(ids)


def looks_like_a_language(model, text):
    """The rule of the language stage, spelled out anew."""
    x = langid.features(text)
    if x is None:
        return False
    margins = [float(w @ np.append(x, 1)) for w in model.family_weights]
    return len(text) < 100 or max(margins) >= 0.4 or max(float(c @ x) for c in model.centres) >= 0.62


def test_pipeline_over_a_table(spark):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(out) < docs.count()
    model = langid.train(docs)
    stays = F.udf(lambda t: looks_like_a_language(model, t), "boolean")
    step = docs.filter(stays("text"))
    step = line_chunks.dedup(step).filter("lines_removed = 0 or trim(text) <> ''")
    kept = chosen_path.join(step).filter("class_id = doc_id").select("doc_id")
    step = step.join(kept, "doc_id")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher, library = decontam.Matcher(items, decontam.ERROR_RATE), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in step.collect() if not matcher.find(r["text"])}
    assert {k: r["ids"] for k, r in out.items()} == want


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    assert "doc_id" in df.columns and df.count() > 0


def test_language_stage_rejects_gibberish_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(5)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "qxzjkvw", "".join(map(chr, range(0xE01, 0xE2F))), "".join(map(chr, range(0x4E00, 0x5000)))]
    planted = [(10**9 + i, " ".join("".join(r.choices(kinds[i % 4], k=r.randint(2, 10))) for _ in range(r.choice([40, 100, 400])))) for i in range(80)]
    rows = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text")))
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    clean = {x["doc_id"] for x in docs.filter("text is not null and lang is not null").select("doc_id").collect()}
    assert clean <= kept and not kept & {k for k, _ in planted}


def test_stages_keep_the_values_of_columns_with_any_name(spark):
    """Null ids, repeated rows and names that the operators use themselves: what stays keeps its values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    docs = docs.unionByName(docs.limit(10)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    names = ["score", "lang_pred", "lines_removed", "spans_removed", "version", "n", "class_id", "key", "rep", "ids", "item_id", "__spans", "h1", "first"]
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "source"))
    docs = docs.select("*", *(F.concat(F.lit(n), mark).alias(n) for n in names)).drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", *names]
        wrong = [F.col(n) != F.concat(F.lit(n), mark) for n in names]
        assert docs.filter(" or ".join(f"`{n}` is null" for n in names)).count() == 0
        for w in wrong:
            assert docs.filter(w).count() == 0
    assert docs.count() > 50 and docs.filter("doc_id is null").count() > 0
