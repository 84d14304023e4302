"""The stages against what each must do to its own input."""

import zlib

import pytest
from helpers import hard_documents

import corpus_pipeline
from siteweave.llm.common import saved
from siteweave.llm.decontaminate import overlaps
from siteweave.llm.mixture import cycle_5_2_1, mix
from siteweave.llm.near_duplicates import near_duplicates
from siteweave.llm.toxicity import predict_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(results):
    assert all(df.columns == results[0].columns for df in results[1:-1])


def test_each_stage_keeps_what_its_operator_says(spark, results):
    docs, clean, single, unseen, mixed, placed = results
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(clean) == ids(predict_toxicity(docs, labels).where("not toxic"))
    assert ids(single) == ids(near_duplicates(clean).where("kept"))
    leaks = {r.doc_id for r in overlaps(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and ids(unseen) == [i for i in ids(single) if i not in leaks]
    copies = {r.doc_id: r.copies for r in mix(unseen, cycle_5_2_1, 1.5).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = placed.collect()
    assert sorted(r.doc_id for r in rows) == ids(mixed)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)


def test_hard_rows_pass_all_stages(spark):
    docs = hard_documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, SF))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert saved(stage(spark, docs.limit(0), SF)).count() == 0
        docs = out
    assert docs.count() > 0


def test_run_is_the_stages_in_turn(spark, results):
    assert corpus_pipeline.run(spark, SF).count() == results[-1].count()
