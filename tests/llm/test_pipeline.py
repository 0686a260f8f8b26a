"""Stages of the pipeline beside what their operators decide one by one."""

from __future__ import annotations

import corpus_pipeline
from tablescope.llm.decontaminate import find_leaks
from tablescope.llm.exact_dedup import exact_groups
from tablescope.llm.simhash import simhash_groups
from tablescope.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_duplicates", "near_duplicates", "decontamination", "mixing"]


def test_every_stage_keeps_what_its_operator_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = corpus_pipeline.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    now = corpus_pipeline.toxicity(spark, docs, SF)
    assert now.columns == columns and ids(now) == ids(scored.filter("score < 0.3"))
    kept = exact_groups(now).filter("kept")
    now = corpus_pipeline.exact_duplicates(spark, now, SF)
    assert now.columns == columns and ids(now) == ids(kept)
    near = simhash_groups(now).filter("doc_id = component_id")
    now = corpus_pipeline.near_duplicates(spark, now, SF)
    assert now.columns == columns and ids(now) == ids(near)
    dirty = set(ids(find_leaks(now, benchmark)))
    clean = [i for i in ids(now) if i not in dirty]
    now = corpus_pipeline.decontamination(spark, now, SF)
    assert now.columns == columns and ids(now) == clean
    mixed = corpus_pipeline.mixing(spark, now, SF).collect()
    assert sorted(r.doc_id for r in mixed if r.rate > 0) == sorted(r.doc_id for r in mixed)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in mixed)


def test_edge_rows_pass_all_stages(spark, make, edge):
    docs = make(edge)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    none = make(edge).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
