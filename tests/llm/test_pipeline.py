import re

import corpus_pipeline as pipeline
from helpers import SF, empty, near_brute, odd
from pyspark.sql import functions as F

from pagemill.llm.common import Work


def stages(spark, docs, upto):
    work, out = Work(spark, "test"), [docs]
    for name, stage in pipeline.STAGES[:upto]:
        out.append(work.table(stage(spark, out[-1], SF), name))
    return out


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, lang, exact, near, mix, last = stages(spark, docs, 5)
    assert all(d.columns == docs.columns for d in (lang, exact, near, mix))
    assert lang.count() == docs.count()  # all are in a learned language
    first = {}
    for r in lang.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in exact.collect()} == set(first.values())
    brute = near_brute([(r["doc_id"], r["text"]) for r in exact.collect()])
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, _, kept) in brute.items() if kept}
    words = lambda d: d.select(F.sum(F.size(F.split(F.btrim("text"), r"\s+")))).first()[0]
    assert 0.7 * words(near) <= words(mix) <= 0.8 * words(near)
    assert {r["doc_id"] for r in mix.collect()} == {r["doc_id"] for r in last.collect()} and last.where("n_tokens <> size(ids)").count() == 0
    assert pipeline.run(spark, SF).count() == last.count()


def test_odd_rows_pass(spark):
    docs = odd(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    out = stages(spark, docs, 5)
    assert all(d.columns == docs.columns for d in out[:-1])
    kept = {r["doc_id"] for r in out[3].where("key = 'k'").collect()}  # ids are repeated in the other documents
    assert 1 in kept and not kept & {2, 3, 4, 5}
    assert stages(spark, empty(spark), 5)[-1].count() == 0
