import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import packing, quality, toxicity
from termweave.llm.common import BATCH_BYTES, bound_batches

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_kept(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        assert after.join(before, docs.columns, "left_anti").count() == 0
        if name == "toxicity":
            bad = toxicity.score(before, toxicity.train(before, labels)).where("score >= 0.5").select("doc_id")
        elif name == "quality":
            bad = quality.score(before, quality.train(before, labels)).where("score < 0.7").select("doc_id")
        else:
            bad = None
        if bad is not None:
            gone = before.select("doc_id").exceptAll(after.select("doc_id"))
            assert sorted(r.doc_id for r in gone.collect()) == sorted(r.doc_id for r in bad.collect())
        kept.append(after.count())
        before = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {x.split()[0] for x in packing.SCHEMA.split(", ")}
    assert sorted(r.doc_id for r in rows.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in before.collect())
    per = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert per.where("n <> m").count() == 0


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return docs.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_batches_of_each_stage_are_bounded_in_bytes(spark, name, stage):
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("some plain words "), 6_000))  # 102 kB
    docs = spark.range(100).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1)
    spark.conf.unset(LIMIT)
    assert largest_batch(docs) > 4 * BATCH_BYTES
    try:
        stage(spark, docs, SF)
        assert largest_batch(docs) < BATCH_BYTES + 200_000  # the row that fills a batch is in it
    finally:
        spark.conf.unset(LIMIT)


def test_a_lower_limit_of_the_session_stays(spark):
    try:
        spark.conf.set(LIMIT, "64k")
        bound_batches(spark)
        assert spark.conf.get(LIMIT) == "64k"
    finally:
        spark.conf.unset(LIMIT)
