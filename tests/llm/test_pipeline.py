"""The pipeline's stages, each on its predecessor's output, against plain versions."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii, queries

from .test_decontam import brute as contaminated
from .test_decontam import pairs
from .test_jaccard import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), queries.table(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
    assert all(stages[n].columns == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxicity(spark, sf_dir, stages):
    scored = {r.doc_id: r.predicted for r in queries.op5_toxicity(spark, sf_dir).collect()}
    assert ids(stages["toxicity"]) == sorted(i for i, p in scored.items() if not p)


def test_near_copies(stages):
    wanted = components(pairs(stages["toxicity"], "doc_id"))
    assert ids(stages["ngram_jaccard_join"]) == sorted(i for i, (_, c) in wanted.items() if i == c)


def test_benchmark(spark, sf_dir, stages):
    wanted = contaminated(pairs(stages["ngram_jaccard_join"], "doc_id"), pairs(queries.table(spark, sf_dir, "benchmark"), "item_id"))
    assert ids(stages["benchmark_decontamination"]) == sorted(i for i, x in wanted.items() if not x[4])


def test_personal_data(stages):
    before, after = stages["benchmark_decontamination"], stages["pii_surrogates"]
    assert ids(before) == ids(after)
    wanted = {r.doc_id: r.text for r in pii.pseudonymise(before, "corpus-surrogates").collect()}
    old = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        assert r.text == wanted[r.doc_id]
        assert (r.n_chars == len(r.text)) if r.text != old[r.doc_id].text else r.n_chars == old[r.doc_id].n_chars


def test_packing_and_run(spark, sf_dir, stages):
    packed = stages["best_fit_packing"]
    assert sorted({r.doc_id for r in packed.collect()}) == ids(stages["pii_surrogates"])
    facts = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert corpus_pipeline.run(spark, sf_dir).select(facts).exceptAll(packed.select(facts)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_input(spark, sf_dir, stage):
    docs = queries.table(spark, sf_dir, "documents").where("false")
    assert stage(spark, docs, sf_dir).count() == 0


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a b c d ', 12500)").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(100_000).cast("long").alias("n_chars"))
    out = corpus_pipeline.drop_benchmark(spark, docs, sf_dir)
    assert out.count() == 300
    seen = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in seen) < 8 << 20 and sum(r.n for r in seen) > 30_000_000
