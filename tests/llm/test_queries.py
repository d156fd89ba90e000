"""The registered queries against their SQL, and the pipeline against its stages."""

import pytest

import corpus_pipeline
from seqloom.llm import registry
from tests import oracle_check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    problems, n = oracle_check.differences(spark, oracle_check.connect(SF), SF, name, registry.QUERIES[name], registry.ORACLES[name])
    assert not problems and n


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, SF).cache()
        assert out.columns == columns, name
        assert 0 < out.count() <= 2 * step.count()
        step = out
    ids = sorted(r.doc_id for r in step.select("doc_id").collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == ids
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) > 0 for r in got)
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "round_trip", "token_ids"]


def test_pipeline_of_nothing(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert step.count() == 0
