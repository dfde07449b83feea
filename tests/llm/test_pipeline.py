"""The pipeline's stages against what their operators say, on the smallest data."""

import os

import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_stages_take_effect(spark):
    import corpus_pipeline as P
    from cyclora.llm import block_naming, byte_bpe, lsh_forest, mixing, quality_rules
    from cyclora.llm.common import stored

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    at, seen = docs, {}
    for name, stage in P.STAGES:
        at = stored(stage(spark, at, DIR))
        seen[name] = at
        if name != "byte_bpe":
            assert at.columns == docs.columns
    verdict = quality_rules.judge(docs, quality_rules.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")), ["doc_id"])
    assert ids(seen["quality_rules"]) == ids(verdict.where("kept"))
    assert ids(seen["exact_dedup"]) == ids(block_naming.find_copies(seen["quality_rules"]).where("kept"))
    assert ids(seen["near_dedup"]) == ids(lsh_forest.near_copies(seen["exact_dedup"]).where("stays"))
    assert ids(seen["mixing"]) == ids(mixing.mix(seen["near_dedup"], alpha=0.5, seed=20240601))
    assert ids(seen["byte_bpe"]) == ids(seen["mixing"])
    whole = P.run(spark, DIR)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen["byte_bpe"].collect()))
    assert whole.where(F.col("n_tokens") == 0).count() == 0
    assert byte_bpe  # the last stage's operator is tested on its own
