import numpy as np
import pytest

import corpus_pipeline
from gaugewell.llm.decontaminate import find_overlaps


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append((name, docs))
    return out


def test_each_stage_keeps_rows_of_the_one_before(stages):
    rows = [{tuple(r) for r in df.collect()} for _, df in stages[:-1]]
    for (name, df), before, after in zip(stages[1:-1], rows, rows[1:]):
        assert df.columns == stages[0][1].columns and after <= before, name
    assert len(rows[-1]) > 0.8 * len(rows[0])


def test_what_stays(spark, sf, stages):
    after = dict(stages)
    texts = [r["text"] for r in after["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r["text"] for r in after["toxicity"].collect()}
    assert find_overlaps(after["decontaminate"], spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
    packed = after["pack"].toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in after["decontaminate"].collect()}
    spans = packed.sort_values(["sequence_id", "offset"])
    assert (spans.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert np.array_equal(spans.groupby("sequence_id")["length"].cumsum() - spans["length"], spans["offset"])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_documents(spark, sf, odd, none, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    kept = run(spark, odd, sf)
    assert kept.count() > 0 and (stage == "pack" or kept.columns == odd.columns)
    assert run(spark, none, sf).collect() == []


def test_run(spark, sf, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][1].select(columns).collect()))
