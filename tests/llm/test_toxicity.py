import math

import numpy as np
from pyspark.sql import functions as F

from gaugewell.llm import toxicity
from gaugewell.llm.toxicity import ToxicityModel, drop_toxic, fit, held_out_score, locate, score, train


def test_noisy_or_learns_which_sentences():
    """Two features in toxic bags, one of which is also in clean ones."""
    bags = [(3, [[0, 1]]), (5, [[1]]), (2, []), (4, [[0], [1]]), (1, [[1], [1]]), (9, [])] * 20
    labels = np.array([1, 0, 0, 1, 0, 0] * 20)
    weights, bias = fit(bags, labels, np.ones(len(bags)), 2)
    assert weights[0] + bias > 1 and weights[1] + bias < -2 and bias < -4


def test_score_is_the_noisy_or_of_the_sentences():
    model = ToxicityModel({"bad$": 4.0, "wor": 1.0}, -3.0)
    text = "Fine words. Bad bad bad! Worse\n... 12 34. bad"
    z = [-3 + 1.0, -3 + 4.0, -3 + 1.0, -3 + 4.0]
    z[0] = -3 + 1.0  # "words" begins like "worse"
    wanted = 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
    assert abs(model.score(text) - wanted) < 1e-12
    assert [text[a:b].strip() for a, b, x in model.sentences(text) if x > 0] == ["Bad bad bad!", "bad"]
    assert model.score("") == 0 and abs(model.score("no letters in 1 2 3?") - 1 / (1 + math.exp(3.0))) < 1e-12


def test_a_plain_text_scores_as_if_all_sentences_were_looked_at():
    model = ToxicityModel({"bad$": 4.0}, -5.0)
    text = "One. Two!\n three? 4. five"
    assert abs(model.score(text) + math.expm1(-len(model.sentences(text)) * math.log1p(math.exp(-5)))) < 1e-12


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id")
    pdf = held_out_score(known, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic = pdf["toxic"] == 1
    assert len(pdf) > 700
    assert (pdf["predicted"][toxic] == 1).mean() > 0.88  # some labels are wrong
    assert (pdf["predicted"][~toxic] == 1).mean() < 0.01
    assert pdf["worst"][pdf["predicted"] == 1].min() > 0


def test_held_out_labels_are_not_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1), (3, None), (2, 1), (7, 1)], "doc_id long, toxic int")
    model = train(odd, labels)
    assert score(odd, model).count() == odd.count()
    assert {r["score"] for r in score(odd.filter("text is null or text = ''"), model).collect()} == {0.0}
    assert held_out_score(none, labels).collect() == [] and train(odd, labels.filter("false")).weights == {}
    hard = ToxicityModel({"c$": 50.0}, -9.0)
    left = drop_toxic(odd, hard)
    assert left.columns == odd.columns and left.filter("text = 'a b c d e'").count() == 0 and left.filter("text is null").count() == 2
    assert {r["sentence"] for r in locate(odd, hard).collect()} == {"a b c d e", "a b c d f"}
    assert toxicity.drop_toxic(none, hard).collect() == []
