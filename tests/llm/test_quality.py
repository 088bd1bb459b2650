import math

from pyspark.sql import functions as F

from gaugewell.llm.quality import STATISTICS, Rule, RuleModel, held_out_score, rules_of, score, statistics, train, with_statistics

TREES = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 2 <= 3.0)
      Predict: 0.0
     Else (feature 2 > 3.0)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 4.0)
      Predict: 1.0
     Else (feature 0 > 4.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 1.5)
     Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""


def test_every_path_is_a_rule_once():
    a, c, inf = STATISTICS[0], STATISTICS[2], math.inf
    assert {r.limits for r in rules_of(TREES)} == {((a, -inf, 1.5),), ((a, -inf, 1.5), (c, -inf, 3.0)), ((a, -inf, 1.5), (c, 3.0, inf)), ((a, 1.5, inf),), ((a, 1.5, 4.0),), ((a, 4.0, inf),)}


def test_compiled_column_is_the_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = RuleModel(-0.5, [(1.5, Rule((("word_length", 3.0, 5.0), ("distinct_share", -math.inf, 0.8)))), (-2.0, Rule((("log_words", 4.0, math.inf),)))])
    got = {r["id"]: r["score"] for r in score(docs, model).collect()}
    for r in docs.collect():
        s = dict(zip(STATISTICS, statistics(r["text"])))
        z = -0.5 + sum(w for w, rule in model.rules if all(low < s[name] <= high for name, low, high in rule.limits))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-z))) < 1e-12


def test_statistics_of_a_small_text():
    s = dict(zip(STATISTICS, statistics("AA bb, bb, 12 | x!\nAA\n\nAA")))
    assert s["line_words"] == 8 / 3 and s["repeat_share"] == 2 / 8 and s["top_share"] == 3 / 8 and s["bar_share"] == s["shout_share"] == 1 / 8 and abs(s["line_repeat"] - 1 / 3) < 1e-12
    assert statistics(" \n ") == (0.0,) * len(STATISTICS)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id")
    pdf = held_out_score(known, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(pdf) > 500 and (pdf["predicted"] == pdf["quality"]).mean() > 0.97


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1), (4, None), (9, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    model = train(odd, labels, folds=1000, held_out=999)
    got = score(odd, model)
    assert got.count() == odd.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert len({r["score"] for r in got.join(odd.filter("text is null or trim(text) = ''").select(F.col("doc_id").alias("id")), "id").collect()}) == 1
    assert held_out_score(none, labels).collect() == [] and train(odd, labels.filter("quality = 1")).rules == []
    assert with_statistics(none, "doc_id", "text").collect() == []
