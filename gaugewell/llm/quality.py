"""Quality by a sparse rule ensemble.

Shallow random trees over text statistics are cut into rules: every path from
the root is a conjunction of thresholds.  A logistic model with a lasso penalty
keeps the few rules that matter, and the model is compiled into one Spark
column over the statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import label_hash, map_batches
from gaugewell.llm.labels import labelled_sample

STATISTICS = (
    "log_words", "word_length", "longest_word", "caps_share", "letters_share", "short_share", "distinct_share", "repeat_share", "top_share",
    "pair_share", "bar_share", "shout_share", "symbol_share", "stop_share", "comma_share", "digit_share", "line_words", "line_repeat", "title_share",
)


def statistics(text: str) -> tuple[float, ...]:
    """The STATISTICS of one text; shares are per word (lines: per line), all zero for a text without words."""
    words = text.split()
    n = len(words)
    if n == 0:
        return (0.0,) * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    lengths = list(map(len, words))
    return (
        math.log(n),
        sum(lengths) / n,
        float(max(lengths)),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map((4).__gt__, lengths)) / n,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(text.count, "#$%&*+=<>{}@^~\\")) / n,
        text.count(".") / n,
        text.count(",") / n,
        sum(map(str.isdigit, words)) / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(map(str.istitle, words)) / n,
    )


def with_statistics(df: DataFrame, id_col: str, text_col: str, extra: str | None = None) -> DataFrame:
    """id, the STATISTICS (and one more column)."""
    fields = {"id": df.schema[id_col].dataType.simpleString()} | ({extra: df.schema[extra].dataType.simpleString()} if extra else {})
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([extra] if extra else []))

    def run(batches):
        for batch in batches:
            values = [statistics(t or "") for t in batch.column(1).to_pylist()]
            out = dict(zip(STATISTICS, map(list, zip(*values)) if values else [[] for _ in STATISTICS]))
            yield {"id": batch.column(0), **({extra: batch.column(2)} if extra else {}), **out}

    return map_batches(rows, run, ", ".join([*(f"{c} {k}" for c, k in fields.items()), *(f"{c} double" for c in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """Lower (exclusive) and upper (inclusive) limits of some statistics."""

    limits: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = [c for name, low, high in self.limits for c in ([F.col(name) > low] if low > -math.inf else []) + ([F.col(name) <= high] if high < math.inf else [])]
        both = parts[0]
        for c in parts[1:]:
            both = both & c
        return both

    def __str__(self) -> str:
        return " and ".join(f"{low:.6g} < {name} <= {high:.6g}" for name, low, high in self.limits)


def rules_of(trees: str) -> list[Rule]:
    """Every path from a root in the printed trees, each rule once."""
    found: dict[Rule, None] = {}
    path: list[tuple[str, str, float]] = []
    first = None
    for line in trees.split("\n"):
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if "Tree " in line:
                path, first = [], None
            continue
        first = len(m[1]) if first is None else first
        path = [*path[: len(m[1]) - first], (STATISTICS[int(m[2])], m[3], float(m[4]))]
        limits: dict[str, tuple[float, float]] = {}
        for name, sign, value in path:
            low, high = limits.get(name, (-math.inf, math.inf))
            limits[name] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
        found[Rule(tuple((name, *limits[name]) for name in sorted(limits)))] = None
    return list(found)


@dataclass
class RuleModel:
    """score = σ(bias + Σ weight · rule)."""

    bias: float
    rules: list[tuple[float, Rule]]
    threshold: float = 0.3

    def column(self) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", folds: int = 5, held_out: int = 0, per_class: int = 8000, max_bytes: int = 100_000, trees: int = 30, depth: int = 3, penalty: float = 0.001, threshold: float = 0.3) -> RuleModel:
    """A rule model from at most ``per_class`` labelled texts of each label (of ``max_bytes`` at most) outside the held-out fold.

    The sample is weighted back to the labels' true shares.  Without texts of
    both labels the model is the bias alone, log-odds of the labels smoothed by
    one of each.
    """
    sample, totals = labelled_sample(df, labels, id_col, label_col, text_col, folds, held_out, per_class, max_bytes)
    rows = with_statistics(sample, "id", "text", "y").orderBy("id", *STATISTICS).coalesce(4).persist()
    try:
        taken = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(taken) < 2:
            return RuleModel(math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)), [], threshold)
        weight = F.when(F.col("y") == 1, totals[1] / taken[1]).otherwise(totals[0] / taken[0])
        table = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("y", "x", weight.alias("w"), *STATISTICS)
        forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=7, maxBins=128)
        rules = rules_of(forest.fit(table).toDebugString)
        marks = table.select("y", "w", *[F.when(r.column(), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)])
        marks = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marks).select("y", "w", "x").persist()
        fitted = LogisticRegression(labelCol="y", featuresCol="x", weightCol="w", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(marks)
        marks.unpersist()
        kept = [(float(c), r) for c, r in zip(fitted.coefficients.toArray(), rules) if c]
        return RuleModel(float(fitted.intercept), kept, threshold)
    finally:
        rows.unpersist()


def score(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted.

    Null and empty texts have all statistics zero and the score that the rules
    give them; null ids and repeated rows are scored like others; other columns
    are ignored.
    """
    return with_statistics(df, id_col, text_col).select("id", model.column().alias("score")).withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def held_out_score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted of every document; labels of the held-out fifth are not read."""
    model = train(df, labels, id_col, text_col=text_col)
    return score(df, model, id_col, text_col).select(F.col("id").alias(id_col), (label_hash(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted")
