"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label.  A sentence is
toxic with probability σ(z), z being a bias and the weights of its words; the
document is toxic unless all its sentences are clean (noisy-or):
1 − Π(1 − σ(z)) = 1 − exp(−Σ softplus(z)).  The weights maximise the documents'
likelihood, so they learn which sentences make a document toxic, and the same
weights then locate them.  A word brings itself and its beginnings as features,
which lets inflected forms of a known stem count.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, label_hash, map_batches
from gaugewell.llm.labels import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]*[^\W\d_][^.!?\n]*[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
SHORTEST = 3
MEMO = 1 << 16
PREFIXES = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


class ToxicityModel:
    """Weights of features and the sentence bias; ``threshold`` decides on documents."""

    def __init__(self, weights: dict[str, float], bias: float, threshold: float = 0.3):
        self.weights, self.bias, self.threshold = weights, bias, threshold
        self.memo: dict[str, float] = {}
        starts = sorted({f.rstrip("$")[:SHORTEST] for f in weights})
        # words that may have a weight; a start shorter than SHORTEST is a whole word
        self.known = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, starts)) + r")[^\W\d_]*" if starts else r"(?!)")

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = math.fsum(self.weights.get(f, 0.0) for f in word_features(word))
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, z) of each sentence with words; every distinct word counts once."""
        spans = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
        return [(a, b, self.bias + math.fsum(map(self.word, set(self.known.findall(text[a:b].lower()))))) for a, b in spans]

    def score(self, text: str) -> float:
        """Noisy-or of :meth:`sentences`, in which those without weighted words are only counted."""
        low = text.lower()
        hits = [(m.start(), m[0]) for m in self.known.finditer(low) if self.word(m[0])]
        if not hits:
            return 0.0 - math.expm1(-len(SENTENCE.findall(low)) * _softplus(self.bias))
        starts = [m.start() for m in SENTENCE.finditer(low)]
        words: dict[int, set[str]] = {}
        for at, word in hits:
            words.setdefault(bisect.bisect_right(starts, at), set()).add(word)
        total = math.fsum(_softplus(self.bias + math.fsum(map(self.word, w))) for w in words.values())
        return 0.0 - math.expm1(-total - (len(starts) - len(words)) * _softplus(self.bias))


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit(bags: list[tuple[int, list[list[int]]]], labels: np.ndarray, weights: np.ndarray, features: int, steps: int = 300, penalty: float = 1e-6, flips: float = 0.02) -> tuple[np.ndarray, float]:
    """Feature weights and bias of greatest noisy-or likelihood, by Adam, a share ``flips`` of the labels being wrong.

    A bag is the number of its sentences without features, and the features of
    each other sentence.
    """
    plain = np.array([n for n, _ in bags], float)
    of_bag = np.array([d for d, (_, found) in enumerate(bags) for _ in found], np.int64)
    lengths = [len(x) for _, found in bags for x in found]
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.array([f for _, found in bags for x in found for f in x], np.int64)
    theta = np.zeros(features + 1)
    theta[-1] = -7.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weights / weights.sum()
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[col], len(of_bag))
        clean = np.bincount(of_bag, np.logaddexp(0, z), len(bags)) + plain * np.logaddexp(0, theta[-1])  # −log of the chance that all sentences are clean
        toxic = -np.expm1(-clean)
        seen_toxic = flips + (1 - 2 * flips) * toxic
        bag_slope = np.where(labels == 1, -1 / seen_toxic, 1 / (1 - seen_toxic)) * (1 - 2 * flips) * (1 - toxic) * scale
        slope = bag_slope[of_bag] / (1 + np.exp(-np.clip(z, -500, 500)))
        bias_slope = slope.sum() + (bag_slope * plain).sum() / (1 + np.exp(-theta[-1]))
        grad = np.append(np.bincount(col, slope[row], features) + penalty * theta[:-1], bias_slope)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-1] = min(theta[-1], -4.0)
    return theta[:-1], float(theta[-1])


def _count_features(batches):
    """(feature, toxic, clean): documents of each label that have it, added up over a good many rows."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        names = list(seen[0].keys() | seen[1].keys())
        return {"f": names, "toxic": [seen[1][f] for f in names], "clean": [seen[0][f] for f in names]}

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[y].update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield out()
                seen = (Counter(), Counter())
    yield out()


def choose_features(sample: DataFrame, totals: dict[int, int], features: int, least_gain: float) -> list[str]:
    """Features more common among toxic texts whose log-likelihood ratio is ``least_gain`` at least, the best ``features`` of them."""
    counts = map_batches(sample.select("y", "text"), _count_features, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = (F.col("a") + F.col("b")) / (totals[0] + totals[1])
    part = lambda n, of: F.when(n > 0, n * F.log(n / (share * of))).otherwise(0.0)
    gain = part(F.col("a"), totals[1]) + part(F.col("b"), totals[0])
    best = counts.filter((F.col("a") >= 5) & (F.col("a") * totals[0] > F.col("b") * totals[1])).withColumn("gain", F.round(gain, 9)).filter(F.col("gain") >= least_gain)
    return [r["f"] for r in best.orderBy(F.desc("gain"), "f").limit(features).select("f").collect()]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", folds: int = 4, held_out: int = 2, per_class: int = 3000, max_bytes: int = 100_000, threshold: float = 0.3, features: int = 4096, least_gain: float = 10.0) -> ToxicityModel:
    """A model from at most ``per_class`` labelled texts of each label, each of ``max_bytes`` at most, outside the held-out fold.

    The sample is weighted back to the labels' true shares.  The driver sees
    its sentences as lists of the at most ``features`` chosen features.
    Without texts of both labels the model gives every document the score of
    its bias alone.
    """
    sample, totals = labelled_sample(df, labels, id_col, label_col, text_col, folds, held_out, per_class, max_bytes)
    sample = cut_lineage(sample)
    taken = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 2:
        return ToxicityModel({}, -9.0, threshold)
    names = choose_features(sample, taken, features, least_gain)
    index = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for batch in batches:
            out: dict[str, list] = {"id": [], "y": batch.column(1), "plain": [], "found": []}
            for text in batch.column(2).to_pylist():
                bag = [sorted({index[f] for w in set(WORD.findall(m[0].lower())) for f in word_features(w) if f in index}) for m in SENTENCE.finditer(text)]
                out["found"].append([b for b in bag if b])
                out["plain"].append(sum(not b for b in bag))
            yield out | {"id": batch.column(0).cast("string")}

    table = map_batches(sample.select("id", "y", "text"), encode, "id string, y int, plain long, found array<array<int>>").toArrow()
    rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), table["plain"].to_pylist(), table["found"].to_pylist()))
    y = np.array([r[1] for r in rows], int)
    weights, bias = fit([(r[2], r[3]) for r in rows], y, np.where(y == 1, totals[1] / taken[1], totals[0] / taken[0]), len(names))
    return ToxicityModel({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, bias, threshold)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, and place (worst_start, worst_end, in characters) and chance (worst) of the worst sentence.

    Null and empty texts have no sentence: score 0, no worst.  Null ids and
    repeated rows are scored like others, other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            out: dict[str, list] = {"score": [], "predicted": [], "worst_start": [], "worst_end": [], "worst": []}
            for text in batch.column(1).to_pylist():
                p = model.score(text or "")
                top = max(model.sentences(text), key=lambda s: (s[2], -s[0])) if p >= model.threshold else (None, None, None)
                for c, v in zip(out, (p, int(p >= model.threshold), top[0], top[1], None if top[2] is None else 1 / (1 + math.exp(-top[2])))):
                    out[c].append(v)
            yield {"id": batch.column(0), **out}

    return map_batches(rows, run, f"id {kind}, score double, predicted int, worst_start int, worst_end int, worst double")


def locate(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each offending sentence: id, start, end (characters), sentence, chance."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [(i, a, b, t[a:b].strip(), 1 / (1 + math.exp(-min(max(z, -500), 500)))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, z in held.value.sentences(t or "")]
            found = [f for f in found if f[-1] >= least]
            yield dict(zip(("id", "start", "end", "sentence", "chance"), map(list, zip(*found)) if found else [[]] * 5))

    return map_batches(rows, run, f"id {kind}, start int, end int, sentence string, chance double")


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all columns; null texts stay."""
    place = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(t or "") < held.value.threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out_score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted and the worst sentence of every document; labels of the held-out quarter are not read."""
    model = train(df, labels, id_col, text_col=text_col)
    scored = score(df, model, id_col, text_col)
    return scored.select(F.col("id").alias(id_col), (label_hash(F.col("id"), 4) == 2).alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst")
