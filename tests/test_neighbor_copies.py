"""The k nearest rows of other keys, where vectors and keys repeat."""

import math

import numpy as np
import pandas as pd
import pytest

from gaugewell.plans import neighbors as nb


def brute(keys, x, k):
    """key → sorted distances of its k nearest pairs, as a join on key <> key ranks them."""
    out = {}
    for key in sorted({i for i in keys if i is not None}):
        d = [np.linalg.norm(x[i] - x[j]) for i in range(len(x)) if keys[i] == key for j in range(len(x)) if keys[j] is not None and keys[j] != key]
        out[key] = sorted(v for v in d if not math.isnan(v))[:k]
    return {i: d for i, d in out.items() if d}


@pytest.mark.parametrize("kind", ["copies", "all_alike", "keys_repeat", "rows_repeat", "gaps"])
def test_every_key_has_all_its_neighbours(spark, monkeypatch, kind):
    monkeypatch.setattr(nb, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    x, keys, k = rng.normal(size=(120, 2)), list(range(120)), 4
    if kind == "copies":
        x[10:13], x[20:60], x[80:82] = x[0], x[1], x[2]
    elif kind == "all_alike":
        x[:] = 1.5
    elif kind == "keys_repeat":  # key 3 holds most of what is near it
        x[:40] = rng.normal(size=(40, 2)) * 0.01
        keys[:40] = [3] * 30 + [4] * 5 + [5, 6, 7, 8, 9]
        x[50:53] = x[0]
    elif kind == "rows_repeat":
        x, keys = np.repeat(x[:40], 2, axis=0), [i for i in range(40) for _ in range(2)]
    else:
        x[7, 1] = x[8, 0] = np.nan
        keys[30] = keys[31] = None
    pdf = pd.DataFrame({"id": pd.array(keys, dtype="Int64"), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame([(None if i is pd.NA else int(i), a, b) for i, a, b in pdf.itertuples(index=False)], "id long, a double, b double").repartition(5)
    got = nb.knn(df, "id", ["a", "b"], k).toPandas()
    assert (got["key"] != got["neighbor"]).all()
    want = brute(keys, x, k)
    have = {key: sorted(part["distance"]) for key, part in got.groupby("key")}
    assert have.keys() == want.keys()
    for key, d in want.items():
        assert np.allclose(have[key], d, atol=1e-9), key
    at = {}
    for key, row in zip(keys, x):
        at.setdefault(key, []).append(row)
    for row in got.itertuples(index=False):
        assert min(abs(np.linalg.norm(p - q) - row.distance) for p in at[row.key] for q in at[row.neighbor]) < 1e-9
    if kind != "rows_repeat" and kind != "keys_repeat":
        assert not got.duplicated(["key", "neighbor"]).any()
