"""Sums of per-partition numpy results: one small array per partition, added up by SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def array_sum(df: DataFrame, columns: Sequence[str], fn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Σ over Arrow batches of ``fn(matrix)``, a vector of ``width`` numbers.

    Each task adds its batches first, so the shuffle carries one vector per
    task, and positions are summed in parallel.
    """
    cols = list(columns)

    def partial(batches):
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += fn(pdf[cols].to_numpy(dtype=float))
        yield pd.DataFrame({"pos": np.arange(width), "v": total})

    sums = df.select(*cols).mapInPandas(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for row in sums.collect():
        out[row["pos"]] = row["v"]
    return out
