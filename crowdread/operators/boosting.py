"""Boosted trees over binned features, one model per group, from sums per cell.

Features are cut into a few bins, so rows fall into cells of equal bins. For squared loss a cell's count and the
sum of its targets are all that boosting needs, as all its rows get one prediction. Both are partial aggregates, so a group
sends one row per cell and map task, however many rows it has, and the cells of a group, at most the product of the
numbers of bins, are boosted in one task. All models are fitted in one pass.

Trees have ``DEPTH`` levels; a split is the one with the largest drop of squared error over all features and
cuts, the first one on a tie. A leaf adds its mean residual times the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

TREES, RATE, DEPTH = 100, 0.1, 3
BINS = 12


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """At most ``bins`` - 1 cuts per feature, between values that differ."""
    at = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(f, at, F.lit(10_000)).alias(f) for f in features]).first()
    highest = df.agg(*[F.max(f).alias(f) for f in features]).first()
    return {f: sorted({x for x in row[f] or () if x < highest[f]}) for f in features}


def cell(cuts: dict[str, list[float]]) -> Column:
    """The number of the cell of a row: its bins as digits. A null counts as the lowest bin."""
    code = F.lit(0).cast("long")
    for feature, edges in cuts.items():
        place = F.lit(0).cast("long")
        for edge in edges:
            place = place + F.coalesce((F.col(feature) > edge).cast("long"), F.lit(0))
        code = code * (len(edges) + 1) + place
    return code


def digits(codes: np.ndarray, cuts: dict[str, list[float]]) -> np.ndarray:
    """The bins of cells, one column per feature."""
    out = np.zeros((len(codes), len(cuts)), np.int64)
    for place in range(len(cuts) - 1, -1, -1):
        size = len(list(cuts.values())[place]) + 1
        out[:, place], codes = codes % size, codes // size
    return out


def boost(bins: np.ndarray, count: np.ndarray, total: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Prediction of every cell, and the share of each feature in the drop of squared error."""
    n, features = bins.shape
    sizes = bins.max(axis=0, initial=0) + 1
    predicted = np.full(n, total.sum() / count.sum())
    gains = np.zeros(features)
    for _ in range(trees):
        residual = total - count * predicted
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes = 1 << level
            best = np.full(nodes, 1e-12)
            feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
            whole_r, whole_n = np.bincount(node, residual, nodes), np.bincount(node, count, nodes)
            base = np.divide(whole_r**2, whole_n, out=np.zeros(nodes), where=whole_n > 0)
            for f in range(features):
                if sizes[f] < 2:
                    continue
                place = node * sizes[f] + bins[:, f]
                left_r = np.cumsum(np.bincount(place, residual, nodes * sizes[f]).reshape(nodes, -1), axis=1)[:, :-1]
                left_n = np.cumsum(np.bincount(place, count, nodes * sizes[f]).reshape(nodes, -1), axis=1)[:, :-1]
                right_r, right_n = whole_r[:, None] - left_r, whole_n[:, None] - left_n
                good = (left_n > 0) & (right_n > 0)
                gain = np.where(good, left_r**2 / np.maximum(left_n, 1) + right_r**2 / np.maximum(right_n, 1) - base[:, None], 0)
                top = gain.argmax(axis=1)
                value = gain[np.arange(nodes), top]
                better = value > best * (1 + 1e-9)
                best[better], feature[better], cut[better] = value[better], f, top[better]
            found = feature >= 0
            np.add.at(gains, feature[found], best[found])
            mine = feature[node]
            goes_right = (mine >= 0) & (bins[np.arange(n), np.maximum(mine, 0)] > cut[node])
            node = 2 * node + goes_right
        leaves = 1 << DEPTH
        sums, rows = np.bincount(node, residual, leaves), np.bincount(node, count, leaves)
        predicted = predicted + RATE * np.divide(sums, rows, out=np.zeros(leaves), where=rows > 0)[node]
    return predicted, gains / gains.sum() if gains.sum() > 0 else np.full(features, 1 / features)


def boosted(
    df: DataFrame, keys: Sequence[str], cuts: dict[str, list[float]], target: Column, learns: Column, min_rows: int, trees: int = TREES
) -> DataFrame:
    """keys, ``cell``, ``predicted``, ``rows`` and ``importances`` of every cell that a row of the group falls into.

    Rows where ``learns`` is true train their group's model; the others are only predicted. Groups with fewer than ``min_rows``
    of them are left out.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, cell(cuts).alias("cell")).agg(
        F.count_if(learns).alias("n"), F.coalesce(F.sum(F.when(learns, target)), F.lit(0.0)).alias("total")
    )
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group.column("cell")))
        codes, count, total = (np.asarray(group.column(c)) for c in ("cell", "n", "total"))
        rows = int(count.sum())
        out = {k: group.column(k) for k in keys} | {"cell": group.column("cell")}
        if rows < min_rows:
            none = pa.nulls(len(codes), pa.float64())
            shares = pa.nulls(len(codes), pa.list_(pa.float64()))
        else:
            predicted, parts = boost(digits(codes, cuts), count.astype(np.float64), total, trees)
            none, shares = pa.array(predicted), pa.array([parts.tolist()] + [None] * (len(codes) - 1), pa.list_(pa.float64()))
        return pa.table(out | {"predicted": none, "rows": pa.array([rows] * len(codes)), "importances": shares})

    fields = f"{kinds}, cell long, predicted double, rows long, importances array<double>"
    return cells.groupBy(*keys).applyInArrow(run, fields).filter("predicted IS NOT NULL")
