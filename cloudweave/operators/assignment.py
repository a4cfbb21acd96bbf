"""Assignment of rows to columns and the evaluation of segmentations by it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(score: np.ndarray) -> list[int]:
    """The column of each row in an assignment of largest total score; needs at least as many columns as rows.

    Rows enter one by one along shortest augmenting paths over reduced costs; all columns are relaxed at once.
    """
    score = np.asarray(score, dtype=np.float64)
    rows, columns = score.shape
    if rows > columns:
        raise ValueError("there are more rows than columns")
    cost = score.max(initial=0.0) - score
    of_column = np.full(columns, -1)
    by_row, by_column = np.zeros(rows), np.zeros(columns)
    for first in range(rows):
        distance, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, dtype=bool)
        row, reached, at = first, 0.0, -1
        while True:
            through = reached + cost[row] - by_row[row] - by_column
            better = ~done & (through < distance)
            distance[better], came[better] = through[better], at
            at = int(np.where(done, np.inf, distance).argmin())
            reached = distance[at]
            done[at] = True
            if of_column[at] < 0:
                break
            row = of_column[at]
        seen = done.copy()
        seen[at] = False
        by_row[first] += reached
        inner = np.flatnonzero(seen)
        by_row[of_column[inner]] += reached - distance[inner]
        by_column[inner] -= reached - distance[inner]
        while at >= 0:
            before = came[at]
            of_column[at] = first if before < 0 else of_column[before]
            at = before
    out = [-1] * rows
    for c, r in enumerate(of_column):
        if r >= 0:
            out[r] = c
    return out


def evaluate_segmentation(points: DataFrame, label: str = "label", truth: str = "truth") -> DataFrame:
    """One row (points, matched, mislabelled) after the best matching of labels to true labels.

    Only the table of label pairs with their counts is gathered, never points.
    """
    counts = points.groupBy(F.col(label).alias("l"), F.col(truth).alias("t")).agg(F.count("*").alias("n")).collect()
    ls, ts = sorted({r["l"] for r in counts}), sorted({r["t"] for r in counts})
    table = np.zeros((len(ls), max(len(ts), len(ls))))
    for r in counts:
        table[ls.index(r["l"]), ts.index(r["t"])] = r["n"]
    matched = int(sum(table[i, c] for i, c in enumerate(assign(table)))) if ls else 0
    total = int(table.sum())
    return points.sparkSession.createDataFrame([(total, matched, total - matched)], "points long, matched long, mislabelled long")
