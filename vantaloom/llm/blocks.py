"""Cells of a blocked self-comparison, so that no group of rows meets in one task.

A group of n rows is cut into m chunks by a hash of the row; cell (i, j), i <= j,
holds chunks i and j, and is compared in one task of bounded memory. Each row is sent
to m cells. All pairs of the group are covered once (those within a chunk in cell
(i, i)); links leave a cell as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_cells(rows: DataFrame, keys: list[str], row_id: str, size: Column, chunk: int) -> DataFrame:
    """Add ``cell_i, cell_j, side`` and copy each row to its cells; ``size`` is its group's number of rows."""
    m = F.ceil(size / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64(row_id, F.lit(11)), m).cast("int")
    spread = rows.withColumn("__m", m).withColumn("__r", own).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    return spread.withColumns({"cell_i": F.least("__r", "__j"), "cell_j": F.greatest("__r", "__j"), "side": (F.col("__r") > F.col("__j")).cast("int")}).drop("__m", "__r", "__j")


class Forest:
    """Union-find over 0..n-1 that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))

    def join_matrix(self, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Join along a boolean matrix without listing its pairs: breadth first over rows and columns."""
        todo_r, todo_c = linked.any(1), linked.any(0)
        for start in np.flatnonzero(todo_r):
            if not todo_r[start]:
                continue
            wave = [start]
            todo_r[start] = False
            while wave:
                r = wave.pop()
                reached = np.flatnonzero(linked[r] & todo_c)
                todo_c[reached] = False
                for c in reached:
                    self.join(int(rows[r]), int(columns[c]))
                    more = np.flatnonzero(linked[:, c] & todo_r)
                    todo_r[more] = False
                    for k in more:
                        self.join(int(rows[k]), int(columns[c]))
                    wave.extend(more)
