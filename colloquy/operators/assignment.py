"""One-to-one assignment within each group: optimal (shortest augmenting paths) or greedy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def optimal(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total; all of the shorter side are assigned."""
    if scores.shape[0] > scores.shape[1]:
        return sorted((i, j) for j, i in optimal(scores.T))
    n, m = scores.shape
    cost = -scores.astype(float)
    row_price, column_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for row in range(n):
        best, came, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, reach = row, -1, 0.0
        while True:
            # relax the open columns from the row just reached
            via = reach + cost[at] - row_price[at] - column_price
            better = ~closed & (via < best)
            best[better], came[better] = via[better], column
            column = int(np.argmin(np.where(closed, np.inf, best)))
            reach = best[column]
            closed[column] = True
            if holder[column] < 0:
                break
            at = holder[column]
        done = closed.copy()
        done[column] = False
        row_price[row] += reach
        row_price[holder[done]] += reach - best[done]
        column_price[done] -= reach - best[done]
        while column >= 0:
            before = came[column]
            holder[column] = holder[before] if before >= 0 else row
            column = before
    return sorted((int(holder[j]), j) for j in range(m) if holder[j] >= 0)


def greedy(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs by falling score (ties: row, then column), each side once, none under ``least``."""
    order = sorted(((-scores[i, j], i, j) for i in range(scores.shape[0]) for j in range(scores.shape[1])))
    rows, columns, out = set(), set(), []
    for score, i, j in order:
        if -score >= least and i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return sorted(out)


def assign(pairs: DataFrame, group: str, left: str, right: str, score: str, method: str = "optimal", least: float = float("-inf")) -> DataFrame:
    """(group, left, right, score) of the assigned pairs. A group is the matrix of one recording; a pair that
    stands several times counts with its greatest score, and pairs that don't stand are not assigned."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (pairs.schema[c] for c in (group, left, right, score)))

    def solve(table):
        import pandas as pd

        frame = table.to_pandas()
        grid = frame.pivot_table(index=left, columns=right, values=score, aggfunc="max").sort_index().sort_index(axis=1)
        scores = grid.to_numpy(float)
        stands = ~np.isnan(scores)
        # so low that a pair that doesn't stand is taken only if there is no other way
        low = np.nanmin(scores) - (np.nanmax(scores) - np.nanmin(scores) + 1) * (min(scores.shape) + 1)
        filled = np.where(stands, scores, low)
        found = [(i, j) for i, j in (optimal(filled) if method == "optimal" else greedy(filled, max(least, np.nanmin(scores)))) if stands[i, j]]
        rows = [(frame[group].iloc[0], grid.index[i], grid.columns[j], grid.iat[i, j]) for i, j in found]
        import pyarrow as pa

        return pa.Table.from_pandas(pd.DataFrame(rows, columns=[group, left, right, score]), preserve_index=False).cast(table.schema)

    return pairs.select(group, left, right, score).groupBy(group).applyInArrow(solve, schema)
