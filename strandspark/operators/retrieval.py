"""Vector, text and hybrid retrieval with exact, tie-broken ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine_to, rrf
from ..staging import spread, united, written
from .rounds import in_rounds

#: Rows of a block of data and of a block of queries, which are multiplied at a time: a product takes 4 MB.
DATA_BLOCK, QUERY_BLOCK = 2_048, 256


def in_scope(df: DataFrame, column: str, scope) -> DataFrame:
    return df.where(F.col(column).isin(list(scope)))


def vector_top_k(chunks: DataFrame, query: list[float], k: int, scope: Column | None = None) -> DataFrame:
    """The k rows of greatest cosine similarity, ties by id: one scan and a bounded heap per task."""
    rows = chunks.where(F.col("vector").isNotNull() if scope is None else scope & F.col("vector").isNotNull())
    return rows.withColumn("similarity", F.round(cosine_to(F.col("vector"), query), 9)).drop("vector").orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k)


def ranked(df: DataFrame, by: list, name: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))


def collapsed(df: DataFrame, thread: tuple[str, ...], k: int, rank: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """The best-ranked row of each thread, and of these the first k."""
    best = ranked(df, [rank], "of_thread", (*within, *thread)).where("of_thread = 1").drop("of_thread")
    return ranked(best, [rank], "position", within).where(F.col("position") <= k)


def fused(branches: dict[str, DataFrame], k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of frames with id and rank: the sum of shares, at most 1, ties by id; the first k, or k of each ``within``."""
    both = united([df.select(*within, "id", rrf(F.col("rank")).alias("share"), F.lit(name).alias("branch")) for name, df in branches.items()], "branches")
    scores = both.groupBy(*within, "id").agg(F.least(F.lit(1.0), F.sum("share")).alias("score"), F.count(F.lit(1)).cast("long").alias("n_branches"))
    if within:
        return ranked(scores, [F.col("score").desc(), "id"], within=within).where(F.col("rank") <= k)
    return scores.orderBy(F.col("score").desc(), "id").limit(k)


def refused(score: Column, cutoff: float) -> Column:
    """No result, or a best score below the cutoff."""
    return F.coalesce(score, F.lit(0.0)) < cutoff


def _unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visited(k: int, other_group: bool):
    """A task's k nearest rows for each query of a lot: a matrix product for each pair of blocks, and a running kth similarity."""

    def visit(lot: pd.DataFrame):
        query_ids, query_groups = lot.id.to_numpy(np.int64), lot.grp.fillna(-1).to_numpy(np.int64)
        asked = _unit_rows(lot.vector) if len(lot) else np.empty((0, 1))

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * -(-len(asked) // QUERY_BLOCK)
            worst = np.full(len(asked), -np.inf)
            for frame in frames:
                for n in range(0, len(frame), DATA_BLOCK):
                    part = frame.iloc[n : n + DATA_BLOCK]
                    ids, groups, rows = part.id.to_numpy(np.int64), part.grp.fillna(-1).to_numpy(np.int64), _unit_rows(part.vector)
                    for i, a in enumerate(range(0, len(asked), QUERY_BLOCK)):
                        to = slice(a, a + QUERY_BLOCK)
                        s = np.round(asked[to] @ rows.T, 9)
                        out = query_groups[to, None] == groups[None, :] if other_group else query_ids[to, None] == ids[None, :]
                        s[np.isnan(s) | out] = -np.inf
                        m = min(k, s.shape[1])
                        if not (s >= worst[to, None]).any():
                            continue
                        kth = np.maximum(np.partition(s, -m, axis=1)[:, -m], worst[to])
                        row, at = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
                        row, near, group, value = (np.concatenate(x) for x in zip(held[i], (row, ids[at], groups[at], s[row, at]), strict=True))
                        order = np.lexsort((near, -value, row))
                        row, near, group, value = row[order], near[order], group[order], value[order]
                        take = np.arange(len(row)) - np.searchsorted(row, row) < k
                        held[i] = (row[take], near[take], group[take], value[take])
                        full, last = np.unique(held[i][0][::-1], return_index=True)  # the last kept row of each query is its worst
                        enough = np.bincount(held[i][0], minlength=len(s))[full] == k
                        worst[a + full[enough]] = held[i][3][::-1][last[enough]]
            for i, (row, near, group, value) in enumerate(held):
                if len(row):
                    yield pd.DataFrame({"query_id": query_ids[i * QUERY_BLOCK + row], "query_group": query_groups[i * QUERY_BLOCK + row], "id": near, "grp": group, "similarity": value})

        return best

    return visit


def batch_top_k(data: DataFrame, queries: DataFrame, k: int, other_group: bool = False) -> DataFrame:
    """The k nearest rows of ``data`` (id, grp, vector) for each query, the query's own id left out; with ``other_group``, all rows of its group.

    The data isn't moved: lots of queries visit it, and each task returns k rows a query, of which ranks are taken. A task holds
    a block of data and one product of it with a block of queries at a time, and its k rows for each query of the lot.
    """
    usable = lambda df: df.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long"), F.col("grp").cast("long"), F.col("vector").cast("array<double>"))
    near = in_rounds(spread(usable(data)), usable(queries), "id", _visited(k, other_group), "query_id long, query_group long, id long, grp long, similarity double")
    near = written(near, "nearest")  # a table: what is built on the ranks several times doesn't search several times
    return ranked(near, [F.col("similarity").desc(), "id"], within=("query_id",)).where(F.col("rank") <= k)
