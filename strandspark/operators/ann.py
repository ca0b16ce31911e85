"""Approximate nearest rows by cells: the depth of a search is the number of cells it probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import ranked

#: Centres of cells, from a sample of bounded size; rows of a cell that one task holds.
CELLS, SAMPLE, PART = 64, 4_096, 8_192


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(data: DataFrame, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over the rows of least hash, at most SAMPLE; every row is indexed by them."""
    x = _unit([r.vector for r in data.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()] or [[0.0]])
    c = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (of == i).any():
                m = x[of == i].mean(0)
                c[i] = m / max(np.linalg.norm(m), 1e-300)
    return c


def _filed(c: np.ndarray, probes: int):
    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = np.argsort(-(_unit(frame.vector) @ c.T), axis=1, kind="stable")[:, :probes]
                out = frame.loc[frame.index.repeat(near.shape[1])].reset_index(drop=True)
                out["cell"] = near.ravel()
                yield out[["id", "vector", "cell"]]

    return filed


def _nearest(k: int):
    def nearest(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "similarity"]
        if not len(data) or not len(queries):
            return pd.DataFrame({n: [] for n in names})
        ids, out = data.id.to_numpy(), []
        s = np.round(_unit(queries.vector) @ _unit(data.vector).T, 9)
        for q, row in zip(queries.id.to_numpy(), s, strict=True):
            row = np.where(ids == q, -np.inf, row)
            best = np.lexsort((ids, -row))[:k]
            out += [(q, ids[i], row[i]) for i in best if row[i] > -np.inf]
        return pd.DataFrame(out, columns=names)

    return nearest


def probed_top_k(data: DataFrame, queries: DataFrame, k: int, probes: int, cells: int = CELLS) -> DataFrame:
    """query_id, rank, id, similarity of the k best rows in the ``probes`` nearest cells.

    Cells are dealt over parts by hash, each met by all queries of the cell, so a
    large cell is several tasks. With as many probes as cells the result is exact.
    """
    c = centres(data, cells)
    filed = "id long, vector array<double>, cell int"
    usable = lambda df: df.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    rows = usable(data).mapInPandas(_filed(c, 1), filed)
    parts = max(1, -(-data.count() // (PART * len(c))) * 2)
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    right = usable(queries).mapInPandas(_filed(c, min(probes, len(c))), filed).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(_nearest(k), "query_id long, id long, similarity double")
    return ranked(found, [F.col("similarity").desc(), "id"], within=("query_id",)).where(F.col("rank") <= k)
