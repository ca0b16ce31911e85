"""Approximate nearest rows by navigable small-world graphs, one for each part of the data.

Rows are dealt evenly over parts of bounded size. In a part, rows of equal direction
are one node. Nodes are on levels that thin out upwards by a fixed ratio; on each
level a node keeps its nearest others, except those which are nearer to one that it
already keeps, and links go both ways. Pieces of a level that hang apart are linked to their nearest
node outside. Parts are rows of a table, written once.

A search goes greedily down to the bottom level, and from there keeps the ``depth``
best nodes found so far, of which the best unvisited one is opened next; it ends when that is
worse than all kept ones. A greater depth scores more rows. With a depth of
all nodes of a part the result is exact.

Edge cases: null ids and null, empty or zero vectors, vectors with a null or
non-finite component, and those of another length than most in their part, take no part; a query's own id is no result of it;
equal rows are all results; ties go to the smaller id; empty tables give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import written
from .rounds import in_rounds

#: Bytes of a part's vectors; links that a node chooses, and has at most, on a level; nearest others that are looked at; nodes for one on the next level.
PART_BYTES, LINKS, MOST_LINKS, LOOKED_AT, RATIO = 16 << 20, 16, 48, 64, 16
LEAST_DEPTH, MOST_DEPTH = 1, 1000
#: Queries that visit a part's graph in one task, on average at most; of these, how many walk abreast, and bytes of what they have seen; nodes that wait beyond the greatest depth, and numbers that are multiplied at once.
VISITS, ABREAST, SEEN_BYTES, AHEAD, AT_ONCE = 2_048, 256, 16 << 20, 256, 1 << 15
_FOUND = "query_id long, depth int, id long, grp long, similarity double, scored long"


def checked_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or not LEAST_DEPTH <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be a whole number from {LEAST_DEPTH} to {MOST_DEPTH}")
    return depth


def usable(vector: Column) -> Column:
    """A vector with a direction."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows ``i`` of ``x`` with rows ``j`` of ``y``; few are held at once, so they stay near the processor."""
    out, at_once = np.empty(len(i)), max(1, AT_ONCE // x.shape[1])
    for a in range(0, len(i), at_once):
        some = slice(a, a + at_once)
        np.einsum("ij,ij->i", x.take(i[some], axis=0), y.take(j[some], axis=0), out=out[some])
    return out


def _nearest(x: np.ndarray, n: int) -> np.ndarray:
    """For each row the n most similar others, best first."""
    out = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), 256):
        s = x[k : k + 256] @ x.T
        s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
        some = np.argpartition(-s, n - 1, axis=1)[:, :n]
        out[k : k + 256] = np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable"), 1)
    return out


def _pieces(links: list[list[int]]) -> np.ndarray:
    """The number of the connected piece of each node; links go both ways."""
    piece, n = np.full(len(links), -1), 0
    for first in range(len(links)):
        if piece[first] < 0:
            piece[first], open_at = n, [first]
            while open_at:
                for other in links[open_at.pop()]:
                    if piece[other] < 0:
                        piece[other] = n
                        open_at.append(other)
            n += 1
    return piece


def level_links(x: np.ndarray) -> list[list[int]]:
    """Links of the nodes with directions ``x``: connected, in both directions, and not in the same direction twice."""
    if len(x) < 2:
        return [[] for _ in x]
    near = _nearest(x, min(LOOKED_AT, len(x) - 1))
    links: list[list[int]] = [[] for _ in x]
    for i, others in enumerate(near.tolist()):
        among = x[others] @ x[others].T
        to_me, kept = x[others] @ x[i], []
        for at in range(len(others)):
            if all(among[at, other] < to_me[at] for other in kept):
                kept.append(at)
                if len(kept) == LINKS:
                    break
        links[i] = [others[at] for at in kept]
    both = [set(own) for own in links]
    for i, own in enumerate(links):
        for other in own:
            if len(both[other]) < MOST_LINKS:
                both[other].add(i)
    for i in range(len(x)):  # a link without its way back leaves, unless it is all that a node has
        both[i] = {o for o in both[i] if i in both[o]} or both[i]
        for other in both[i]:
            both[other].add(i)
    while (piece := _pieces([[*own] for own in both])).max() > 0:
        for p in range(1, int(piece.max()) + 1):
            inside, outside = np.flatnonzero(piece == p), np.flatnonzero(piece != p)
            inside = inside[:: max(1, len(inside) // 64)]  # any of them keeps the level connected
            best = np.unravel_index((x[inside] @ x[outside].T).argmax(), (len(inside), len(outside)))
            a, b = int(inside[best[0]]), int(outside[best[1]])
            both[a].add(b), both[b].add(a)
    return [sorted(own) for own in both]


class Graph:
    """Nodes with their directions, the rows of each node, and links by level, as the places where each node's begin and the nodes they lead to; node 0 is on all levels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, groups: np.ndarray):
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids, groups = x[order], ids[order], groups[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        self.first = np.flatnonzero(np.append(new, True))  # of each node's rows
        mixed = np.random.default_rng(1).permutation(int(new.sum()))  # nodes on higher levels are any nodes
        sizes = np.diff(self.first)[mixed]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.first[mixed], self.first[mixed + 1], strict=True)])
        self.x, self.ids, self.groups = x[self.first[mixed]], ids[rows], groups[rows]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.levels, n = [], len(self.x)
        while n:
            links = level_links(self.x[:n])
            self.levels.append((np.cumsum([0, *map(len, links)]), np.array([o for own in links for o in own], np.int32)))
            n = n // RATIO

    def packed(self) -> bytes:
        out, arrays = io.BytesIO(), {"x": self.x, "ids": self.ids, "groups": self.groups, "first": self.first}
        for i, (at, to) in enumerate(self.levels):
            arrays |= {f"at{i}": at, f"to{i}": to}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        self, arrays = cls.__new__(cls), np.load(io.BytesIO(data))
        self.x, self.ids, self.groups, self.first = (arrays[c] for c in ("x", "ids", "groups", "first"))
        self.levels = []
        while f"at{len(self.levels)}" in arrays:
            self.levels.append((arrays[f"at{len(self.levels)}"], arrays[f"to{len(self.levels)}"]))
        return self

    def _entry(self, q: np.ndarray, met: np.ndarray) -> tuple[int, float]:
        """Where the bottom level is entered, and its similarity; ``met`` notes the nodes that were scored."""
        at, best, met[0] = 0, float(self.x[0] @ q), 1
        for begin, to in reversed(self.levels[1:]):
            while len(links := to[begin[at] : begin[at + 1]]):
                s = self.x[links] @ q
                met[links] = 1
                i = int(s.argmax())
                if s[i] <= best:
                    break
                at, best = int(links[i]), float(s[i])
        return at, best

    def walks(self, asked: np.ndarray, depths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Similarity and node of what each query opened, in order, and, by query and depth, how many it had opened and scored when a search of that depth ends.

        Which node comes next doesn't depend on the depth, so lesser depths are beginnings of the greatest one's walk. A depth
        ends at a node than which as many opened ones are nearer; then these are the best of all that were scored. The
        queries walk abreast: each step opens one node of every query.
        """
        most, n, rows = max(depths), len(self.x), np.arange(len(asked))
        (begin, to), by_depth = self.levels[0], np.array(depths)
        seen = np.zeros((len(asked), n), np.uint8)  # 1: scored on the way down; 2: on the bottom level
        opened, nodes = np.full((len(asked), most + AHEAD), -np.inf), np.zeros((len(asked), most + AHEAD), np.int32)
        near, what, n_open = np.full((len(asked), most + AHEAD), -np.inf), np.zeros((len(asked), most + AHEAD), np.int32), np.ones(len(asked), np.int64)
        least, ends, n_scored = np.full(len(asked), -np.inf), np.full((len(asked), len(depths)), -1), np.zeros((len(asked), len(depths)), np.int64)
        for i, q in enumerate(asked):
            what[i, 0], near[i, 0] = self._entry(q, seen[i])
        scored = seen.sum(axis=1, dtype=np.int64)
        seen[rows, what[:, 0]] = 2
        seen, step = seen.reshape(-1), 0
        while True:
            at = near[:, : n_open.max()].argmax(axis=1)
            s = near[rows, at]
            nearer = (opened[:, :step] > s[:, None]).sum(axis=1)
            over = (ends < 0) & ((nearer[:, None] >= by_depth) | (s == -np.inf)[:, None])
            ends[over], n_scored[over] = step, np.broadcast_to(scored[:, None], over.shape)[over]
            on = np.flatnonzero((ends < 0).any(axis=1))
            if not len(on):
                return opened[:, :step], nodes[:, :step], ends, n_scored
            if step == opened.shape[1]:
                opened, nodes = (np.pad(x, ((0, 0), (0, step)), constant_values=c) for x, c in ((opened, -np.inf), (nodes, 0)))
            node = what[on, at[on]]
            opened[on, step], nodes[on, step], near[on, at[on]] = s[on], node, -np.inf
            step += 1
            a, size = begin[node], begin[node + 1] - begin[node]
            query = np.repeat(on, size)
            other = to[np.arange(len(query)) + np.repeat(a - np.cumsum(size) + size, size)]
            key = query * n + other
            before = seen[key]
            new = before < 2
            query, other, key, before = query[new], other[new], key[new], before[new]
            seen[key] = 2
            scored += np.bincount(query[before == 0], minlength=len(asked))
            s = _products(self.x, other, asked, query)
            some = s > least[query]
            query, other, s = query[some], other[some], s[some]
            size = np.bincount(query, minlength=len(asked))
            if (n_open + size).max() > near.shape[1]:  # those go that as many are nearer to as the greatest depth
                if near.shape[1] + step >= most:
                    least = np.partition(np.concatenate([near, opened[:, :step]], axis=1), -most, axis=1)[:, -most]
                row, col = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                n_open = np.bincount(row, minlength=len(asked))
                to_col = np.arange(len(row)) - np.repeat(np.cumsum(n_open) - n_open, n_open)
                kept, of = near[row, col], what[row, col]
                if (wide := int((n_open + size).max())) > near.shape[1]:
                    near, what = np.empty((len(asked), wide)), np.zeros((len(asked), wide), np.int32)
                near.fill(-np.inf)
                near[row, to_col], what[row, to_col] = kept, of
            place = n_open[query] + np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
            near[query, place], what[query, place] = s, other
            n_open = n_open + size

    def allowed(self, scope: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and groups of the rows in the scope, and where each node's begin; a node's ids ascend."""
        if scope is None:
            return self.ids, self.groups, self.first
        inside = np.isin(self.groups, scope)
        return self.ids[inside], self.groups[inside], np.append(0, np.cumsum(inside))[self.first]


def _best_rows(opened: np.ndarray, nodes: np.ndarray, ends: np.ndarray, depth: int, k: int, own: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Query, id, group and similarity of each query's k best rows among the ``depth`` nearest nodes that it opened before its end."""
    ids, groups, first = rows
    s = np.where(np.arange(opened.shape[1]) < ends[:, None], opened, -np.inf)
    if s.shape[1] > depth:
        at = np.argpartition(-s, depth - 1, axis=1)[:, :depth]
        s, nodes = np.take_along_axis(s, at, 1), np.take_along_axis(nodes, at, 1)
    s = np.round(s, 9)
    order = np.argsort(-s, axis=1, kind="stable")
    s, nodes = np.take_along_axis(s, order, 1), np.take_along_axis(nodes, order, 1)
    size = np.where(s > -np.inf, np.minimum(first[nodes + 1] - first[nodes], k + 1), 0)  # one of them may be the query's own
    enough = np.cumsum(size, axis=1) > k
    least = np.where(enough.any(axis=1), s[np.arange(len(s)), enough.argmax(axis=1)], -np.inf)
    query, col = np.nonzero((s >= least[:, None]) & (size > 0))
    size = size[query, col]
    row = np.repeat(first[nodes[query, col]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    query, similarity = np.repeat(query, size), np.repeat(s[query, col], size)
    other = ids[row] != own[query]
    query, similarity, row = query[other], similarity[other], row[other]
    order = np.lexsort((ids[row], -similarity, query))
    query, similarity, row = query[order], similarity[order], row[order]
    take = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[take], ids[row[take]], groups[row[take]], similarity[take]


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    lengths = frame.vector.map(len)
    frame = frame[lengths == lengths.mode().iloc[0]]
    graph = Graph(_unit(frame.vector), frame.id.to_numpy(np.int64), frame.grp.fillna(-1).to_numpy(np.int64))
    return pd.DataFrame({"part": frame.part.iloc[:1], "n": [len(graph.ids)], "graph": [graph.packed()]})


def build(data: DataFrame, part_rows: int | None = None) -> DataFrame:
    """A table of part, n and graph over ``data`` (id, grp, vector): one shuffle of the rows to their parts."""
    rows = data.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), F.col("vector").cast("array<double>").alias("vector"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("wide")).first()
    parts = max(1, -(-size.n // (part_rows or max(1, PART_BYTES // (8 * (size.wide or 1))))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(parts)))  # equal rows are dealt as well
    dealt = dealt.repartitionByRange(4 * parts, "part")  # a part is a task; by hash, parts share tasks, and small tasks are joined into one
    return written(dealt.groupBy("part").applyInPandas(_built, "part long, n long, graph binary"), "graphs")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A table of graphs that ``build`` has left in a folder."""
    return spark.read.parquet(folder)


def _visited(k: int, depths: tuple[int, ...], scope: tuple[int, ...] | None):
    def visit(lot: pd.DataFrame):
        lot = lot.sort_values("id")
        asked, ids = [_unit([v])[0] for v in lot.vector], lot.id.to_numpy(np.int64)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data in (x.as_py() for batch in batches for x in batch.column("graph")):
                graph = Graph.unpacked(data)
                rows, n, fitting = graph.allowed(scope), len(graph.x), np.array([i for i, q in enumerate(asked) if len(q) == graph.x.shape[1]], np.int64)
                abreast = max(1, min(ABREAST, SEEN_BYTES // n))
                for some in (fitting[a : a + abreast] for a in range(0, len(fitting), abreast)):
                    opened, nodes, ends, scored = graph.walks(np.stack([asked[i] for i in some]), depths)
                    for i, depth in enumerate(depths):
                        query, *best = _best_rows(opened, nodes, ends[:, i], depth, k, ids[some], rows)
                        yield _batch(ids[some][query], depth, *best, None)
                        yield _batch(ids[some], depth, None, None, None, scored[:, i])

        return found

    return visit


def _batch(query_ids: np.ndarray, depth: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    """A batch of results; a column that is None is null."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    rest = (pa.nulls(len(query_ids), kind) if x is None else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(np.full(len(query_ids), depth), pa.int32()), *rest], ["query_id", "depth", "id", "grp", "similarity", "scored"])


def swept(graphs: DataFrame, queries: DataFrame, k: int, depths: tuple[int, ...], scope: tuple[int, ...] | None = None) -> DataFrame:
    """query_id, depth, id, grp, similarity: at most k rows of each part for each query and depth; and a row a part, query and depth with scored, the nodes it looked at.

    One walk answers all depths. A task searches one lot of the queries, so it is no longer when there are more of them.
    With ``scope``, rows of other groups are dropped from what the search has kept, as
    an index scan does that filters behind it.
    """
    depths = tuple(sorted({checked_depth(d) for d in depths}))
    asked = queries.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return in_rounds(graphs.repartition(max(1, graphs.count()), "part"), asked, "id", _visited(k, depths, scope), _FOUND, VISITS, arrow=True)


def searched(graphs: DataFrame, queries: DataFrame, k: int, depth: int, scope: tuple[int, ...] | None = None) -> DataFrame:
    """``swept`` to a single depth, without that column."""
    return swept(graphs, queries, k, (depth,), scope).drop("depth")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, grp, similarity: the k best of what the parts returned."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("scored")
