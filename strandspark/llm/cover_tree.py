"""Exact top-k inner products by dual-tree search over cover trees.

Centres from a bounded sample route queries and data alike; what is routed to one
centre is split into blocks and groups of bounded size, whatever their number, and
each of these is indexed by a cover tree: a node's children lie within a fraction
of its radius and are farther than that from each other, and small children share a
leaf. For a query node with centre q and covering radius r, and a data node with
centre p and radius s, no inner product exceeds q.p + |q| s + |p| r + r s, nor half of
Q^2 + P^2 - max(0, |q - p| - r - s)^2, where Q and P are the nodes' greatest norms. A
pair of nodes whose lesser bound is below the worst kth score of the node's queries is pruned:
first whole groups against whole blocks, from their summaries, then nodes while a
group descends a block.

The first kth scores come from the routing sample. Each group then searches the block
of nearest centre, and what it finds there raises its kth scores before it is held
against all other blocks. Groups travel to blocks, as they are small: a task holds one
block and a bounded number of groups.

The result doesn't depend on the sample, which only steers the pruning.

Edge cases: vectors that are null, or hold a null or non-finite component, and rows
with a null id take no part; a vector is padded with zeros to a longer one, so an
empty vector scores 0; rows under a query's id are its own and no candidates of it;
of repeated query ids one row asks, that with the least hash; other repeated rows
all are candidates; fewer than k candidates give as many rows; ties go to the
smaller id; empty tables give no rows; further columns are ignored. Scores beyond
53 bits are summed as exact integers and clipped to the range of a long.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bounds of the sample, its centres, a block of data, a group of queries, a leaf, and the groups that meet a block in one task.
SAMPLE, CENTRES, BLOCK, GROUP, LEAF, LOT = 2_048, 64, 8_192, 512, 64, 64
#: A child covers this fraction of its parent's radius; summaries that meet in one task.
SHRINK, CHUNK = 0.7, 512
SCALE = 256
#: No score: below that of any pair.
_NONE = np.int64(-(2**63))
_TREE = "part long, chunk long, n long, payload binary, summary binary"
_PAIR = "grp long, block long, near double"
#: Most tasks of a search.
MOST_TASKS = 20_000


def valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def matrix(vectors) -> np.ndarray:
    """floor(256 x) of every component, padded with zeros to the longest vector."""
    rows = [np.asarray(v, np.float64) for v in vectors]
    out = np.zeros((len(rows), max([1, *map(len, rows)])))
    for i, row in enumerate(rows):
        out[i, : len(row)] = np.floor(SCALE * row)
    return out


def packed(points: np.ndarray) -> list[bytes]:
    """Each row as bytes: the size of its components, then these as the smallest integers, or floats, that hold all rows."""
    most = np.abs(points).max(initial=0)
    kind = next((t for t in ("<i1", "<i2", "<i4") if most <= np.iinfo(t).max), "<f8")
    head = bytes([np.dtype(kind).itemsize])
    return [head + row.tobytes() for row in points.astype(kind)]


def unpacked(rows) -> np.ndarray:
    """The matrix of packed rows, padded with zeros to the longest."""
    rows = [np.frombuffer(x, {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}[x[0]], offset=1) for x in rows]
    out = np.zeros((len(rows), max([1, *map(len, rows)])))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, clipped to the range of a long."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, _NONE + 1, 2**63 - 1).astype(np.int64)


class CoverTree:
    """Points in the order of their leaves, and for each node its centre, radius, children and range of points."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes = [], []
        self._build(points, np.arange(len(points)), 0)
        self.order = np.array(self.order, int)
        self.points = points[self.order]
        place = np.empty(len(points), int)
        place[self.order] = np.arange(len(points))
        self.centre_at = place[[n[0] for n in self.nodes]]
        self.radii = np.array([n[1] for n in self.nodes])
        self.ranges = [(n[2], n[3]) for n in self.nodes]
        self.children = [n[4] for n in self.nodes]
        self._measure()

    def _measure(self) -> None:
        self.centres = self.points[self.centre_at]
        self.norms = np.sqrt((self.centres**2).sum(1))
        norms = np.sqrt((self.points**2).sum(1))
        self.reach = np.array([norms[a:b].max(initial=0) for a, b in self.ranges])

    def __getstate__(self) -> dict:
        """Without what the points give again, and the points as the smallest integers that hold them."""
        most = np.abs(self.points).max(initial=0)
        kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
        return {k: v for k, v in self.__dict__.items() if k not in ("centres", "norms", "reach", "nodes", "order")} | {"points": self.points.astype(kind)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"points": state["points"].astype(np.float64)}
        self._measure()

    def _build(self, points: np.ndarray, at: np.ndarray, centre: int, leaf: bool = False) -> int:
        distance = np.sqrt(((points[at] - points[centre]) ** 2).sum(1))
        radius, node, first = float(distance.max(initial=0)), len(self.nodes), len(self.order)
        self.nodes.append(None)
        children = []
        if leaf or len(at) <= LEAF or radius == 0:
            self.order += at.tolist()
        else:
            cover, left, small = SHRINK * radius, at, []
            pick = centre
            while len(left):
                near = np.sqrt(((points[left] - points[pick]) ** 2).sum(1)) <= cover
                held, left = left[near], left[~near]
                if len(held) > LEAF // 4:
                    children.append(self._build(points, held, pick))
                else:
                    small.append(held)
                pick = left[0] if len(left) else centre
            pooled = np.concatenate(small) if small else at[:0]
            for k in range(0, len(pooled), LEAF):
                part = pooled[k : k + LEAF]
                children.append(self._build(points, part, part[0], leaf=True))
        self.nodes[node] = (centre, radius, first, len(self.order), children)
        return node


def bounds(a: tuple, b: tuple) -> np.ndarray:
    """Of centres, norms, radii and greatest norms on either side: what no inner product of the pair exceeds."""
    (p, pn, pr, pm), (q, qn, qr, qm) = a, b
    d = min(p.shape[1], q.shape[1])
    middle = p[:, :d] @ q[:, :d].T
    by_radius = middle + pn[:, None] * qr + pr[:, None] * qn + pr[:, None] * qr
    apart = np.sqrt(np.maximum(0, pn[:, None] ** 2 + qn**2 - 2 * middle)) - pr[:, None] - qr
    by_distance = (pm[:, None] ** 2 + qm**2 - np.maximum(0, apart) ** 2) / 2
    most = np.minimum(by_radius, by_distance)
    return most + 1e-9 * (np.abs(most) + pm[:, None] ** 2 + qm**2 + 1)  # rounding must not prune


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row of the query, id and score of what may be among its k best, and how many pairs were scored; ``kth`` has scores known to be reached."""
    tested = 0
    scores = np.full((len(query_ids), k), _NONE)
    ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
    worst = kth.copy()
    of = lambda t, rows: (t.centres[rows], t.norms[rows], t.radii[rows], t.reach[rows])
    norms = np.sqrt((queries.points**2).sum(1))

    def each(a: int, b: int, rows: list[int]) -> np.ndarray:
        """Bounds of single queries, as nodes without a radius, with some data nodes."""
        return bounds((queries.points[a:b], norms[a:b], np.zeros(b - a), norms[a:b]), of(data, rows))

    heap = [(-float(bounds(of(queries, [0]), of(data, [0]))[0, 0]), 0, 0)]
    while heap:
        most, q, d = heapq.heappop(heap)
        a, b = queries.ranges[q]
        if -most < worst[a:b].min():
            continue
        if not queries.children[q] and not data.children[d]:
            c, e = data.ranges[d]
            asking = a + np.flatnonzero(each(a, b, [d])[:, 0] >= worst[a:b])
            found = products(queries.points[asking], data.points[c:e])
            tested += found.size
            seen = (found >= worst[asking, None]) & (query_ids[asking, None] != data_ids[None, c:e])
            for i in np.flatnonzero(seen.any(1)):
                row, take = asking[i], np.flatnonzero(seen[i])
                s = np.concatenate([scores[row], found[i, take]])
                x = np.concatenate([ids[row], data_ids[c + take]])
                best = np.lexsort((x, ~s))[:k]  # ~s falls as s rises, without overflow
                scores[row], ids[row] = s[best], x[best]
                worst[row] = max(worst[row], scores[row, -1])
        elif not queries.children[q]:
            most = each(a, b, data.children[d])
            able = (most >= worst[a:b, None]).any(0)
            for x, m in zip(data.children[d], np.where(able, most.max(0), -np.inf).tolist(), strict=True):
                if m > -np.inf:
                    heapq.heappush(heap, (-m, q, x))
        else:
            if data.children[d] and data.radii[d] >= queries.radii[q]:
                pairs = [(q, x) for x in data.children[d]]
            else:
                pairs = [(x, d) for x in queries.children[q]]
            most = bounds(of(queries, sorted({x for x, _ in pairs})), of(data, sorted({y for _, y in pairs}))).ravel()
            for m, (x, y) in zip(most.tolist(), pairs, strict=True):
                u, v = queries.ranges[x]
                if m >= worst[u:v].min():
                    heapq.heappush(heap, (-m, x, y))
    row, at = np.nonzero(scores > _NONE)
    return row, ids[row, at], scores[row, at], tested


def _routed(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """With part, the number of the block: a centre's rows are dealt over as many blocks as their number needs, also rows of one id."""

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = matrix(frame.vector)
            d = min(x.shape[1], centres.shape[1])
            # the nearest centre, up to the row's own norm
            centre = (0.5 * (centres**2).sum(1)[None, :] - x[:, :d] @ centres[:, :d].T).argmin(1) if len(frame) else np.empty(0, int)
            yield pd.DataFrame({"id": frame.id, "vector": packed(x), "centre": centre, "salt": np.arange(len(frame))})

    routed = written(rows.mapInPandas(route, "id long, vector binary, centre int, salt int"), "routed")
    counts = {x.centre: x.n for x in routed.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a centre
    blocks = [-(-counts.get(c, 0) // most) for c in range(len(centres))]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    of = F.col("centre") + 1
    part = F.element_at(F.array(*map(F.lit, first)), of) + F.pmod(F.xxhash64("id", "salt"), F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, blocks)), of)))
    return routed.select("id", "vector", part.cast("long").alias("part"))


def _row(tree: CoverTree, ids: np.ndarray, kth: np.ndarray, part: int) -> pd.DataFrame:
    summary = (tree.centres[0], float(tree.norms[0]), float(tree.radii[0]), float(tree.reach[0]), int(kth.min()))
    return pd.DataFrame({"part": [part], "chunk": [part // CHUNK], "n": [len(ids)], "payload": [pickle.dumps((tree, ids, kth))], "summary": [pickle.dumps(summary)]})


def _trees(sample: tuple[np.ndarray, np.ndarray] | None, k: int):
    """Indexes a part; with ``sample``, also each point's kth score in the sample."""

    def trees(frame: pd.DataFrame) -> pd.DataFrame:
        points, ids = unpacked(frame.vector), frame.id.to_numpy()
        tree = CoverTree(points)
        ids = ids[tree.order]
        kth = np.full(len(ids), _NONE)
        if sample is not None:
            found = np.where(ids[:, None] == sample[0][None, :], _NONE, products(tree.points, sample[1]))
            if found.shape[1] >= k:
                kth = np.partition(found, found.shape[1] - k, axis=1)[:, -k]
        return _row(tree, ids, kth, int(frame.part.iloc[0]))

    return trees


def _raised(groups: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
    """A group's tree with the kth scores that its queries have reached."""
    if not len(groups):
        return pd.DataFrame({"part": [], "chunk": [], "n": [], "payload": [], "summary": []})
    tree, ids, kth = pickle.loads(groups.payload.iloc[0])
    kth, at = kth.copy(), pd.Index(ids).get_indexer(reached.query_id)
    kth[at] = np.maximum(kth[at], reached.score.to_numpy())
    return _row(tree, ids, kth, int(groups.part.iloc[0]))


def _survivors(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a group and a block whose bound reaches the group's worst kth score, and the centres' inner product."""
    if not len(groups) or not len(blocks):
        return pd.DataFrame({"grp": np.empty(0, np.int64), "block": np.empty(0, np.int64), "near": np.empty(0)})
    a, b = ([pickle.loads(x) for x in side.summary] for side in (groups, blocks))
    wide = max(len(x[0]) for x in a + b)
    stack = lambda side: (np.array([np.pad(x[0], (0, wide - len(x[0]))) for x in side]), np.array([x[1] for x in side]), np.array([x[2] for x in side]), np.array([x[3] for x in side]))
    p, q = stack(a), stack(b)
    g, d = np.nonzero(bounds(p, q) >= np.array([x[4] for x in a])[:, None])
    return pd.DataFrame({"grp": groups.part.to_numpy()[g], "block": blocks.part.to_numpy()[d], "near": (p[0] @ q[0].T)[g, d]})


def _surviving(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Summaries meet chunk by chunk."""
    chunks = lambda trees: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees.agg(F.max("chunk")).first()[0] or 0).cast("long")))
    left = groups.select("part", "summary", F.col("chunk").alias("g"), chunks(blocks).alias("b"))
    right = blocks.select("part", "summary", F.col("chunk").alias("b"), chunks(groups).alias("g"))
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(_survivors, _PAIR)


def _searched(k: int):
    """A block against a lot of groups; ``tested``, the number of scored pairs, is in a row of its own for each group, and -1 in results."""

    def searched(asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 5), np.int64)]
        if len(asked):
            data, data_ids, _ = pickle.loads(asked.asked.iloc[0])
            for x in asking.itertuples():
                queries, query_ids, kth = pickle.loads(x.asking)
                row, ids, scores, tested = search(queries, query_ids, data, data_ids, kth, k)
                out += [np.array([[x.grp, 0, 0, 0, tested]]), np.stack([np.full(len(row), x.grp), query_ids[row], ids, scores, np.full(len(row), -1)], 1)]
        return pd.DataFrame(np.concatenate(out), columns=["grp", "query_id", "vec_id", "score", "tested"])

    return searched


def _results(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int, name: str) -> DataFrame:
    """grp, query_id, vec_id, score (at most k rows of each pair's block for a query of its group) and tested, as a table."""
    n_groups, n_blocks = groups.count(), blocks.count()
    lots = max(1, -(-n_groups // LOT))
    pairs = pairs.select("grp", "block", F.pmod("grp", F.lit(lots)).alias("lot"))
    tasks = max(1, min(MOST_TASKS, n_blocks * lots))  # given, so the adaptive planner doesn't put all into few tasks
    asking = pairs.join(groups.select(F.col("part").alias("grp"), F.col("payload").alias("asking")), "grp").repartition(tasks, "block", "lot")
    met = pairs.select(F.col("block").alias("part"), F.col("lot").alias("of_lot")).distinct()
    asked = met.join(blocks.select("part", F.col("payload").alias("asked")), "part").repartition(tasks, "part", "of_lot")
    found = asking.groupBy("block", "lot").cogroup(asked.groupBy("part", "of_lot")).applyInPandas(_searched(k), "grp long, query_id long, vec_id long, score long, tested long")
    return written(found, name)


def candidates(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows among which are the k best of each query, as ``_results`` has them."""
    usable = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    data, queries = usable(data), usable(queries).groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    found = data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # bounded; steers the pruning only
    sample = (found.id.to_numpy(np.int64), matrix(found.vector))
    centres = [0]
    away = ((sample[1] - sample[1][:1]) ** 2).sum(1) if len(found) else np.empty(0)
    wanted = min(CENTRES, -(-data.count() // BLOCK))
    while len(centres) < wanted and away.max(initial=0) > 0:
        centres.append(int(away.argmax()))
        away = np.minimum(away, ((sample[1] - sample[1][centres[-1]]) ** 2).sum(1))
    centres = sample[1][centres] if len(found) else np.zeros((1, 1))
    blocks = written(_routed(data, centres, BLOCK).groupBy("part").applyInPandas(_trees(None, k), _TREE), "data-trees")
    groups = written(_routed(queries, centres, GROUP).groupBy("part").applyInPandas(_trees(sample, k), _TREE), "query-trees")
    nearest = written(_surviving(groups, blocks).groupBy("grp").agg(F.max_by("block", F.struct("near", "block")).alias("block")), "nearest-blocks")
    one = _results(nearest, groups, blocks, k, "nearest-results")
    reached = one.where("tested < 0").groupBy("grp", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    groups = written(groups.groupBy("part").cogroup(reached.select(F.col("grp").alias("part"), "query_id", "score").groupBy("part")).applyInPandas(_raised, _TREE), "raised-trees")
    rest = _surviving(groups, blocks).join(nearest, ["grp", "block"], "left_anti")
    return one.unionByName(_results(rest, groups, blocks, k, "other-results"))


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``data`` for each row of ``queries`` (id, vector)."""
    found = candidates(data, queries, k).where("tested < 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def scored_pairs(data: DataFrame, queries: DataFrame, k: int = 5) -> int:
    """How many inner products the search takes; what it prunes is the rest of queries times rows."""
    return candidates(data, queries, k).where("tested >= 0").agg(F.coalesce(F.sum("tested"), F.lit(0))).first()[0]
