"""Mixing sources to target weights by drawing fixed-length blocks of words.

Sources get weights by their order, share ``budget`` times all words, and stop at
twice their size; what is above is shared anew by weight until none is (a running
sum over the sources, ordered by where they stop, finds the level). Each source's
documents, in a pseudorandom order, are one stream of words, packed into blocks of
``block`` words. The output has shards of a fixed number of slots, a block each. For
each shard the number of slots of every source is a multinomial draw by the sources'
shares of the mix; a repair then moves the few slots by which the draws' sums miss
the sources' totals, so targets are met to half a block. The draw goes by pools of sources,
as many as the root of their number, and then within each pool, so neither the driver
nor a task holds all sources. The counts drawn number a
source's slots through the shards, and slot k takes block permutation[k mod blocks],
a keyed Feistel permutation that is walked into range: no block is taken more than
twice, and the draw is the same whenever it is repeated. Slots and blocks meet in a
join by (source, block index).

Edge cases: a null text has size 0 and is never taken; a null source is a source,
the last; a null doc_id is a document like others; repeated rows each have a place
in the stream; sources without words have target 0; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import cumulated, global_rank
from .common import words_of, written
from .hashing import scrambled

WEIGHTS, BUDGET, MOST, BLOCK = (3, 1, 2), 1.5, 2, 256
#: Slots of an output shard, and shards that are drawn in one task.
SHARD_SLOTS, SHARDS_DRAWN, SEED = 4096, 1024, 17
#: Slots that a task numbers, as long as there are no more tasks than this.
TASK_SLOTS, MOST_TASKS = 1 << 16, 20_000
_KEYS = np.random.default_rng(SEED).integers(0, 2**63, 4, np.uint64)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """sid, of_source, source_size, target, blocks and slots: a row for each source, numbered and summed by ranges of their order."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = global_rank(totals, [F.col("source").asc_nulls_last()], "place").select((F.col("place") - 1).cast("int").alias("sid"), "source", "source_size")
    at = at.select("*", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double").alias("w"))
    at = at.select("*", (MOST * F.col("source_size") / F.col("w")).alias("stop"), (MOST * F.col("source_size")).alias("most"))
    at = written(cumulated(at, [F.col("stop"), F.col("sid")], {"most": "most_before", "w": "w_before"}), "sources")
    sums = at.agg(F.sum("source_size").alias("whole"), F.sum("w").alias("w")).first()
    level = (budget * F.lit(sums.whole or 0) - F.col("most_before")) / F.greatest(F.lit(sums.w or 1.0) - F.col("w_before"), F.lit(1e-9))
    at = at.withColumn("level", level)
    found = at.where("level <= stop").agg(F.min(F.struct("stop", "sid", "level")).alias("x")).first().x
    target = F.least((F.lit(found.level) if found else F.col("stop")) * F.col("w"), F.col("most").cast("double"))
    at = at.select("sid", F.col("source").alias("of_source"), "source_size", target.alias("target"), F.ceil(F.col("source_size") / block).alias("blocks"))
    return at.select("*", F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))), F.lit(0)).cast("long").alias("slots"))


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1, applied to each k."""
    salt = np.uint64(key * 0x9E3779B97F4A7C15 & (2**64 - 1))
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        x = out[todo]
        a, b = x >> half, x & mask
        for r in _KEYS:
            a, b = b, a ^ (scrambled(b ^ salt ^ r) & mask)
        out[todo] = (a << half) | b
        todo = todo[out[todo] >= n]  # outside: walk on along the cycle
    return out.astype(np.int64)


def drawn(totals: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many slots of each source fall on each part: a multinomial draw for each part, repaired to the totals.

    ``totals`` has the slots of each source, ``sizes`` those of each part; both have
    the same sum. What the draws have too much of a source is given up by all parts in
    proportion, and the places so freed go, shuffled, to the sources that lack slots.
    """
    totals, sizes = np.asarray(totals, np.int64), np.asarray(sizes, np.int64)
    if not totals.sum():
        return np.zeros((len(sizes), len(totals)), np.int64)
    counts = np.stack([rng.multinomial(n, totals / totals.sum()) for n in sizes])
    over = counts.sum(0) - totals
    for s in np.flatnonzero(over > 0):
        upto = np.concatenate([[0], np.cumsum(counts[:, s])])
        given = upto * over[s] // upto[-1]
        counts[:, s] -= np.diff(given)
    lacking = rng.permutation(np.repeat(np.arange(len(totals)), np.maximum(-over, 0)))
    np.add.at(counts, (np.repeat(np.arange(len(sizes)), sizes - counts.sum(1)), lacking), 1)
    return counts


def _parts(slots: int, size: int) -> np.ndarray:
    """Sizes of as many full parts as there are, and of the rest."""
    return np.array([size] * (slots // size) + ([slots % size] if slots % size else []), np.int64)


def _pools_drawn(seed: int):
    """Over which groups of shards a pool's sources fall: for each group the sources with slots in it, their first slot, and their number."""

    def pools(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples():
                sid, slots, blocks = (np.array([s[c] for s in x.sources], np.int64) for c in ("sid", "slots", "blocks"))
                counts = drawn(slots, np.array(x.sizes, np.int64), np.random.default_rng([seed, 2, x.pool]))
                first = np.cumsum(counts, 0) - counts
                rows = [(g, x.pool, *(a.tolist() for a in (sid[met], blocks[met], counts[g, met], first[g, met]))) for g in range(len(counts)) for met in [np.flatnonzero(counts[g])] if len(met)]
                yield pd.DataFrame(rows, columns=["grp", "pool", "sids", "blocks", "slots", "first"])

    return pools


def _groups_drawn(shard_slots: int, seed: int):
    """A group's draw over its shards: how many slots of each of them fall on each pool."""

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g in frame.itertuples():
                totals = np.array(g.slots, np.int64)
                counts = drawn(totals, _parts(int(totals.sum()), shard_slots), np.random.default_rng([seed, 1, g.grp]))
                pools = np.flatnonzero(totals)
                yield pd.DataFrame({"grp": g.grp, "pool": pools, "sizes": [counts[:, p].tolist() for p in pools]})

    return groups


def _shares(seed: int):
    """A pool's draw over a group's shards: shard, sid, the source's first slot in it, and their number."""

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples():
                counts = drawn(np.array(x.slots, np.int64), np.array(x.sizes, np.int64), np.random.default_rng([seed, 3, x.grp, x.pool]))
                first = np.array(x.first, np.int64) + np.cumsum(counts, 0) - counts
                shard, at = np.nonzero(counts)
                yield pd.DataFrame({"sid": np.array(x.sids)[at], "blocks": np.array(x.blocks)[at], "shard": x.grp * SHARDS_DRAWN + shard, "first": first[shard, at], "n": counts[shard, at]})

    return shares


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        for x in frame.itertuples():
            for a in range(x.first, x.first + x.n, 100_000):
                k = np.arange(a, min(a + 100_000, x.first + x.n))
                epoch, within = np.divmod(k, x.blocks)
                block = np.empty(len(k), np.int64)
                for e in np.unique(epoch):
                    block[epoch == e] = permuted(within[epoch == e], x.blocks, 1 + 2 * x.sid + int(e))
                held.append((np.full(len(k), x.sid), np.full(len(k), x.shard), k, block))
                n += len(k)
                if n >= 100_000:
                    yield pd.DataFrame(dict(zip(("sid", "shard", "slot", "block"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
                    held, n = [], 0
    if held:
        yield pd.DataFrame(dict(zip(("sid", "shard", "slot", "block"), map(np.concatenate, zip(*held, strict=True)), strict=True)))


def slots_of(targets: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """sid, shard, slot, block: what each output shard holds, a row for each block in it.

    Shards have ``shard_slots`` slots, the last one what is left. The driver draws how
    many slots of each group of SHARDS_DRAWN shards fall on each pool of sources; a
    pool's sources are drawn over the groups, and a group's shards over the pools, in a task each, and both
    together say how many slots of a pool's sources each shard of a group has. A source's
    slots are numbered through all shards, so the counts drawn say which of its blocks
    a shard gets.
    """
    spark = targets.sparkSession
    pools = max(1, math.isqrt(max(0, targets.count() - 1)) + 1)
    of_pool = targets.where("slots > 0").withColumn("pool", F.col("sid") % pools)
    found = {r.pool: r.n for r in of_pool.groupBy("pool").agg(F.sum("slots").alias("n")).collect()}  # the root of the sources' number
    totals = np.array([found.get(p, 0) for p in range(pools)], np.int64)
    sizes = _parts(int(totals.sum()), shard_slots * SHARDS_DRAWN)
    groups = drawn(totals, sizes, np.random.default_rng([seed, 0])) if len(sizes) else np.zeros((0, pools), np.int64)
    by_pool = spark.createDataFrame([(p, g) for p, g in enumerate(groups.T.tolist())], "pool int, sizes array<long>")
    by_group = spark.createDataFrame(list(enumerate(groups.tolist())), "grp long, slots array<long>")
    members = of_pool.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("sid", "slots", "blocks"))).alias("sources"))
    lists = ", ".join(f"{c} array<long>" for c in ("sids", "blocks", "slots", "first"))
    sides = members.join(by_pool, "pool").mapInPandas(_pools_drawn(seed), f"grp long, pool int, {lists}"), by_group.mapInPandas(_groups_drawn(shard_slots, seed), "grp long, pool int, sizes array<long>")
    shares = sides[0].join(sides[1], ["grp", "pool"]).mapInPandas(_shares(seed), "sid int, blocks long, shard long, first long, n long")
    # a number of partitions that is given isn't lessened by the adaptive planner
    tasks = max(1, min(MOST_TASKS, -(-int(totals.sum()) // TASK_SLOTS)))
    return shares.repartition(tasks, "shard", "sid").mapInPandas(_slots, "sid int, shard long, slot long, block long")


def row_key() -> Column:
    """What orders a source's stream, and with doc_id stands for a row."""
    return F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def placed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the sources.

    The order in a source is by hash, and by the row where rows are equal. A place is the
    sum of all lower ranges of that order, a row each, and of the lower rows of the same range, so no
    task orders a whole source, or all equal rows.
    """
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), row_key().alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    targets = written(source_targets(sized, block=block), "targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "key", "size", "row", "sid", "source_size", "target")
    return cumulated(rows, [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")], {"size": "start"}, ("sid",)).drop("row"), targets


def _spans(rows: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that holds words of it: at and n, the first word and the number of words."""
    last = F.col("start") + F.col("size") - 1
    spans = rows.where("size > 0").select("doc_id", "key", "size", "sid", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block"))
    a, b = F.greatest("start", F.col("block") * block), F.least(last + 1, (F.col("block") + 1) * block)
    return spans.select("*", (a - F.col("start")).cast("int").alias("at"), (b - a).cast("int").alias("n"))


def taken_pieces(rows: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The spans of documents in blocks that are taken, with the shards, at most two, that hold the block."""
    uses = slots.groupBy("sid", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    return _spans(rows, block).join(uses.hint("merge"), ["sid", "block"]).drop("block")  # both sides grow with the input: neither is broadcast


def mixed_sizes(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard (the least that holds words of it) of every document."""
    rows, targets = placed(docs, block)
    same = ["doc_id", "key", "size", "sid", "start"]
    pieces = taken_pieces(rows, slots_of(targets, shard_slots, seed), block).select(*same, (F.col("n") * F.size("shards")).alias("taken"), F.col("shards")[0].alias("shard"))
    none = rows.select(*same, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("shard"))
    # every document with words has a row of its own here, so no outer join is needed; rows without words may be equal
    sums = pieces.unionByName(none.where("size > 0")).groupBy(*same).agg(F.sum("taken").alias("taken"), F.min("shard").alias("shard"))
    taken = sums.unionByName(none.where("size = 0"))
    of = targets.select(F.col("sid").alias("t_sid"), "source_size", "target")
    return taken.join(of, F.col("sid") == F.col("t_sid")).select("doc_id", "size", "source_size", "target", "taken", F.col("shard").alias("first_shard"))


def _texts(docs: DataFrame) -> DataFrame:
    """What row_key stands for, once; equal rows share the least lang."""
    columns = ("doc_id", "text", "lang", "source")
    return docs.select(*columns, row_key().alias("text_key")).groupBy("text_key", "doc_id").agg(*[F.min(c).alias(c) for c in columns[1:]])


def _of_text():
    return (F.col("key") == F.col("text_key")) & F.col("of_doc").eqNullSafe(F.col("doc_id"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The documents' columns after mixing and shard: a row for each time that words of a document are taken.

    A document that is taken whole keeps its text; one that is taken in part has
    the taken words in order, joined by a space; shard is the least that holds some of
    them. Rows that are equal in doc_id, source and text are as many places in the
    stream, and share the least lang.
    """
    rows, targets = placed(docs, block)
    pieces = taken_pieces(rows, slots_of(targets, shard_slots, seed), block).groupBy("doc_id", "key", "size", "start").agg(F.sort_array(F.collect_list(F.struct("at", "n", "shards"))).alias("pieces"))
    taken = pieces.select(F.col("doc_id").alias("of_doc"), "key", "size", "pieces").join(_texts(docs), _of_text())
    taken = taken.select("doc_id", "text", "lang", "source", "size", "pieces", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("pieces", lambda p: F.size(p["shards"]))) - 1)).alias("time"))
    taken = taken.withColumn("now", F.filter("pieces", lambda p: F.size(p["shards"]) > F.col("time")))
    shard = F.array_min(F.transform("now", lambda p: F.get(p["shards"], F.col("time"))))
    taken = taken.withColumn("n_taken", F.aggregate("now", F.lit(0), lambda a, p: a + p["n"])).withColumn("words", words_of(F.col("text")))
    part = F.array_join(F.flatten(F.transform("now", lambda p: F.slice(F.col("words"), p["at"] + 1, p["n"]))), " ")
    taken = taken.select("doc_id", F.when(F.col("n_taken") == F.col("size"), F.col("text")).otherwise(part).alias("text"), "lang", "source", shard.alias("shard"))
    return taken.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "shard")


def write_shards(docs: DataFrame, folder: str, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
    """Writes the mix below ``folder``, in the order of its shards: shard, slot of the source, source, doc_id, at, and the block's words of that document.

    A shard's rows are together in one file; a block of several documents has a row for each.
    """
    rows, targets = placed(docs, block)
    held = _spans(rows, block).join(slots_of(targets, shard_slots, seed).hint("merge"), ["sid", "block"]).withColumnRenamed("doc_id", "of_doc")
    words = F.array_join(F.slice(words_of(F.col("text")), F.col("at") + 1, F.col("n")), " ")
    shown = held.join(_texts(docs), _of_text()).select("shard", "slot", "source", "doc_id", "start", "at", words.alias("words"))
    shown.repartitionByRange("shard").sortWithinPartitions("shard", "source", "slot", "start").drop("start").write.parquet(folder)
