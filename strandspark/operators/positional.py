"""A stored positional index of texts, and ranks by cover density that read only its postings.

Building cuts every text once. Documents are put in order of their length and cut into
blocks of bounded size, so that a block's documents are alike. A row of the postings has
a term and a block, and lists: the places in the block of the documents that have the term, how often
each has it, and all its positions, document by document. The row of the empty term lists the
block's documents. The table is bucketed by block, so a block's postings meet the
queries that want the block without a shuffle of the table. A second, small table has for each term
and block the greatest number of a document's positions.

A document's rank for a query that wants all its terms is the sum over covers, the
shortest spans that hold all terms, of 0.1 / (1 + words of the span that aren't the query's).
For a query that wants any of its terms each position is a span of its own. Both are
``ts_rank_cd`` with the default weight and no normalization.

A rank has an upper bound from the numbers of positions alone, so each block has one from its maxima.
The k best documents of a query are first sought in the blocks of greatest bounds; the
kth rank found there leaves out all blocks whose bound is lower. The result is exact. Blocks return
their k best documents of a query, or counts, so no list of all matches is shuffled.

Edge cases: null texts have no terms; queries without terms, or with a term that no text has
where all are wanted, have no rows; documents of equal rank come by id; a null id takes no part; rows under a
repeated id are told apart by their place in the block, and appear as often.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.snowball import STOP_WORDS, english_stem
from ..staging import written

#: Documents and words of a block at most, blocks of each query that are searched first, queries that visit the blocks at a time, and characters of a bucket.
BLOCK, BLOCK_WORDS, FIRST, LOT, BUCKET_CHARS = 4_096, 1 << 20, 4, 2_048, 32 << 20
WEIGHT = 0.1
MODES = ("all", "any")
#: Counts of a few texts for all queries of a lot that are held at a time.
COUNTS = 1 << 20
_WORDS = re.compile("[a-z0-9_]+").findall
_POSTING = "term string, block long, ids array<long>, grps array<long>, docs array<int>, ns array<int>, ats array<int>"


def lexemes_of(text: str | None, config: str) -> dict[str, list[int]]:
    """Each lexeme's positions, from 1; every word counts for positions, also stop words, which are no lexemes."""
    found: dict[str, list[int]] = {}
    for at, word in enumerate(_WORDS((text or "").lower()), 1):
        if config == "english":
            if word in STOP_WORDS:
                continue
            word = english_stem(word)
        found.setdefault(word, []).append(at)
    return found


class _Codes(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _block_rows(block: int, ids: list, grps: list, words: list[np.ndarray], codes: _Codes, config: str) -> pa.RecordBatch:
    """A block's rows: its documents under the empty term, and the postings of each lexeme."""
    terms = list(codes)
    if config == "english":
        lexeme = _Codes()
        of = np.array([-1 if t in STOP_WORDS else lexeme[english_stem(t)] for t in terms], np.int32)
        terms = list(lexeme)
    else:
        of = np.arange(len(terms), dtype=np.int32)
    code = of[np.concatenate(words)] if len(of) else np.empty(0, np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [*map(len, words)])
    at = np.concatenate([np.arange(1, len(w) + 1, dtype=np.int32) for w in words])
    order = np.argsort(code, kind="stable")
    order = order[np.searchsorted(code[order], 0) :]  # without stop words
    code, doc, at = code[order], doc[order], at[order]
    posting = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)])
    term = np.flatnonzero(np.append(True, code[posting][1:] != code[posting][:-1])[: len(posting)])
    first, place = np.append(posting, len(code)), np.append(term, len(posting))
    lists = lambda head, offsets, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], head + offsets]), pa.int32()), pa.array(values, kind))
    none = np.zeros(len(term) + 1, np.int64)
    columns = [
        pa.array(["", *(terms[c] for c in code[posting][term].tolist())], pa.string()), pa.array(np.full(len(term) + 1, block), pa.int64()), lists(len(ids), none, ids, pa.int64()), lists(len(ids), none, grps, pa.int64()),
        lists(0, place, doc[posting], pa.int32()), lists(0, place, np.diff(first), pa.int32()), lists(0, first[place], at, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "ids", "grps", "docs", "ns", "ats"])


def _postings(config: str, most: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, grps, words, codes, n = TaskContext.get().partitionId() << 32, [], [], [], _Codes(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64).to_pydict()
                for i, grp, text in zip(part["id"], part["grp"], part["text"], strict=True):
                    words.append(np.array([codes[w] for w in _WORDS((text or "").lower())], np.int32))
                    ids.append(i), grps.append(grp)
                    n += len(words[-1])
                    if len(ids) >= most or n >= BLOCK_WORDS:
                        yield _block_rows(block, ids, grps, words, codes, config)
                        block, ids, grps, words, codes, n = block + 1, [], [], [], _Codes(), 0
        if ids:
            yield _block_rows(block, ids, grps, words, codes, config)

    return postings


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up, as Spark and SQL have it; what is near a half is rounded by its decimal digits."""
    out = np.floor(x * 1e6 + 0.5) / 1e6
    half = np.flatnonzero(np.abs(x * 1e6 - np.floor(x * 1e6) - 0.5) < 1e-3)
    if len(half):
        values, to = np.unique(x[half], return_inverse=True)
        out[half] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values.tolist()])[to]
    return out


def cover_ranks(doc: np.ndarray, at: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's sum of 0.1 / (1 + noise) over the covers of ``n_terms`` terms (from 0); places are in order of document and ``at``.

    The earliest of the latest places of all terms begins the shortest span that ends at a place; if that begin is new, the span is a cover.
    """
    i = np.arange(len(doc))
    opens = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    first = np.maximum.accumulate(np.where(opens, i, 0))
    least = i
    for t in range(n_terms):
        least = np.minimum(least, np.maximum.accumulate(np.where(term == t, i, -1)))
    least = np.where(least >= first, least, -1)
    before = np.where(opens, -1, np.append(-1, least[:-1])[: len(doc)])
    new = np.flatnonzero((least >= 0) & (least != before))
    noise = at[new] - at[least[new]] - (new - least[new])
    return np.bincount(doc[new], weights=WEIGHT / (1 + noise), minlength=n_docs)


class _Block:
    """A block's documents and the postings of the terms that are asked for."""

    def __init__(self, rows: pa.Table, scope: tuple[int, ...] | None):
        self.row = {t: i for i, t in enumerate(rows["term"].to_pylist())}
        head = rows.slice(self.row.pop(""), 1)
        self.ids, self.grps = (head[c].combine_chunks().flatten() for c in ("ids", "grps"))
        self.id = self.ids.to_numpy()
        self.allowed = None if scope is None else pc.is_in(self.grps, value_set=pa.array(scope, pa.int64())).to_numpy(zero_copy_only=False)
        lists = {c: rows[c].combine_chunks() for c in ("docs", "ns", "ats") if c in rows.column_names}
        self.first = lists["docs"].offsets.to_numpy()
        self.docs, self.ns = lists["docs"].values.to_numpy(), lists["ns"].values.to_numpy()
        if "ats" in lists:
            self.ats, self.begin = lists["ats"].values.to_numpy(), np.cumsum(self.ns, dtype=np.int64) - self.ns

    def any(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and ranks of the documents that have any of the terms."""
        spans = [slice(self.first[i], self.first[i + 1]) for i in map(self.row.get, terms) if i is not None]
        if not spans:
            return np.empty(0, np.int64), np.empty(0)
        total = np.bincount(np.concatenate([self.docs[x] for x in spans]), weights=np.concatenate([self.ns[x] for x in spans]), minlength=len(self.id))
        if self.allowed is not None:
            total *= self.allowed
        hits = np.flatnonzero(total)
        return hits, _rounded(WEIGHT * total[hits])

    def all(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and ranks of the documents that have all of the terms; the rarest is looked at first."""
        none = np.empty(0, np.int64), np.empty(0)
        if not all(t in self.row for t in terms):
            return none
        spans = sorted(((self.first[self.row[t]], self.first[self.row[t] + 1]) for t in terms), key=lambda x: x[1] - x[0])
        hits = self.docs[spans[0][0] : spans[0][1]]
        if self.allowed is not None:
            hits = hits[self.allowed[hits]]
        for a, b in spans[1:]:
            if not len(hits):
                return none
            held = self.docs[a:b]
            hits = hits[held[np.minimum(np.searchsorted(held, hits), b - a - 1)] == hits]
        if not len(hits):
            return none
        doc, at, term = [], [], []
        for t, (a, b) in enumerate(spans):
            posting = a + np.searchsorted(self.docs[a:b], hits)
            n = self.ns[posting]
            ends = np.cumsum(n, dtype=np.int64)
            at.append(self.ats[np.repeat(self.begin[posting] - ends + n, n) + np.arange(ends[-1])])
            doc.append(np.repeat(np.arange(len(hits)), n))
            term.append(np.full(ends[-1], t))
        doc, at, term = np.concatenate(doc), np.concatenate(at), np.concatenate(term)
        order = np.lexsort((at, doc))
        return hits, _rounded(cover_ranks(doc[order], at[order], term[order], len(hits), len(terms)))


def _visited(mode: str, scope: tuple[int, ...] | None, chosen: Callable):
    """What ``chosen(block, places, ranks, query)`` makes of the matches of each query that wants a block."""

    def visit(postings: pa.Table, wanted: pa.Table) -> list:
        out = []
        if postings.num_rows and wanted.num_rows:
            block = _Block(postings, scope)
            for q in wanted.to_pylist():
                hits, ranks = getattr(block, mode)(q["terms"])
                if len(hits):
                    out.append(chosen(block, hits, ranks, q))
        return out

    return visit


class TextIndex:
    """Two catalog tables, ``name_postings`` and ``name_blocks``; ``english`` lexemes are stems, ``simple`` ones the lower-case words."""

    def __init__(self, spark: SparkSession, name: str, config: str = "english"):
        if config not in ("english", "simple"):
            raise ValueError("config must be english or simple")
        self.spark, self.name, self.config = spark, name, config

    @property
    def packed(self) -> DataFrame:
        """The stored rows: a term's postings in a block, as lists; under the empty term the block's documents."""
        return self.spark.table(f"{self.name}_postings")

    @property
    def postings(self) -> DataFrame:
        """term, block, id, grp and n of each posting."""
        heads = self.packed.where("term = ''").select("block", "ids", "grps")
        each = self.packed.where("term <> ''").select("term", "block", F.inline(F.arrays_zip("docs", "ns")))
        return each.join(heads, "block").select("term", "block", F.get("ids", F.col("docs")).alias("id"), F.get("grps", F.col("docs")).alias("grp"), F.col("ns").alias("n"))

    @property
    def blocks(self) -> DataFrame:
        return self.spark.table(f"{self.name}_blocks")

    def build(self, docs: DataFrame, folder: str | None = None, buckets: int | None = None, block: int = BLOCK) -> TextIndex:
        """Writes both tables over ``docs`` (id, grp, text), below ``folder`` if one is given; tables of that name are replaced."""
        place = lambda w, kind: w.option("path", f"{folder}/{kind}") if folder else w
        length = F.length(F.coalesce("text", F.lit("")))
        rows = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), "text")
        if not buckets:
            chars = rows.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
            buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
        order = [length, F.col("id"), F.xxhash64("text")]
        rows = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
        found = rows.mapInArrow(_postings(self.config, block), _POSTING)  # a task's blocks are whole, so they are written where they are made
        place(found.write, "postings").bucketBy(buckets, "block").mode("overwrite").saveAsTable(f"{self.name}_postings")
        held = self.packed.where("term <> ''").select("term", "block", F.array_max("ns").alias("most"), F.size("ns").cast("long").alias("n_docs"))
        place(held.write, "blocks").mode("overwrite").saveAsTable(f"{self.name}_blocks")
        return self

    def drop(self) -> None:
        for kind in ("postings", "blocks"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, its number in the query and m, how many the query has."""
        config = self.config

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(q, term, i, len(found)) for q, text in zip(frame.query_id, frame.text, strict=True) for found in [sorted(lexemes_of(text, config))] for i, term in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=["query_id", "term", "number", "m"])

        return written(queries.select("query_id", "text").mapInPandas(cut, f"query_id {queries.schema['query_id'].dataType.simpleString()}, term string, number int, m int"), "asked")

    def _bounds(self, asked: DataFrame, mode: str) -> DataFrame:
        """query_id, block, and the bound of what a document of the block can reach."""
        met = asked.join(self.blocks, "term").groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"), F.sum("most").alias("total"), F.min("most").alias("least"))
        if mode == "any":
            return met.select("query_id", "block", (WEIGHT * F.col("total")).alias("bound"))
        # of n places at most n - m + 1 end a cover, and one place is in at most m covers
        covers = F.when(F.col("m") == 1, F.col("total")).otherwise(F.least(F.col("total") - F.col("m") + 1, F.col("m") * F.col("least")))
        return met.where("n = m").select("query_id", "block", (WEIGHT * covers).alias("bound"))

    def _in_blocks(self, pairs: DataFrame, asked: DataFrame, mode: str, scope: tuple[int, ...] | None, chosen: Callable, schema: str) -> DataFrame:
        """The rows that ``chosen`` returns for each query and block of ``pairs`` (query_id, block, and what else it needs), lot by lot of the queries.

        Each block is one group, with its postings of the lot's terms; the table stays where it lies.
        """
        if mode not in MODES:
            raise ValueError("mode must be all or any")
        terms = written(asked.groupBy("query_id").agg(F.collect_list("term").alias("terms")), "query-terms")
        n, out = max(1, -(-terms.count() // LOT)), None
        columns = ["term", "block", "ids", "grps", "docs", "ns", *(["ats"] if mode == "all" else [])]
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {schema}"
        kinds = to_arrow_schema(StructType.fromDDL(schema))
        visit = _visited(mode, scope, chosen)

        def found(postings: pa.Table, wanted: pa.Table) -> pa.Table:
            parts = [pa.table([pa.array([q] * len(x[0]), kinds.field(0).type), *(pa.array(c, f.type) for c, f in zip(x, list(kinds)[1:], strict=True))], schema=kinds) for q, x in visit(postings, wanted)]
            return pa.concat_tables(parts) if parts else kinds.empty_table()

        for i in range(n):
            lot = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
            wanted = pairs.join(lot, "query_id")
            names = lot.select(F.explode("terms").alias("term")).unionByName(self.spark.range(1).select(F.lit("").alias("term"))).distinct()
            held = self.packed.select(*columns).join(F.broadcast(names), "term", "left_semi")  # the terms of a lot of bounded size
            rows = held.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(found, schema)
            out = rows if out is None else out.unionByName(rows)
        return out

    def ranked_in(self, pairs: DataFrame, asked: DataFrame, mode: str, scope: tuple[int, ...] | None, k: int | None = None) -> DataFrame:
        """query_id, id, grp and score of all matches in the given blocks of each query, or of each block's ``k`` best."""

        def best(block: _Block, hits: np.ndarray, ranks: np.ndarray, q: dict):
            if k is not None and len(hits) > k:
                some = np.flatnonzero(ranks >= np.partition(ranks, -k)[-k])
                some = some[np.lexsort((block.id[hits[some]], -ranks[some]))[:k]]
                hits, ranks = hits[some], ranks[some]
            return q["query_id"], (block.ids.take(pa.array(hits)), block.grps.take(pa.array(hits)), ranks)

        return self._in_blocks(pairs.select("query_id", "block"), asked, mode, scope, best, "id long, grp long, score double")

    def top_k(self, queries: DataFrame, k: int, mode: str = "all", scope: tuple[int, ...] | None = None) -> DataFrame:
        """query_id, rank, id, grp and score of the k best documents of each query (query_id, text); documents of groups outside ``scope`` are left out first."""
        return self._ranked(queries, k, mode, scope)[0]

    def searched_share(self, queries: DataFrame, k: int, mode: str = "all") -> float:
        """Of all pairs of a query and a block that may match it, the share whose postings are read."""
        _, first, rest, bounds = self._ranked(queries, k, mode, None)
        return (first.count() + rest.count()) / max(1, bounds.count())

    def gold_ranks(self, queries: DataFrame, gold: DataFrame, mode: str = "all") -> DataFrame:
        """query_id, n_candidates and gold_rank: where the best gold document (query_id, id) stands among all that match; null if none does.

        Ranks are counted, not sorted: how many candidates have a greater score, or an equal one and a smaller id.
        """
        asked = self.asked(queries)
        pairs = written(self._bounds(asked, mode).select("query_id", "block"), "all-pairs")
        golds = gold.where("id IS NOT NULL").groupBy("query_id").agg(F.collect_set(F.col("id").cast("long")).alias("golds"))

        def of_gold(block: _Block, hits: np.ndarray, ranks: np.ndarray, q: dict):
            some = np.isin(block.id[hits], q["golds"])
            return q["query_id"], (block.id[hits[some]], ranks[some])

        def counted(block: _Block, hits: np.ndarray, ranks: np.ndarray, q: dict):
            before = None if q["score"] is None else int(((ranks > q["score"]) | ((ranks == q["score"]) & (block.id[hits] < q["id"]))).sum())
            return q["query_id"], ([len(hits)], [before])

        scores = self._in_blocks(pairs.join(golds, "query_id"), asked, mode, None, of_gold, "id long, score double")
        best = written(scores.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("g")).select("query_id", "g.score", (-F.col("g.id")).alias("id")), "gold-scores")
        each = self._in_blocks(pairs.join(best, "query_id", "left"), asked, mode, None, counted, "n long, before long")
        counts = each.groupBy("query_id").agg(F.sum("n").alias("n_candidates"), (F.sum("before") + 1).alias("gold_rank"))
        return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "gold_rank")

    def _ranked(self, queries: DataFrame, k: int, mode: str, scope: tuple[int, ...] | None):
        if mode not in MODES:
            raise ValueError("mode must be all or any")
        asked = self.asked(queries)
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        bounds = written(self._bounds(asked, mode).withColumn("place", F.row_number().over(order)), "bounds")
        first = bounds.where(F.col("place") <= FIRST)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        some = written(self.ranked_in(first, asked, mode, scope, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first-blocks")
        kth = some.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        # an equal rank in another block may have a smaller id; ranks are rounded
        rest = bounds.where(F.col("place") > FIRST).join(kth, "query_id", "left").where("kth IS NULL OR bound >= kth - 0.000001").select("query_id", "block")
        both = some.drop("rank").unionByName(self.ranked_in(rest, asked, mode, scope, k))
        found = both.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
        return found.select("query_id", "rank", "id", "grp", "score"), first, rest, bounds


def counted_terms(lot: pd.DataFrame, k: int):
    """A task's k documents with most distinct terms of each query of a lot, ties by id: (query_id, id, n_terms)."""
    of_term: dict[str, list[int]] = {}
    for i, text in enumerate(lot.text):
        for term in lexemes_of(text, "simple"):
            of_term.setdefault(term, []).append(i)
    of_term = {t: np.array(x) for t, x in of_term.items()}
    query_ids = lot.query_id.to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # query, count, id
        worst = np.zeros(len(query_ids), np.int64)
        texts = max(1, min(256, COUNTS // max(1, len(query_ids))))
        for batch in batches:
            for a in range(0, batch.num_rows, texts):  # of a batch a few texts at a time, read where they lie
                part = batch.slice(a, texts)
                counts = np.zeros((part.num_rows, len(query_ids)), np.int64)
                for row, text in zip(counts, part.column("text"), strict=True):
                    if x := [of_term[t] for t in set(_WORDS((text.as_py() or "").lower())) if t in of_term]:
                        row += np.bincount(np.concatenate(x), minlength=len(query_ids))
                doc, query = np.nonzero(counts >= np.maximum(worst, 1))
                query, n, ids = (np.concatenate(x) for x in zip(held, (query, counts[doc, query], part.column("id").to_numpy()[doc]), strict=True))
                order = np.lexsort((ids, -n, query))
                query, n, ids = query[order], n[order], ids[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                worst[query[place == k - 1]] = n[place == k - 1]
                held = [x[place < k] for x in (query, n, ids)]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[held[0]], pa.int64()), pa.array(held[2], pa.int64()), pa.array(held[1], pa.int64())], ["query_id", "id", "n_terms"])

    return best
