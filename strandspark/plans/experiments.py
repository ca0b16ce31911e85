"""Registered experiment and answer queries and their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ann, answers, fulltext, graph, retrieval
from ..operators import tables as tb
from ..staging import written
from .common import Query, table
from .retrieval import _TERMS, _batch, _batch_sql, _chunks
from .tables import _versions

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def q_collapse_experiment(spark, sf_dir):
    """Hits gained and lost when the first five chunks become the first five threads."""
    found = _batch(spark, sf_dir, 30)
    hit = lambda rows, name: rows.groupBy("query_id").agg(F.max((F.col("grp") == F.col("query_group")).cast("int")).alias(name))
    both = hit(found.where("rank <= 5"), "before").join(hit(retrieval.collapsed(found, ("grp",), 5, within=("query_id",)), "after"), "query_id")
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_collapse_experiment"] = f"""
WITH {_batch_sql(30)},
a AS (SELECT query_id, any_value(query_group) AS query_group, grp, min(rank) AS rank FROM b GROUP BY query_id, grp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) <= 5),
x AS (SELECT query_id, max((grp = query_group)::int) AS before FROM b WHERE rank <= 5 GROUP BY 1), y AS (SELECT query_id, max((grp = query_group)::int) AS after FROM a GROUP BY 1)
SELECT before, after, count(*) AS n FROM x JOIN y USING (query_id) GROUP BY ALL"""


def q_index_recall(spark, sf_dir):
    """Recall of the exact five nearest, and the share of rows that are scored, by the depth of a search in small-world graphs."""
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where("id % 20 = 0")
    exact = _batch(spark, sf_dir, 5).select("query_id", "id")
    graphs = graph.build(chunks)
    found = written(graph.swept(graphs, asked, 5, (40, 100, 200, 400)), "found")
    best = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("depth", "query_id").orderBy(F.col("similarity").desc(), "id"))).where("rank <= 5")
    hits = best.join(exact, ["query_id", "id"]).groupBy("depth").agg(F.count(F.lit(1)).alias("hits"))
    pairs = asked.agg(F.count(F.lit(1))).scalar() * graphs.agg(F.sum("n")).scalar()
    share = found.where("scored IS NOT NULL").groupBy("depth").agg(F.sum("scored").alias("scored"))
    return hits.join(share, "depth").select("depth", "hits", F.round(F.col("hits") / exact.agg(F.count(F.lit(1))).scalar(), 6).alias("recall"), F.round(F.col("scored") / pairs, 6).alias("scored_share"))


def q_cell_recall(spark, sf_dir):
    """Recall of the exact five nearest by the number of cells that are probed."""
    chunks = _chunks(spark, sf_dir).select("id", "vector")
    asked = chunks.where("id % 20 = 0")
    exact = _batch(spark, sf_dir, 5).select("query_id", "id")
    depths = [ann.probed_top_k(chunks, asked, 5, p).select("query_id", "id", F.lit(p).alias("probes")) for p in (4, 16, 48, ann.CELLS)]
    found = reduce(lambda a, b: a.unionByName(b), depths)
    hits = found.join(exact, ["query_id", "id"]).groupBy("probes").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select("probes", "hits", F.round(F.col("hits") / exact.agg(F.count(F.lit(1))).scalar(), 6).alias("recall"))


def q_replay_noop(spark, sf_dir):
    """A second upsert of the same rows changes nothing."""
    old, new = _versions(spark, sf_dir)
    once = tb.upserted(old, new, ("doc_id",), ("lang", "hash"))
    return tb.upsert_actions(once, new, ("doc_id",), ("lang", "hash")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_replay_noop"] = "SELECT CASE WHEN doc_id % 11 <> 2 THEN 'noop' ELSE 'keep' END AS action, count(*) AS n FROM documents WHERE doc_id % 11 <> 2 OR doc_id % 7 <> 1 GROUP BY 1"


def q_term_lists(spark, sf_dir):
    """Ordered list of each question's distinct terms, and the longest text in bytes."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array_distinct(fulltext.terms(F.col("text")))).alias("term"))
    return asked.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " | ").alias("terms"), F.max(F.octet_length("text")).cast("long").alias("bytes"))


ORACLE_SQL["q_term_lists"] = f"SELECT item_id, array_to_string(list_sort(list_distinct({_TERMS})), ' | ') AS terms, strlen(text) AS bytes FROM benchmark WHERE len({_TERMS}) > 0"


def q_numbers_in_both_folds(spark, sf_dir):
    """Keys that occur with exactly two values of another column."""
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("number"), "quality", "toxic")
    return labels.groupBy("number").agg(F.count_distinct("quality").alias("kinds"), F.count_distinct(F.struct("quality", "toxic")).alias("pairs")).where("kinds = 2")


ORACLE_SQL["q_numbers_in_both_folds"] = "SELECT doc_id % 50 AS number, count(DISTINCT quality) AS kinds, count(DISTINCT (quality, toxic)) AS pairs FROM labels GROUP BY 1 HAVING count(DISTINCT quality) = 2"


def q_prompt_room(spark, sf_dir):
    """The common excerpt length that lets a conversation's turns fit into 300 characters."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce(F.length("text"), F.lit(0))).alias("lengths"))
    return turns.select("conv_id", answers.common_length(F.col("lengths"), 20 * F.size("lengths"), 300).alias("length"), F.size("lengths").cast("long").alias("n"))


ORACLE_SQL["q_prompt_room"] = """
WITH t AS (SELECT conv_id, list(coalesce(length(text), 0)) AS l, 300 - 20 * count(*) AS room, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN room >= 0 THEN list_max(list_filter(range(0, list_max(l) + 1), lambda n: list_sum(list_transform(l, lambda x: least(x, n))) <= room))::int END AS length, n FROM t"""


def _answers(spark, sf_dir):
    """Assistant turns as answers, the five turns before each of them as its evidence."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    at = table(spark, sf_dir, "conversations").withColumn("chunks", F.collect_list(F.coalesce("text", F.lit(""))).over(before)).where("role = 'assistant'")
    return at.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" [1]")).alias("answer"), "chunks")


def q_generation_metrics(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    return rows.select("conv_id", "turn", answers.generation_metrics(F.col("answer"), F.col("chunks"), F.lit(False)).alias("m")).select("conv_id", "turn", "m.*")


def q_finalize_answers(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    final = answers.finalized(F.col("answer"), F.col("chunks"), "[INSUFFICIENT]", "There is not enough evidence.")
    return rows.select("conv_id", "turn", F.md5(final).alias("h"), answers.answer_state(F.col("answer"), F.lit(False)).alias("state"))


QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
