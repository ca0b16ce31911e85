"""Registered retrieval queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import clamped, cosine_to
from ..operators import fulltext, retrieval
from ..operators.ordering import global_rank
from ..staging import spread
from .common import Query, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = EngineConfig()


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("vector"))


def _query(spark, sf_dir: str) -> list[float]:
    """One known row stands for the embedded question."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


_SIM = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9)"
_FROM = "embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def q_vector_topk(spark, sf_dir):
    top = retrieval.vector_top_k(_chunks(spark, sf_dir), _query(spark, sf_dir), 10, F.col("grp").isin(0, 1, 2, 3, 4))
    return top.select(F.col("id").alias("vec_id"), F.col("grp").cast("int").alias("label"), "similarity")


QUERIES["q_vector_topk"] = q_vector_topk
ORACLE_SQL["q_vector_topk"] = f"SELECT vec_id, label, {_SIM} AS similarity FROM {_FROM} WHERE label IN (0, 1, 2, 3, 4) AND e.embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 10"


def q_vector_topk_join(spark, sf_dir):
    """Inner join with the parent; the optional child's predicates are applied before the outer join."""
    top = retrieval.vector_top_k(_chunks(spark, sf_dir), _query(spark, sf_dir), 20)
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey")).alias("rk"), "r_name")
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 15").groupBy("n_regionkey").agg(F.min("n_name").alias("first_nation"))
    joined = top.join(region, F.col("grp") % 5 == F.col("rk")).join(nation.where("n_regionkey <> 2"), F.col("rk") == F.col("n_regionkey"), "left")
    return joined.select(F.col("id").alias("vec_id"), "similarity", "r_name", "first_nation")


QUERIES["q_vector_topk_join"] = q_vector_topk_join
ORACLE_SQL["q_vector_topk_join"] = f"""
WITH t AS (SELECT vec_id, label, {_SIM} AS similarity FROM {_FROM} WHERE e.embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 20),
n AS (SELECT n_regionkey, min(n_name) AS first_nation FROM nation WHERE n_nationkey < 15 GROUP BY 1)
SELECT vec_id, similarity, r_name, first_nation FROM t JOIN region ON label % 5 = r_regionkey LEFT JOIN n ON r_regionkey = n_regionkey AND n_regionkey <> 2"""


def _batch(spark, sf_dir, k):
    chunks = _chunks(spark, sf_dir)
    return retrieval.batch_top_k(chunks, chunks.where("id % 20 = 0"), k)


def _batch_sql(k: int) -> str:
    return f"""b AS (SELECT q.vec_id AS query_id, q.label AS query_group, e.vec_id AS id, e.label AS grp, {_SIM} AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= {k})"""


def q_vector_batch_topk(spark, sf_dir):
    return _batch(spark, sf_dir, 5).select("query_id", "rank", F.col("id").alias("vec_id"), "similarity")


QUERIES["q_vector_batch_topk"] = q_vector_batch_topk
ORACLE_SQL["q_vector_batch_topk"] = f"WITH {_batch_sql(5)} SELECT query_id, rank, id AS vec_id, similarity FROM b"


def q_vector_topk_collapse(spark, sf_dir):
    """Widened candidates, the best of each thread, the first k, and the confidence gate."""
    top = retrieval.vector_top_k(_chunks(spark, sf_dir).where("id <> 0"), _query(spark, sf_dir), max(CONFIG.candidates, CONFIG.top_k))
    best = retrieval.collapsed(retrieval.ranked(top, [F.col("similarity").desc(), "id"]), ("grp",), CONFIG.top_k)
    top_score = best.agg(F.max("similarity")).scalar()
    score = clamped(F.col("similarity"))
    return best.select("position", F.col("grp").cast("int").alias("label"), F.col("id").alias("vec_id"), score.alias("score"), retrieval.refused(clamped(top_score), CONFIG.cutoff).alias("refused"))


QUERIES["q_vector_topk_collapse"] = q_vector_topk_collapse
ORACLE_SQL["q_vector_topk_collapse"] = f"""
WITH t AS (SELECT vec_id, label, {_SIM} AS similarity FROM {_FROM} WHERE vec_id <> 0 AND e.embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT {CONFIG.candidates}),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS n FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS position FROM b WHERE n = 1 QUALIFY position <= {CONFIG.top_k})
SELECT position, label, vec_id, greatest(0, least(1, similarity)) AS score, (SELECT max(greatest(0, least(1, similarity))) FROM p) < {CONFIG.cutoff} AS refused FROM p"""


def q_hybrid_rrf(spark, sf_dir):
    """Both branches are limited before fusion; the fused ids are joined back to their rows."""
    chunks = _chunks(spark, sf_dir)
    vector = retrieval.ranked(retrieval.vector_top_k(chunks, _query(spark, sf_dir), 100), [F.col("similarity").desc(), "id"])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = docs.select("id", F.size(F.filter(fulltext.terms(F.col("text")), lambda t: t == "license")).cast("long").alias("hits")).where("hits > 0")
    text = retrieval.ranked(hits.orderBy(F.col("hits").desc(), "id").limit(100), [F.col("hits").desc(), "id"])
    best = retrieval.fused({"vector": vector, "text": text}, 20)
    return best.join(chunks.select("id", "grp"), "id", "left").select("id", F.round("score", 12).alias("score"), "n_branches", F.col("grp").cast("int").alias("label"))


QUERIES["q_hybrid_rrf"] = q_hybrid_rrf
_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '')"
ORACLE_SQL["q_hybrid_rrf"] = f"""
WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_SIM} DESC, vec_id) AS rank FROM {_FROM} WHERE e.embedding IS NOT NULL QUALIFY rank <= 100),
h AS (SELECT doc_id AS id, len(list_filter({_TERMS}, lambda t: t = 'license')) AS hits FROM documents),
t AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM h WHERE hits > 0 QUALIFY rank <= 100),
f AS (SELECT id, least(1.0::double, sum(1.0::double / (60 + rank) / (2.0::double / 61))) AS s, count(*) AS n FROM (FROM v UNION ALL FROM t) GROUP BY id ORDER BY s DESC, id LIMIT 20)
SELECT f.id, round(s, 12) AS score, n AS n_branches, label FROM f LEFT JOIN embeddings ON f.id = vec_id"""


def q_nearest_other_group(spark, sf_dir):
    """The first row of each of three groups, and its nearest row of another group; the seeds visit the rows together."""
    chunks = _chunks(spark, sf_dir)
    seeds = chunks.groupBy("grp").agg(F.min_by(F.struct("id", "vector"), "id").alias("s")).orderBy("grp").limit(3).select("grp", "s.id", "s.vector")  # three by definition of the report
    near = retrieval.batch_top_k(chunks, seeds, 1, other_group=True)
    return near.select(F.col("query_id").alias("seed_id"), F.col("id").alias("vec_id"), F.col("grp").cast("int").alias("label"), "similarity")


QUERIES["q_nearest_other_group"] = q_nearest_other_group
ORACLE_SQL["q_nearest_other_group"] = f"""
WITH s AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label ORDER BY label LIMIT 3)
SELECT s.vec_id AS seed_id, e.vec_id, e.label, {_SIM} AS similarity FROM s JOIN embeddings q ON q.vec_id = s.vec_id JOIN embeddings e ON e.label <> s.label
QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY similarity DESC, e.vec_id) = 1"""


def q_exact_rank(spark, sf_dir):
    """Rank of each group's best row among all rows, from one sort by ranges."""
    scored = _chunks(spark, sf_dir).where("vector IS NOT NULL AND id <> 0").select("id", "grp", F.round(cosine_to(F.col("vector"), _query(spark, sf_dir)), 9).alias("s"))
    ranks = global_rank(scored, [F.col("s").desc(), F.col("id")])
    return ranks.groupBy(F.col("grp").cast("int").alias("label")).agg(F.min_by("id", "rank").alias("vec_id"), F.min("rank").cast("long").alias("rank"))


QUERIES["q_exact_rank"] = q_exact_rank
ORACLE_SQL["q_exact_rank"] = f"""
WITH s AS (SELECT vec_id, label, row_number() OVER (ORDER BY {_SIM} DESC, vec_id) AS rank FROM {_FROM} WHERE vec_id <> 0 AND e.embedding IS NOT NULL)
SELECT label, arg_min(vec_id, rank) AS vec_id, min(rank) AS rank FROM s GROUP BY label"""


def q_context_diversity(spark, sf_dir):
    """Distinct threads among the first five, before and after collapse."""
    found = _batch(spark, sf_dir, 30)
    before = found.where("rank <= 5").groupBy("query_id").agg(F.count_distinct("grp").alias("threads_before"))
    after = retrieval.collapsed(found, ("grp",), 5, within=("query_id",)).groupBy("query_id").agg(F.count_distinct("grp").alias("threads_after"), F.sum("rank").cast("long").alias("rank_sum"))
    return before.join(after, "query_id")


QUERIES["q_context_diversity"] = q_context_diversity
ORACLE_SQL["q_context_diversity"] = f"""
WITH {_batch_sql(30)},
a AS (SELECT query_id, grp, min(rank) AS rank FROM b GROUP BY query_id, grp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) <= 5)
SELECT query_id, (SELECT count(DISTINCT grp) FROM b WHERE b.query_id = a.query_id AND rank <= 5) AS threads_before, count(DISTINCT grp) AS threads_after, sum(rank)::bigint AS rank_sum FROM a GROUP BY query_id"""


def q_hit_recall_mrr(spark, sf_dir):
    """Gold is any row of the query's group: hit, share of five that match, reciprocal first rank."""
    found = _batch(spark, sf_dir, 5)
    match = F.col("grp") == F.col("query_group")
    per = found.groupBy("query_id").agg(F.max(match.cast("int")).alias("hit"), (F.count_if(match) / 5).alias("recall"), F.coalesce(F.lit(1.0) / F.min(F.when(match, F.col("rank"))), F.lit(0.0)).alias("mrr"))
    return per.select("query_id", "hit", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


_PER = "p AS (SELECT query_id, any_value(query_group) AS query_group, max((grp = query_group)::int) AS hit, round(count(*) FILTER (grp = query_group) / 5, 9) AS recall, round(coalesce(1.0::double / min(rank) FILTER (grp = query_group), 0), 9) AS mrr FROM b GROUP BY query_id)"
QUERIES["q_hit_recall_mrr"] = q_hit_recall_mrr
ORACLE_SQL["q_hit_recall_mrr"] = f"WITH {_batch_sql(5)}, {_PER} SELECT query_id, hit, recall, mrr FROM p"


def q_metrics_by_group(spark, sf_dir):
    """Means by group and over all, in one rollup."""
    groups = _chunks(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("grp").cast("int").alias("label"))
    per = q_hit_recall_mrr(spark, sf_dir).join(groups, "query_id")
    return per.rollup("label").agg(F.count(F.lit(1)).alias("n_cases"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr")])


QUERIES["q_metrics_by_group"] = q_metrics_by_group
ORACLE_SQL["q_metrics_by_group"] = f"WITH {_batch_sql(5)}, {_PER} SELECT query_group AS label, count(*) AS n_cases, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM p GROUP BY ROLLUP (query_group)"


def _docs_and_questions(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def q_text_and_match(spark, sf_dir):
    return fulltext.all_terms_match(*_docs_and_questions(spark, sf_dir)).select("query_id", F.col("id").alias("doc_id"))


QUERIES["q_text_and_match"] = q_text_and_match
_HELD = f"d AS (SELECT doc_id, list_distinct({_TERMS}) AS d FROM documents), q AS (SELECT item_id AS query_id, list_distinct({_TERMS}) AS q FROM benchmark)"
ORACLE_SQL["q_text_and_match"] = f"WITH {_HELD} SELECT query_id, doc_id FROM q JOIN d ON len(q) > 0 AND list_has_all(d, q)"


def q_text_or_match(spark, sf_dir):
    """The ten documents with most of each question's terms."""
    return fulltext.most_terms_match(*_docs_and_questions(spark, sf_dir), 10).select("query_id", "rank", F.col("id").alias("doc_id"), "n_terms")


QUERIES["q_text_or_match"] = q_text_or_match
ORACLE_SQL["q_text_or_match"] = f"""WITH {_HELD}, m AS (SELECT query_id, doc_id, len(list_intersect(d, q)) AS n_terms FROM q, d)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n_terms DESC, doc_id) AS rank, doc_id, n_terms FROM m WHERE n_terms > 0 QUALIFY rank <= 10"""


def q_fts_cover_density(spark, sf_dir):
    """The three best documents for each whole question, with the density of the spans that cover its lexemes."""
    return q_fts_english(spark, sf_dir).select("query_id", "rank", "doc_id", "score")


QUERIES["q_fts_cover_density"] = q_fts_cover_density


def q_fts_english(spark, sf_dir):
    """The three documents with most of each question's lexemes, by distinct lexemes and then by cover density."""
    found = fulltext.density_ranked(*_docs_and_questions(spark, sf_dir), 3)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), "n_lexemes", "n_hits", "score")


QUERIES["q_fts_english"] = q_fts_english


def q_hybrid_rrf_questions(spark, sf_dir):
    """Every whole question in both branches: its text by cover density, the row of its number as its vector."""
    chunks = _chunks(spark, sf_dir)
    docs, questions = _docs_and_questions(spark, sf_dir)
    vectors = chunks.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
    branches = {"vector": retrieval.batch_top_k(chunks, vectors, 100), "text": fulltext.density_ranked(docs, questions, 100)}
    best = retrieval.fused(branches, 20, within=("query_id",))
    return best.join(chunks.select("id", "grp"), "id", "left").select("query_id", "rank", "id", F.round("score", 12).alias("score"), "n_branches", F.col("grp").cast("int").alias("label"))


QUERIES["q_hybrid_rrf_questions"] = q_hybrid_rrf_questions
