"""Registered queries over a stored positional index, and hybrid against vector retrieval, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import positional, retrieval
from ..staging import shared_folder, united, written
from .common import Query, table
from .retrieval import _HELD, _SIM, _TERMS, _chunks

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SCOPE, TOP = (0, 1, 2, 3, 4), 10


def _indexed(spark, sf_dir, config: str = "simple") -> tuple[positional.TextIndex, DataFrame]:
    """An index over all documents, whose group is that of the row of their number, and the questions."""
    groups = written(_chunks(spark, sf_dir).select("id", "grp"), "groups")  # a table without the vectors: Spark sees how small it is, and doesn't shuffle the texts for the join
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(groups, "id", "left")
    index = positional.TextIndex(spark, f"text_{uuid.uuid4().hex}", config).build(docs, shared_folder(spark, "text-index"))
    return index, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _ranks(spark, sf_dir, mode: str, config: str = "simple") -> DataFrame:
    index, questions = _indexed(spark, sf_dir, config)
    return index.top_k(questions, TOP, mode).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


_ASKED = f"""{_HELD}, asked AS (SELECT query_id, unnest(q) AS term, len(q) AS m FROM q),
p AS (SELECT doc_id, w[i] AS term, i AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_TERMS} AS w FROM documents)))"""
#: Places of each pair in order, the latest place of each term up to each of them, and covers, which begin at the earliest of these.
_COVERS = """pairs AS (SELECT query_id, doc_id FROM q JOIN d ON len(q) > 0 AND list_has_all(d, q)),
h AS (SELECT query_id, doc_id, m, term, pos, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS i FROM pairs JOIN p USING (doc_id) JOIN asked USING (query_id, term)),
l AS (SELECT e.query_id, e.doc_id, e.m, e.i, e.pos, s.term, max(s.i) AS last FROM h e JOIN h s ON s.query_id = e.query_id AND s.doc_id = e.doc_id AND s.i <= e.i GROUP BY ALL),
c AS (SELECT query_id, doc_id, i, pos, min(last) AS b FROM l GROUP BY query_id, doc_id, m, i, pos HAVING count(*) = m),
f AS (SELECT query_id, doc_id, b, min(i) AS i, min(pos) AS pos FROM c GROUP BY query_id, doc_id, b),
r AS (SELECT f.query_id, f.doc_id, round(sum(0.1::double / (1 + f.pos - h.pos - f.i + f.b)), 6) AS score FROM f JOIN h ON h.query_id = f.query_id AND h.doc_id = f.doc_id AND h.i = f.b GROUP BY ALL)"""
_TOP = f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::bigint AS rank, doc_id, score FROM r QUALIFY rank <= {TOP}"


def q_rank_cd_all(spark, sf_dir):
    """The ten best documents with all words of each question, by the density of covers."""
    return _ranks(spark, sf_dir, "all")


ORACLE_SQL["q_rank_cd_all"] = f"WITH {_ASKED}, {_COVERS} SELECT query_id, {_TOP}"


def q_rank_cd_any(spark, sf_dir):
    """The ten best documents with any word of each question; every place of a word is a cover."""
    return _ranks(spark, sf_dir, "any")


ORACLE_SQL["q_rank_cd_any"] = f"WITH {_ASKED}, r AS (SELECT query_id, doc_id, round(0.1::double * count(*), 6) AS score FROM p JOIN asked USING (term) GROUP BY ALL) SELECT query_id, {_TOP}"


def q_rank_cd_english(spark, sf_dir):
    """The same by stems, without stop words."""
    return _ranks(spark, sf_dir, "all", "english")


def _modes(spark, sf_dir) -> DataFrame:
    """mode, query_id, rank, id and score of each question with a vector in both modes; all branches keep to the scope."""
    index, questions = _indexed(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    vectors = chunks.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
    near = retrieval.batch_top_k(chunks.where(F.col("grp").isin(*SCOPE)), vectors, TOP)
    asked = questions.join(vectors.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    text = index.top_k(asked, TOP, "all", SCOPE)
    hybrid = retrieval.fused({"vector": near, "text": text}, TOP, within=("query_id",))
    rows = lambda df, mode, score: df.select(F.lit(mode).alias("mode"), "query_id", "rank", "id", score.alias("score"))
    return united([rows(near, "vector", F.col("similarity")), rows(hybrid, "hybrid", F.round("score", 12))], "modes")


def q_hybrid_modes(spark, sf_dir):
    return _modes(spark, sf_dir)


_IN_SCOPE = ", ".join(map(str, SCOPE))
_MODES = f"""{_ASKED}, {_COVERS},
v AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank
    FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label IN ({_IN_SCOPE}) QUALIFY rank <= {TOP}),
t AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r JOIN embeddings e ON e.vec_id = doc_id AND e.label IN ({_IN_SCOPE})
    WHERE query_id IN (SELECT vec_id FROM embeddings) QUALIFY rank <= {TOP}),
u AS (SELECT query_id, id, round(least(1.0::double, sum(1.0::double / (60 + rank) / (2.0::double / 61))), 12) AS score FROM (SELECT query_id, id, rank FROM v UNION ALL FROM t) GROUP BY ALL),
x AS (SELECT 'vector' AS mode, query_id, rank, id, similarity AS score FROM v
    UNION ALL SELECT 'hybrid', query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM u QUALIFY rank <= {TOP})"""
ORACLE_SQL["q_hybrid_modes"] = f"WITH {_MODES} SELECT mode, query_id, rank::bigint AS rank, id, score FROM x"


def q_vector_or_hybrid(spark, sf_dir):
    """Hit rate and mean reciprocal rank of both modes; a row of the question's own group is what is sought."""
    groups = _chunks(spark, sf_dir).select("id", "grp")
    found = _modes(spark, sf_dir).join(groups, "id").join(groups.select(F.col("id").alias("query_id"), F.col("grp").alias("wanted")), "query_id")
    first = F.min(F.when(F.col("grp") == F.col("wanted"), F.col("rank")))
    per = found.groupBy("mode", "query_id").agg(first.alias("first"))
    return per.groupBy("mode").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("hit"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


ORACLE_SQL["q_vector_or_hybrid"] = f"""WITH {_MODES},
per AS (SELECT mode, query_id, min(rank) FILTER (a.label = b.label) AS first FROM x JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id GROUP BY ALL)
SELECT mode, count(*) AS n_cases, round(avg((first IS NOT NULL)::int), 6) AS hit, round(avg(coalesce(1.0::double / first, 0)), 6) AS mrr FROM per GROUP BY mode"""


QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
