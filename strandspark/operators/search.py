"""Retrieval as a service does it: settings are checked, then both modes answer any number of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import graph, retrieval
from .positional import TextIndex


def retrieved(config: EngineConfig, chunks: DataFrame, questions: DataFrame, index: TextIndex | None = None, graphs: DataFrame | None = None, groups: tuple[int, ...] | None = None) -> DataFrame:
    """query_id, rank, id, similarity and score of the best ``top_k`` chunks (id, grp, vector) for each question (query_id, text, vector).

    ``groups`` are the numbers of the configured scope; every branch keeps to them before it is limited. In
    vector mode the score is the similarity, by exact search, or through ``graphs`` to the configured depth. In hybrid
    mode the text branch wants all of a question's lexemes, ranks come from covers, and
    both branches are fused by their ranks; a chunk that only the text branch found has similarity 0.
    A blank question is an error in hybrid mode.
    """
    asked = questions.select(F.col("query_id").alias("id"), F.lit(None).cast("long").alias("grp"), "vector")
    if graphs is not None:
        near = graph.best(graph.searched(graphs, asked, config.top_k, config.depth, groups), config.top_k)
    else:
        near = retrieval.batch_top_k(chunks if groups is None else chunks.where(F.col("grp").isin(*groups)), asked, config.top_k)
    near = near.select("query_id", "rank", "id", "similarity")
    if config.mode == "vector":
        return near.select("*", F.col("similarity").alias("score"))
    if index is None:
        raise ValueError("hybrid mode needs a text index")
    if questions.where(F.trim(F.coalesce("text", F.lit(""))) == "").limit(1).count():
        raise ValueError("hybrid mode needs a text for each question")
    text = index.top_k(questions, config.top_k, "all", groups)
    best = retrieval.fused({"vector": near, "text": text}, config.top_k, within=("query_id",))
    return best.join(near.select("query_id", "id", "similarity"), ["query_id", "id"], "left").select("query_id", "rank", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "score")
