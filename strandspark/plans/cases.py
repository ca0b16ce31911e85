"""Registered queries over evaluation cases and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import cases, evaluation, retrieval
from .common import Query, table
from .retrieval import _batch, _batch_sql

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CUTOFF = EngineConfig().cutoff


def _cases(spark, sf_dir):
    """A case for every twentieth row: its group as a numbered thread, an address, or for some nothing at all."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select("vec_id", F.col("label").cast("long").alias("label"))
    issue = F.struct(F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")).alias("repository"), F.col("label").alias("issue_number"), F.lit(None).cast("string").alias("issue_url"))
    by_url = F.struct(F.lit("r9").alias("repository"), F.lit(-1).cast("long").alias("issue_number"), F.concat(F.lit("u"), (F.col("vec_id") % 40).cast("string")).alias("issue_url"))
    none = F.array().cast("array<struct<repository: string, issue_number: bigint, issue_url: string>>")
    urls = F.when(F.col("vec_id") % 7 == 1, F.array(F.concat(F.lit("u"), (F.col("vec_id") % 40).cast("string")))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("vec_id") % 60 == 0, "manually_verified").otherwise("heuristic")
    return rows.select(F.col("vec_id").cast("string").alias("case_id"), F.when(F.col("vec_id") % 7 < 2, none).otherwise(F.array(issue, by_url)).alias("expected_issues"), urls.alias("expected_issue_urls"), status.alias("verification_status"))


def _results(found):
    """What batch search finds, as threads: three repositories, groups as numbers, forty addresses."""
    return found.select(F.col("query_id").cast("string").alias("case_id"), "rank", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repository"), F.col("grp").alias("issue_number"), F.concat(F.lit("u"), (F.col("id") % 40).cast("string")).alias("issue_url"))


def q_gold_matches(spark, sf_dir):
    """Metrics of each case, where a source is met by repository and number or by its address."""
    found = cases.retrieval_metrics(_cases(spark, sf_dir), _results(_batch(spark, sf_dir, 10)))
    return found.select("case_id", "applicable", "hit", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


def _metrics_sql(k: int, rows: str = "b") -> str:
    return f"""c AS (SELECT vec_id AS q, label, CASE WHEN vec_id % 7 < 2 THEN [] ELSE [{{'r': 'r' || vec_id % 3, 'n': label::bigint, 'u': NULL}}, {{'r': 'r9', 'n': -1::bigint, 'u': 'u' || vec_id % 40}}] END AS issues,
    CASE WHEN vec_id % 7 = 1 THEN ['u' || vec_id % 40] ELSE [] END AS urls FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT q, unnest(CASE WHEN len(issues) > 0 THEN issues ELSE list_transform(urls, lambda u: {{'r': NULL::varchar, 'n': NULL::bigint, 'u': u}}) END) AS x FROM c),
m AS (SELECT DISTINCT e.q, {rows}.rank, coalesce(x.u, x.r || ' ' || x.n) AS key FROM e JOIN {rows} ON {rows}.query_id = e.q AND ((x.r = 'r' || {rows}.id % 3 AND x.n = {rows}.grp) OR x.u = 'u' || {rows}.id % 40)),
t AS (SELECT q, rank, arg_min(key, CASE WHEN key LIKE 'u%' THEN 1 ELSE 0 END) AS key FROM m GROUP BY q, rank),
n AS (SELECT q, count(*) AS n FROM e GROUP BY q), f AS (SELECT q, min(rank) AS first, count(DISTINCT key) AS found FROM t GROUP BY q),
p AS (SELECT c.q, c.q::varchar AS case_id, n.n IS NOT NULL AS applicable, CASE WHEN n.n IS NOT NULL THEN (first IS NOT NULL)::int END AS hit, CASE WHEN n.n IS NOT NULL THEN coalesce(found, 0) / n.n END AS recall,
    CASE WHEN n.n IS NOT NULL THEN coalesce(1.0::double / first, 0) END AS mrr, issues FROM c LEFT JOIN n USING (q) LEFT JOIN f USING (q))"""


ORACLE_SQL["q_gold_matches"] = f"WITH {_batch_sql(10)}, {_metrics_sql(10)} SELECT case_id, applicable, hit, round(recall, 9) AS recall, round(mrr, 9) AS mrr FROM p"


def q_retrieval_summary(spark, sf_dir):
    """Means over all cases, by status, and by each repository that a case expects."""
    made = _cases(spark, sf_dir)
    found = cases.retrieval_summary(made, cases.retrieval_metrics(made, _results(_batch(spark, sf_dir, 10))))
    return found.select("grouping", "name", "n_cases", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr")])


_SUMMARY = """s AS (SELECT *, unnest(list_concat([{'g': 'all', 'n': NULL::varchar}, {'g': 'status', 'n': CASE WHEN q % 60 = 0 THEN 'manually_verified' ELSE 'heuristic' END}], list_transform(list_distinct(list_transform(issues, lambda x: x.r)), lambda r: {'g': 'repository', 'n': r}))) AS x FROM p WHERE applicable)"""
_MEANS = "count(*) AS n_cases, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr"
ORACLE_SQL["q_retrieval_summary"] = f"WITH {_batch_sql(10)}, {_metrics_sql(10)}, {_SUMMARY} SELECT x.g AS grouping, x.n AS name, {_MEANS} FROM s GROUP BY 1, 2"


def q_mode_comparison(spark, sf_dir):
    """The same cases by the first five chunks and by the first five threads of thirty chunks."""
    made, found = _cases(spark, sf_dir), _batch(spark, sf_dir, 30)
    threads = retrieval.collapsed(found, ("grp",), 5, within=("query_id",)).withColumn("rank", F.col("position"))
    out = cases.compared({"chunks": _results(found.where("rank <= 5")), "threads": _results(threads)}, made)
    return out.where("grouping = 'all'").select("mode", "n_cases", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr")])


_BEST = "SELECT query_id, arg_min(id, rank) AS id, grp, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM b0 GROUP BY query_id, grp"
_COLLAPSED = f"a AS (SELECT query_id, id, grp, place AS rank FROM ({_BEST}) WHERE place <= 5)"
ORACLE_SQL["q_mode_comparison"] = " UNION ALL ".join(
    f"(WITH {_batch_sql(30).replace('b AS (', 'b0 AS (', 1)}, {with_rows}, {_metrics_sql(5, name)} SELECT '{mode}' AS mode, {_MEANS} FROM p WHERE applicable)"
    for mode, name, with_rows in (("chunks", "b1", "b1 AS (SELECT * FROM b0 WHERE rank <= 5)"), ("threads", "a", _COLLAPSED))
)


def q_cutoff_confusion(spark, sf_dir):
    """How many answerable and other questions a frozen cutoff refuses, by their best score."""
    best = _batch(spark, sf_dir, 1).select((F.col("query_group") < 8).alias("answerable"), F.col("similarity").alias("score"))
    return cases.cutoff_confusion(best, CUTOFF)


ORACLE_SQL["q_cutoff_confusion"] = f"WITH {_batch_sql(1)} SELECT query_group < 8 AS answerable, similarity < {CUTOFF} AS refused, count(*) AS n FROM b GROUP BY ALL"


def q_classification_report(spark, sf_dir):
    """Accuracy and macro F1 over the classes that occur."""
    out = evaluation.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1")])


ORACLE_SQL["q_classification_report"] = """
WITH l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (quality = label) AS s, count(*) FILTER (toxic = label) AS p, count(*) FILTER (quality = label AND toxic = label) AS ok FROM l, labels GROUP BY label),
f AS (SELECT *, coalesce(ok / nullif(p, 0), 0) AS pr, coalesce(ok / nullif(s, 0), 0) AS re FROM c)
SELECT (SELECT count(*) FROM labels) AS n, round(sum(ok) / (SELECT count(*) FROM labels), 9) AS accuracy, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)) FILTER (s > 0), 9) AS macro_f1 FROM f"""


def q_case_validation(spark, sf_dir):
    """Questions as case lines, some with a planted fault: each line's first reason."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("line"), "text")
    fault = F.col("line") % 8
    case = F.struct(
        F.when(fault == 1, "same").otherwise(F.concat(F.lit("c"), F.col("line").cast("string"))).alias("case_id"), F.when(fault == 2, " ").otherwise(F.col("text")).alias("question"), F.array().cast("array<string>").alias("expected_issues"),
        F.when(fault == 3, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("expected_issue_urls"), F.when(fault == 3, "unresolved").when(fault == 4, "guessed").otherwise("heuristic").alias("verification_status"),
        F.lit(False).alias("expected_abstain"), F.lit("").alias("verification_note"),
    )
    lines = asked.select("line", F.when(fault == 5, "{").when(fault == 6, "[]").otherwise(F.to_json(case)).alias("json"))
    good, bad = cases.validated_cases(lines)
    return good.select("line", F.lit("valid").alias("reason")).unionByName(bad)


ORACLE_SQL["q_case_validation"] = """
SELECT item_id::bigint AS line, CASE item_id % 8 WHEN 1 THEN CASE WHEN item_id = (SELECT min(item_id) FROM benchmark WHERE item_id % 8 = 1) THEN 'valid' ELSE 'invalid or duplicate case_id' END WHEN 2 THEN 'question is empty'
WHEN 3 THEN 'unresolved cases have no expected issue' WHEN 4 THEN 'invalid verification status' WHEN 5 THEN 'invalid JSON' WHEN 6 THEN 'missing fields' ELSE 'valid' END AS reason FROM benchmark"""

QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
