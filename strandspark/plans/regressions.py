"""Registered queries over regressions, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, regression, retrieval
from .cases import _COLLAPSED, _cases, _metrics_sql, _results
from .cases import CUTOFF as _CUTOFF
from .common import Query, table
from .retrieval import _batch, _batch_sql

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_MARKER, _MESSAGE = "[INSUFFICIENT]", "There is not enough evidence."


def _evidence(found):
    """The five results of each question, in order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "grp")))  # five a question
    return found.groupBy("query_id").agg(listed.alias("evidence")).select(F.col("query_id").alias("case_id"), F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("question"), "evidence")


def _checks(spark, sf_dir):
    """Saved answers of five kinds over the first five results, where some runs saw fewer or other results, or are missing."""
    before = regression.frozen(_evidence(_batch(spark, sf_dir, 5)))
    at = F.col("case_id")
    kind = (at / 20).cast("long") % 5
    raw = F.when(kind == 0, _MARKER).when(kind == 1, f"  {_MARKER}\n").when(kind == 2, f"{_MARKER} but try the flag").when(kind == 3, "I cannot answer this.").otherwise("Set the flag [1]")
    other = F.when(at % 220 == 0, F.slice("evidence", 1, 4)).when(at % 260 == 0, F.reverse("evidence")).otherwise(F.col("evidence"))
    run = before.drop("input_digest").where(at % 340 != 0).withColumn("evidence", other)
    ids = F.transform("evidence", lambda x: x["id"])
    finished = regression.replayed(run, run.select("case_id", raw.alias("raw")), _MARKER, _MESSAGE, ids.cast("array<string>"), ids)
    return regression.abstention_checks(before, finished, _MARKER, _MESSAGE, ids)


_CHECKED = f"""{_batch_sql(5)}, o AS (SELECT query_id AS c, list(id ORDER BY rank) AS s FROM b GROUP BY query_id),
n AS (SELECT c, s, (c // 20) % 5 AS kind, CASE WHEN c % 220 = 0 THEN s[1:4] WHEN c % 260 = 0 THEN list_reverse(s) ELSE s END AS t FROM o),
k AS (SELECT c AS case_id, c % 340 <> 0 AS in_both, in_both AND s = t AS evidence_same, in_both AND kind IN (0, 1) AS marker_only, in_both AND kind < 4 AS message_exact, in_both AND kind < 4 AS no_inline_sources,
    in_both AND s = t AS sources_same, in_both AND len(s) = len(t) AS count_same, evidence_same AND marker_only AS passed FROM n)"""


def q_abstention_checks(spark, sf_dir):
    """Every check of every frozen case."""
    return _checks(spark, sf_dir)


ORACLE_SQL["q_abstention_checks"] = f"WITH {_CHECKED} SELECT * FROM k"


def q_abstention_report(spark, sf_dir):
    """How many cases fail each check, and the first of them."""
    return regression.check_report(_checks(spark, sf_dir))


ORACLE_SQL["q_abstention_report"] = f"WITH {_CHECKED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", count(*) AS n_cases, count(*) FILTER (NOT {c}) AS n_failed, min(case_id) FILTER (NOT {c}) AS first_failed FROM k" for c in (*regression.CHECKS, "passed")
)


def q_call_reservations(spark, sf_dir):
    """What a call for each document costs at most, and which calls a budget allows in order."""
    calls = regression.reservations(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), 1200, "0.05", "0.40")
    return regression.reserved_within(calls.drop("text"), [F.col("doc_id")], "0.5").select("doc_id", "input_bound", F.col("reserved").cast("double").alias("reserved"), "in_budget")


ORACLE_SQL["q_call_reservations"] = """WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 512 AS input_bound, (input_bound * 5 + 1200 * 40)::bigint AS e8 FROM documents)
SELECT doc_id, input_bound::bigint AS input_bound, (e8 * 0.00000001::decimal(18,10))::decimal(18,10)::double AS reserved, sum(e8) OVER (ORDER BY doc_id) <= 50000000 AS in_budget FROM r"""


def q_reviewed_rescore(spark, sf_dir):
    """Reviewed cases alone, by the first five threads of thirty chunks, at the frozen cutoff."""
    made, found = _cases(spark, sf_dir), _batch(spark, sf_dir, 30)
    threads = retrieval.collapsed(found, ("grp",), 5, within=("query_id",)).withColumn("rank", F.col("position"))
    best = found.where("rank = 1").select(F.col("query_id").cast("string").alias("case_id"), F.col("similarity").alias("score"))
    out = regression.reviewed_scores(made, cases.retrieval_metrics(made, _results(threads)), best, _CUTOFF)
    return out.select("repository", "n_cases", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr")], "n_hits", "n_refused")


ORACLE_SQL["q_reviewed_rescore"] = f"""WITH {_batch_sql(30).replace("b AS (", "b0 AS (", 1)}, {_COLLAPSED}, {_metrics_sql(5, "a")},
w AS (SELECT p.*, issues[1].r AS repo, coalesce(similarity < {_CUTOFF}, true) AS refused FROM p LEFT JOIN b0 ON b0.query_id = p.q AND b0.rank = 1 WHERE applicable AND q % 60 = 0),
g AS (SELECT NULL::varchar AS repository, * FROM w UNION ALL SELECT repo, * FROM w WHERE repo IS NOT NULL)
SELECT repository, count(*) AS n_cases, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, sum(hit)::bigint AS n_hits, count(*) FILTER (refused) AS n_refused FROM g GROUP BY 1"""

QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
