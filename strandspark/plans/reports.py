"""Registered reports over arrays, contexts, costs, budgets, scopes and snapshots, with their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answers, cases, cleaning, digests, evaluation, retrieval
from ..operators import tables as tb
from .cases import _cases, _metrics_sql, _results
from .common import Query, table
from .documents import _BUG, _COUNT, _FEATURE, _USAGE
from .retrieval import _batch, _batch_sql, _chunks
from .search import _ASKED, _COVERS, _indexed
from .tables import _VERSIONS, _versions

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _lines(spark, sf_dir):
    """Each text's lines as a JSON array; every fifth document has an object instead."""
    lines = F.to_json(F.split(F.coalesce("text", F.lit("")), "\n"))
    other = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, other).otherwise(lines).alias("j"))


_LINES = """j AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN json_object('lang', coalesce(lang, '')) ELSE to_json(string_split(coalesce(text, ''), chr(10))) END AS j FROM documents)"""


def q_json_array_lengths(spark, sf_dir):
    """Lengths of arrays alone are summed; other values count as none."""
    length = F.json_array_length("j")
    return _lines(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(length).alias("n_arrays"), F.coalesce(F.sum(length), F.lit(0)).alias("n_elements"))


ORACLE_SQL["q_json_array_lengths"] = f"""WITH {_LINES} SELECT lang, count(*) AS n, count(*) FILTER (json_type(j) = 'ARRAY') AS n_arrays,
coalesce(sum(CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) ELSE 0 END), 0)::bigint AS n_elements FROM j GROUP BY lang"""


def q_json_array_exists(spark, sf_dir):
    """Documents that have an element of a kind in their array; nothing is unnested or joined."""
    elements = F.when(F.json_array_length("j").isNotNull(), F.from_json("j", "array<string>"))
    return _lines(spark, sf_dir).select("doc_id", F.coalesce(F.exists(elements, lambda x: F.length(x) > 400), F.lit(False)).alias("has_long"), F.coalesce(F.exists(elements, lambda x: x == ""), F.lit(False)).alias("has_empty"))


ORACLE_SQL["q_json_array_exists"] = f"""WITH {_LINES}, a AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["VARCHAR"]') ELSE [] END AS x FROM j)
SELECT doc_id, EXISTS (SELECT 1 FROM (SELECT unnest(x) AS v) WHERE length(v) > 400) AS has_long, EXISTS (SELECT 1 FROM (SELECT unnest(x) AS v) WHERE v = '') AS has_empty FROM a"""


def q_context_size(spark, sf_dir):
    """Threads and characters of each question's first five chunks, and whether all five are of different threads."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("chars"))
    found = _batch(spark, sf_dir, 5).join(texts, "id", "left")
    per = found.groupBy("query_id").agg(F.count_distinct("grp").alias("n_threads"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("n_chars"))
    return per.select("query_id", "n_threads", "n_chars", (F.col("n_threads") == 5).alias("is_full"))


ORACLE_SQL["q_context_size"] = f"""WITH {_batch_sql(5)} SELECT query_id, count(DISTINCT grp) AS n_threads, coalesce(sum(length(text)), 0)::bigint AS n_chars, count(DISTINCT grp) = 5 AS is_full
FROM b LEFT JOIN documents ON doc_id = id GROUP BY query_id"""


def q_request_cost(spark, sf_dir):
    """Each request's cost from three rates for a million tokens, as an exact decimal of ten places."""
    rate = lambda tokens, x: tokens.cast("decimal(10,0)") * F.lit(x).cast("decimal(8,6)")
    total = rate(F.col("event_id") % 9000, "0.150000") + rate(F.col("user_id") % 700, "0.600000") + rate(F.col("event_id") % 77, "0.074999")
    return table(spark, sf_dir, "events").select("event_id", F.round(total / F.lit(1_000_000).cast("decimal(7,0)"), 10).cast("decimal(18,10)").cast("double").alias("cost"))


ORACLE_SQL["q_request_cost"] = """SELECT event_id, (round(((event_id % 9000) * 0.15::decimal(8,6) + (user_id % 700) * 0.6::decimal(8,6) + (event_id % 77) * 0.074999::decimal(8,6))::decimal(30,16) * 0.000001::decimal(8,6), 10))::decimal(18,10)::double AS cost FROM events"""


def q_rules_against_titles(spark, sf_dir):
    """The rules over bodies alone against what the title says, where it says something: counts of expected and found labels."""
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "_")
    docs = table(spark, sf_dir, "documents").select(F.substring_index(ascii_text, "\n", 1).alias("title"), ascii_text.alias("body"))
    both = docs.select(tx.rule_label(F.col("title"), F.col("body")).alias("t"), tx.rule_label(F.lit(""), F.col("body")).alias("b")).where("t.confidence = 'high'")
    return both.groupBy(F.col("t.label").alias("expected"), F.col("b.label").alias("found")).agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_rules_against_titles"] = f"""
WITH a AS (SELECT regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g') AS t FROM documents),
c AS (SELECT split_part(t, chr(10), 1) AS title, {_COUNT(_BUG)} AS b, {_COUNT(_FEATURE)} AS f, {_COUNT(_USAGE)} AS u FROM a),
l AS (SELECT CASE WHEN regexp_matches(title, '{_FEATURE}') THEN 'feature' WHEN regexp_matches(title, '{_BUG}') THEN 'bug' WHEN regexp_matches(title, '{_USAGE}') THEN 'usage' END AS expected,
    CASE WHEN b > f AND b > u THEN 'bug' WHEN f > b AND f > u THEN 'feature' WHEN u > b AND u > f THEN 'usage' ELSE 'unknown' END AS found FROM c)
SELECT expected, found, count(*) AS n FROM l WHERE expected IS NOT NULL GROUP BY ALL"""

_SCOPES = {"b": (0, 1, 2, 3, 4), "a": (0, 1, 2, 3, 4, 5, 6, 7)}


def q_scope_experiment(spark, sf_dir):
    """Cases whose metrics change when the scope takes in more groups."""
    made, chunks = _cases(spark, sf_dir), _chunks(spark, sf_dir)
    runs = [cases.retrieval_metrics(made, _results(retrieval.batch_top_k(chunks.where(F.col("grp").isin(*scope)), chunks.where("id % 20 = 0"), 10))) for scope in _SCOPES.values()]
    found = cases.changed_metrics(*runs)
    return found.select("case_id", *[F.round(F.col(f"{c}.{side}"), 9).alias(f"{c}_{side}") for c in ("hit", "recall", "mrr") for side in ("before", "after")])


def _scoped(scope: tuple[int, ...]) -> str:
    rows = _batch_sql(10).replace("e.vec_id <> q.vec_id", f"e.vec_id <> q.vec_id AND e.label IN ({', '.join(map(str, scope))})")
    return f"(WITH {rows}, {_metrics_sql(10)} SELECT case_id, hit, recall, mrr FROM p)"


_SIDES = ", ".join(f"round({side}.{c}, 9) AS {c}_{name}" for c in ("hit", "recall", "mrr") for side, name in (("b", "before"), ("a", "after")))
ORACLE_SQL["q_scope_experiment"] = f"""SELECT b.case_id, {_SIDES} FROM {_scoped(_SCOPES["b"])} b JOIN {_scoped(_SCOPES["a"])} a ON a.case_id = b.case_id
WHERE (b.hit, b.recall, b.mrr) IS DISTINCT FROM (a.hit, a.recall, a.mrr)"""


def q_within_spend(spark, sf_dir):
    """The requests, in order, that a budget of tokens allows: what was spent before decides, refused ones included."""
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 900).alias("tokens"))
    return evaluation.within_spend(calls, [F.col("event_id")], "tokens", 100_000)


ORACLE_SQL["q_within_spend"] = "SELECT event_id, event_id % 900 AS tokens FROM events QUALIFY sum(event_id % 900) OVER (ORDER BY event_id) <= 100000"


def q_work_budget(spark, sf_dir):
    """Changed rows first, then of the pending ones as many as a limit leaves."""
    old, new = _versions(spark, sf_dir)
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("payload"))
    open_rows = tb.changed_or_pending(new, old.where("doc_id % 3 <> 0").select("doc_id", "hash").join(held, "doc_id", "left"), ("doc_id",))
    return cases.within_budget(open_rows.where("reason = 'changed'"), open_rows.where("reason = 'pending'"), 250, "doc_id")


ORACLE_SQL["q_work_budget"] = f"""WITH {_VERSIONS}, h AS (SELECT o.doc_id, o.hash, e.vec_id AS payload FROM o LEFT JOIN embeddings e ON e.vec_id = o.doc_id WHERE o.doc_id % 3 <> 0),
r AS (SELECT n.doc_id, CASE WHEN h.hash IS DISTINCT FROM n.hash THEN 'changed' WHEN payload IS NULL THEN 'pending' END AS reason FROM n JOIN h ON h.doc_id = n.doc_id)
SELECT doc_id, reason FROM r WHERE reason IS NOT NULL ORDER BY reason, doc_id LIMIT 250"""


def q_snapshot_changes(spark, sf_dir):
    """Keys that differ between two snapshots, found by their trees of digests."""
    return digests.changed_keys(*_versions(spark, sf_dir), "lang", ("doc_id",), ("hash", "source"), levels=1)


ORACLE_SQL["q_snapshot_changes"] = f"""WITH {_VERSIONS} SELECT coalesce(n.lang, o.lang) AS lang, coalesce(n.doc_id, o.doc_id) AS doc_id,
CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.hash IS DISTINCT FROM n.hash"""


def q_or_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", answers.or_query(F.col("text")).alias("asked"))


ORACLE_SQL["q_or_queries"] = "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' OR ') AS asked FROM benchmark"


def q_gold_ranks(spark, sf_dir):
    """Where the document of each question's number stands among all that have all, or any, of its words."""
    index, questions = _indexed(spark, sf_dir)
    gold = questions.select("query_id", F.col("query_id").alias("id"))
    modes = [index.gold_ranks(questions, gold, mode).select("query_id", F.lit(mode).alias("mode"), "n_candidates", "gold_rank") for mode in ("all", "any")]
    return reduce(lambda a, b: a.unionByName(b), modes)


ORACLE_SQL["q_gold_ranks"] = f"""WITH {_ASKED}, {_COVERS},
s AS (SELECT 'all' AS mode, query_id, doc_id, score FROM r UNION ALL SELECT 'any', query_id, doc_id, round(0.1::double * count(*), 6) FROM p JOIN asked USING (term) GROUP BY ALL),
n AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id AS query_id, m.mode, count(n.rank) AS n_candidates, min(n.rank) FILTER (n.doc_id = item_id) AS gold_rank
FROM benchmark CROSS JOIN (VALUES ('all'), ('any')) AS m(mode) LEFT JOIN n ON n.mode = m.mode AND n.query_id = item_id GROUP BY ALL"""


def q_guarded_update(spark, sf_dir):
    """Vectors' labels arrive for many rows; only rows without one take theirs."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("label"))
    arrived = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    return tb.filled(rows, arrived, ("vec_id",), "label")


ORACLE_SQL["q_guarded_update"] = """SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN label WHEN vec_id % 2 = 0 THEN label + 100 END AS label FROM embeddings"""


def q_first_parts(spark, sf_dir):
    """The first 5,000 characters, and the first four lines: what a request for a question is made of."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring(text, 1, 5000)).alias("head"), F.md5(F.array_join(F.slice(F.split(text, "\n"), 1, 4), "\n")).alias("lines"))


ORACLE_SQL["q_first_parts"] = """SELECT doc_id, md5(substring(coalesce(text, ''), 1, 5000)) AS head, md5(array_to_string(string_split(coalesce(text, ''), chr(10))[1:4], chr(10))) AS lines FROM documents"""


def q_canonical_times(spark, sf_dir):
    """Instants as text with a Z, microseconds only where there are some."""
    at = F.when(F.col("event_id") % 4 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", cleaning.iso(at, "Z").alias("at"))


ORACLE_SQL["q_canonical_times"] = """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) ELSE ts END AS t FROM events)
SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 = 0 THEN '' ELSE strftime(t, '.%f') END || 'Z' AS at FROM e"""


def q_object_keys(spark, sf_dir):
    """Names that are an owner's and a repository's, and keys that are safe in a path."""
    name = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " / ").when(F.col("doc_id") % 3 == 1, "/").otherwise(":/"), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.repository_name(name).alias("name"), cleaning.path_safe(name).alias("key"))


ORACLE_SQL["q_object_keys"] = """WITH d AS (SELECT doc_id, coalesce(source, '') || CASE doc_id % 3 WHEN 0 THEN ' / ' WHEN 1 THEN '/' ELSE ':/' END || coalesce(lang, '') AS n FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(n, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') THEN n END AS name, regexp_replace(n, '[^A-Za-z0-9_.-]', '__', 'g') AS key FROM d"""


def q_same_scopes(spark, sf_dir):
    """Whether the languages of each source are the set that was stated, in whatever order and however often."""
    stated = F.array(*map(F.lit, ("fr", "en", "de", "en", "es")))
    sets = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return sets.select("source", cases.same_scope(F.col("langs"), stated).alias("same"))


ORACLE_SQL["q_same_scopes"] = "SELECT source, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) IS NOT DISTINCT FROM ['de', 'en', 'es', 'fr'] AS same FROM documents GROUP BY source"


QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
