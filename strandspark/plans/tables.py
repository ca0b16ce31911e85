"""Registered change-detection, quality, evaluation and event queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation, quality
from ..operators import tables as tb
from ..streaming import incremental
from .common import Query, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _versions(spark, sf_dir):
    """Two versions of the documents: some are gone, some changed, some new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("hash"))
    old = docs.where("doc_id % 7 <> 1")
    new = docs.where("doc_id % 11 <> 2").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("hash", F.lit("v2")))).otherwise(F.col("hash")))
    return old, new


_VERSIONS = """d AS (SELECT doc_id, lang, source, md5(text) AS hash FROM documents), o AS (SELECT * FROM d WHERE doc_id % 7 <> 1),
n AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN md5(hash || 'v2') ELSE hash END AS hash FROM d WHERE doc_id % 11 <> 2)"""


def q_upsert_actions(spark, sf_dir):
    return tb.upsert_actions(*_versions(spark, sf_dir), ("doc_id",), ("lang", "hash"))


ORACLE_SQL["q_upsert_actions"] = f"""WITH {_VERSIONS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'keep' WHEN o.doc_id IS NULL THEN 'insert'
WHEN o.hash IS DISTINCT FROM n.hash OR o.lang IS DISTINCT FROM n.lang THEN 'update' ELSE 'noop' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id"""


def q_embedding_reuse(spark, sf_dir):
    """Upsert that keeps a stored vector's label only while the text's hash is unchanged."""
    old, new = _versions(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("stored"))
    old = old.select("doc_id", "hash").join(labels, "doc_id", "left")
    after = tb.upserted(old, new.select("doc_id", "hash").withColumn("stored", F.lit(None).cast("int")), ("doc_id",), ("hash",), {"stored": ("hash",)})
    return after.groupBy(F.col("stored").isNull().alias("pending")).agg(F.count(F.lit(1)).alias("n"), F.sum("stored").cast("long").alias("labels"))


ORACLE_SQL["q_embedding_reuse"] = f"""WITH {_VERSIONS}, u AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR o.hash IS NOT DISTINCT FROM n.hash THEN e.label END AS stored
FROM o FULL JOIN n ON o.doc_id = n.doc_id LEFT JOIN embeddings e ON e.vec_id = o.doc_id)
SELECT stored IS NULL AS pending, count(*) AS n, sum(stored)::bigint AS labels FROM u GROUP BY 1"""


def q_changed_pending(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("payload"))
    derived = old.where("doc_id % 3 <> 0").select("doc_id", "hash").join(held, "doc_id", "left")
    return tb.changed_or_pending(new, derived, ("doc_id",))


ORACLE_SQL["q_changed_pending"] = f"""WITH {_VERSIONS}, h AS (SELECT o.doc_id, o.hash, e.vec_id AS payload FROM o LEFT JOIN embeddings e ON e.vec_id = o.doc_id WHERE o.doc_id % 3 <> 0),
r AS (SELECT n.doc_id, CASE WHEN h.doc_id IS NULL THEN 'new' WHEN h.hash IS DISTINCT FROM n.hash THEN 'changed' WHEN payload IS NULL THEN 'pending' END AS reason FROM n LEFT JOIN h ON h.doc_id = n.doc_id)
SELECT * FROM r WHERE reason IS NOT NULL"""


def q_delete_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return tb.without_keys(orders, orders.where("o_orderstatus = 'F'"), ("o_orderkey",)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_delete_keys"] = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"


def q_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tb.without_keys(table(spark, sf_dir, "lineitem"), gone, ("l_orderkey",)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


ORACLE_SQL["q_cascade"] = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"


def _marks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where("user_id % 3 = 0 AND event_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("watermark"))


_MARKS = "w AS (SELECT user_id AS key, max(ts) AS watermark FROM events WHERE user_id % 3 = 0 AND event_id % 2 = 0 GROUP BY 1)"


def q_watermark_advance(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("watermark"))
    return incremental.advanced(_marks(spark, sf_dir), events).select("key", F.unix_micros(F.col("watermark").cast("timestamp")).alias("watermark"))


ORACLE_SQL["q_watermark_advance"] = f"WITH {_MARKS} SELECT key, epoch_us(max(watermark)) AS watermark FROM (FROM w UNION ALL SELECT user_id, ts FROM events) GROUP BY key"


def q_incremental_since(spark, sf_dir):
    new = incremental.since(table(spark, sf_dir, "events"), _marks(spark, sf_dir), "user_id", "ts")
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


ORACLE_SQL["q_incremental_since"] = f"WITH {_MARKS} SELECT event_type, count(*) AS n, sum(event_id)::bigint AS ids FROM events LEFT JOIN w ON user_id = key WHERE watermark IS NULL OR ts >= watermark GROUP BY 1"


def q_daily_quota(spark, sf_dir):
    """The first five events of each user and day."""
    kept = incremental.within_quota(table(spark, sf_dir, "events"), ["user_id"], "ts", 5, "event_id")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


ORACLE_SQL["q_daily_quota"] = """WITH k AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) <= 5)
SELECT user_id, count(*) AS n, sum(event_id)::bigint AS ids FROM k GROUP BY user_id"""


def q_quality_silver(spark, sf_dir):
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return quality.checks(
        table(spark, sf_dir, "documents"), "silver",
        {"rows": ("info", F.count(F.lit(1))), "null_keys": ("hard", F.count_if(F.col("doc_id").isNull())), "blank_text": ("hard", F.count_if(blank)), "duplicate_keys": ("hard", quality.duplicates("doc_id", "source")), "characters": ("info", F.sum(F.coalesce(F.length("text"), F.lit(0))))},
    )


ORACLE_SQL["q_quality_silver"] = """WITH c AS (SELECT count(*) AS rows, count(*) FILTER (doc_id IS NULL) AS null_keys, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank_text,
count(*) - count(DISTINCT (doc_id, source)) AS duplicate_keys, sum(coalesce(length(text), 0))::bigint AS characters FROM documents)
SELECT 'silver' AS layer, r.c AS "check", r.s AS severity, r.v AS value FROM c, LATERAL (VALUES ('rows', 'info', rows), ('null_keys', 'hard', null_keys), ('blank_text', 'hard', blank_text), ('duplicate_keys', 'hard', duplicate_keys), ('characters', 'info', characters)) AS r(c, s, v)"""


def q_quality_gold(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings")
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent")).distinct()
    joined = chunks.join(parents, F.col("vec_id") == F.col("parent"), "left")
    return quality.checks(
        joined, "gold",
        {"rows": ("info", F.count(F.lit(1))), "missing_vectors": ("hard", F.count_if(F.col("embedding").isNull())), "wrong_dimension": ("hard", F.count_if(F.size("embedding") != 64)), "orphans": ("hard", F.count_if(F.col("parent").isNull())), "groups": ("info", F.count_distinct("label"))},
    )


ORACLE_SQL["q_quality_gold"] = """WITH c AS (SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS missing_vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension,
count(*) FILTER (d.doc_id IS NULL) AS orphans, count(DISTINCT label) AS groups FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON vec_id = doc_id)
SELECT 'gold' AS layer, r.c AS "check", r.s AS severity, r.v AS value FROM c, LATERAL (VALUES ('rows', 'info', rows), ('missing_vectors', 'hard', missing_vectors), ('wrong_dimension', 'hard', wrong_dimension), ('orphans', 'hard', orphans), ('groups', 'info', groups)) AS r(c, s, v)"""


def q_fingerprint(spark, sf_dir):
    """Order-sensitive fingerprint of each bucket of documents; the buckets bound a group."""
    from ..functions.identity import fingerprint

    docs = table(spark, sf_dir, "documents")
    value = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.md5("text"))
    return docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), fingerprint(F.col("doc_id"), value).alias("fingerprint"))


ORACLE_SQL["q_fingerprint"] = "SELECT doc_id // 1000 AS bucket, count(*) AS n, md5(string_agg(md5(concat_ws('|', doc_id::varchar, coalesce(lang, ''), md5(text))), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1"


def q_alias_overlap(spark, sf_dir):
    """Numbers that two sources share, and how many of them have equal text or language."""
    docs = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 20)).alias("number"), "source", "lang", F.md5("text").alias("h"))
    a, b = (docs.where(F.col("source") == s).select("number", F.col("h").alias(f"h_{s}"), F.col("lang").alias(f"l_{s}")) for s in ("src1", "src2"))
    return a.join(b, "number").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("h_src1") == F.col("h_src2")).alias("same_text"), F.count_if(F.col("l_src1") == F.col("l_src2")).alias("same_lang"))


ORACLE_SQL["q_alias_overlap"] = """WITH d AS (SELECT doc_id // 20 AS number, source, lang, md5(text) AS h FROM documents)
SELECT count(*) AS shared, count(*) FILTER (a.h = b.h) AS same_text, count(*) FILTER (a.lang = b.lang) AS same_lang FROM d a JOIN d b ON a.number = b.number AND a.source = 'src1' AND b.source = 'src2'"""


def q_sample_per_group(spark, sf_dir):
    """Five documents of each source in the order of a seeded hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("h"))
    order = Window.partitionBy("source").orderBy("h", "doc_id")
    return docs.withColumn("n", F.row_number().over(order)).where("n <= 5").select("source", "doc_id", F.col("n").cast("long").alias("n"))


ORACLE_SQL["q_sample_per_group"] = "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents QUALIFY n <= 5"


def q_confusion_matrix(spark, sf_dir):
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


ORACLE_SQL["q_confusion_matrix"] = "SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL"


def q_prf(spark, sf_dir):
    out = evaluation.precision_recall(q_confusion_matrix(spark, sf_dir))
    return out.select("label", "support", "predicted", "correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


ORACLE_SQL["q_prf"] = """
WITH l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (quality = label) AS support, count(*) FILTER (toxic = label) AS predicted, count(*) FILTER (quality = label AND toxic = label) AS correct FROM l, labels GROUP BY label),
r AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0) AS p, coalesce(correct / nullif(support, 0), 0) AS q FROM c)
SELECT label, support, predicted, correct, round(p, 9) AS "precision", round(q, 9) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) AS f1 FROM r"""


def _scores(spark, sf_dir):
    """Every length has a score of its own, below 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 1).alias("answerable"))


def q_threshold_sweep(spark, sf_dir):
    best = evaluation.best_threshold(_scores(spark, sf_dir))
    return best.select(F.round("threshold", 9).alias("threshold"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "correctly_refused", "wrongly_refused")


ORACLE_SQL["q_threshold_sweep"] = """
WITH s AS (SELECT n_chars / (n_chars + 1000.0::double) AS score, quality = 1 AS ok FROM labels JOIN documents USING (doc_id)),
d AS (SELECT score, lead(score, 1, 1.0::double) OVER (ORDER BY score) AS next FROM (SELECT DISTINCT score FROM s)),
t AS (SELECT (score + next) / 2 AS t FROM d WHERE score < next UNION SELECT 0.0 UNION SELECT 1.0),
r AS (SELECT t, count(*) FILTER (NOT ok AND score < t) AS cr, count(*) FILTER (ok AND score < t) AS wr, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS u FROM t, s GROUP BY t)
SELECT round(t, 9) AS threshold, round((cr / u + (a - wr) / a) / 2, 9) AS balanced_accuracy, cr AS correctly_refused, wr AS wrongly_refused FROM r ORDER BY (cr / u + (a - wr) / a) / 2 DESC, t LIMIT 1"""


def q_latency_percentiles(spark, sf_dir):
    out = evaluation.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


ORACLE_SQL["q_latency_percentiles"] = "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1"


def q_cost_estimate(spark, sf_dir):
    """Exact decimals: token counts at rates for a million."""
    events = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 900).alias("tokens_in"), (F.col("user_id") % 70).alias("tokens_out"))
    cost = F.col("tokens_in") * F.lit("0.15").cast("decimal(10,2)") + F.col("tokens_out") * F.lit("0.60").cast("decimal(10,2)")
    return events.groupBy("event_type").agg(F.sum(cost).cast("decimal(28,2)").cast("double").alias("micro_cost"), F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_cost_estimate"] = "SELECT event_type, sum((event_id % 900) * 0.15::decimal(10,2) + (user_id % 70) * 0.60::decimal(10,2))::double AS micro_cost, count(*) AS n FROM events GROUP BY 1"


def q_json_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return events.select("event_type", F.explode(keys).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_json_props"] = "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL"


def q_tumbling(spark, sf_dir):
    """No counterpart in the retrieval domain: the stream form of the same plan is in the tests."""
    out = incremental.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("w"), "event_type", "n", F.round("total", 6).alias("total"))


ORACLE_SQL["q_tumbling"] = "SELECT epoch_us(date_trunc('hour', ts)) AS w, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def q_sliding(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("w"), "n")


ORACLE_SQL["q_sliding"] = """SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k) AS w, count(*) AS n FROM events, (VALUES (0), (1)) AS o(k) GROUP BY 1"""


def q_session(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("w"), "n")


ORACLE_SQL["q_session"] = """
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap FROM events),
s AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS w, count(*) AS n FROM s GROUP BY user_id, s"""


def q_tpch_join_agg(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").where("c_mktsegment = 'BUILDING'").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


ORACLE_SQL["q_tpch_join_agg"] = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"""


def q_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


ORACLE_SQL["q_cube"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"

QUERIES.update({k: v for k, v in globals().items() if k.startswith("q_")})
