"""Evaluation cases: validation with reasons, gold matches, retrieval metrics, summaries, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cleaning import first_reason

# The fields that a case must have, and the states of its verification.
REQUIRED = ("case_id", "question", "expected_issues", "expected_issue_urls", "verification_status", "expected_abstain", "verification_note")
STATUSES = ("manually_verified", "codex_checked", "heuristic", "unresolved")
# End of the fixed values.

_ISSUES = "array<struct<repository: string, issue_number: bigint, issue_url: string>>"


def validated_cases(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good cases, and rejected lines with their first reason, of JSON lines (line, json).

    Of lines with one case_id the first stays. Callers that need all or nothing use
    ``require_cases``.
    """
    v = F.col("v")
    at = objects.select("line", F.try_parse_json("json").alias("v"))
    kind = lambda path: F.upper(F.schema_of_variant(F.try_variant_get(v, path, "variant")))
    text = lambda path: F.try_variant_get(v, path, "string")
    held = F.json_object_keys(F.to_json("v"))
    n = lambda path: F.size(F.try_variant_get(v, path, "array<variant>"))
    is_list = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    reason = first_reason(
        (v.isNull(), "invalid JSON"),
        (~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)) | (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), held)) > 0), "missing fields"),
        (F.coalesce(kind("$.case_id") != "STRING", F.lit(True)) | (text("$.case_id") == ""), "invalid or duplicate case_id"),
        (F.coalesce(kind("$.verification_status") != "STRING", F.lit(True)) | ~text("$.verification_status").isin(*STATUSES), "invalid verification status"),
        (F.coalesce(kind("$.question") != "STRING", F.lit(True)) | (F.trim(text("$.question")) == ""), "question is empty"),
        (~is_list("$.expected_issues") | ~is_list("$.expected_issue_urls"), "expected sources must be lists"),
        ((text("$.verification_status") == "unresolved") & ((n("$.expected_issues") > 0) | (n("$.expected_issue_urls") > 0)), "unresolved cases have no expected issue"),
    )
    parsed = at.select(
        "line", reason.alias("reason"), text("$.case_id").alias("case_id"), text("$.question").alias("question"), text("$.verification_status").alias("verification_status"), F.try_variant_get(v, "$.expected_abstain", "boolean").alias("expected_abstain"),
        F.from_json(F.to_json(F.try_variant_get(v, "$.expected_issues", "variant")), _ISSUES).alias("expected_issues"), F.from_json(F.to_json(F.try_variant_get(v, "$.expected_issue_urls", "variant")), "array<string>").alias("expected_issue_urls"),
    )
    ok = parsed.where("reason IS NULL").drop("reason")
    first = ok.groupBy("case_id").agg(F.min("line").alias("line"))
    later = ok.join(first, ["case_id", "line"], "left_anti").select("line", F.lit("invalid or duplicate case_id").alias("reason"))
    return ok.join(first, ["case_id", "line"], "left_semi"), parsed.where("reason IS NOT NULL").select("line", "reason").unionByName(later)


def require_cases(good: DataFrame, bad: DataFrame) -> DataFrame:
    """The good cases; an error with the first rejected lines, or if there is no case at all."""
    if rows := bad.orderBy("line").limit(5).collect():
        raise ValueError("; ".join(f"line {r.line}: {r.reason}" for r in rows))
    if good.isEmpty():
        raise ValueError("there are no cases")
    return good


def expected_sources(cases: DataFrame) -> DataFrame:
    """case_id, at, repository, issue_number and issue_url of each expected source: the issues, or if there are none the addresses."""
    of_urls = F.transform("expected_issue_urls", lambda u: F.struct(F.lit(None).cast("string").alias("repository"), F.lit(None).cast("bigint").alias("issue_number"), u.alias("issue_url")))
    wanted = F.when(F.coalesce(F.size("expected_issues"), F.lit(0)) > 0, F.col("expected_issues")).otherwise(of_urls)
    return cases.select("case_id", F.posexplode(wanted).alias("at", "x")).select("case_id", "at", "x.*")


def gold_matches(expected: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, rank and at: of each result (case_id, rank, repository, issue_number, issue_url) the first expected source that it is.

    A result is a source if repository and number agree or if the address does: two
    joins by equality, each on its own keys.
    """
    of, found = expected.alias("e"), results.alias("r")
    same = lambda *names: [F.col(f"e.{n}") == F.col(f"r.{n}") for n in ("case_id", *names)]
    pick = ("r.case_id", "r.rank", "e.at")
    by_number = found.join(of, same("repository", "issue_number")).select(*pick)
    by_url = found.join(of.where("e.issue_url <> ''"), same("issue_url")).select(*pick)
    return by_number.unionByName(by_url).groupBy("case_id", "rank").agg(F.min("at").alias("at"))


def retrieval_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, applicable, hit, recall and mrr of every case; nulls where nothing is expected.

    Sources with one address, or one repository and number, count once as found.
    """
    expected = expected_sources(cases)
    key = F.coalesce(F.nullif("issue_url", F.lit("")), F.concat_ws("\0", "repository", F.col("issue_number").cast("string")))
    found = gold_matches(expected, results).join(expected.select("case_id", "at", key.alias("key")), ["case_id", "at"])
    per = found.groupBy("case_id").agg(F.min("rank").alias("first"), F.count_distinct("key").alias("n_found"))
    wanted = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    at = cases.select("case_id").join(wanted, "case_id", "left").join(per, "case_id", "left")
    some = F.col("n").isNotNull()
    return at.select("case_id", some.alias("applicable"), F.when(some, F.col("first").isNotNull().cast("int")).alias("hit"), F.when(some, F.coalesce("n_found", F.lit(0)) / F.col("n")).alias("recall"), F.when(some, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"))


def retrieval_summary(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    """grouping (all, status, repository), name, n_cases and the means over applicable cases.

    A case counts once for each repository that it expects.
    """
    scored = metrics.where("applicable").join(cases.select("case_id", "verification_status", "expected_issues"), "case_id")
    names = F.filter(F.array_distinct(F.transform("expected_issues", lambda x: x["repository"])), lambda x: F.coalesce(x, F.lit("")) != "")
    under = lambda grouping, name: F.struct(F.lit(grouping).alias("grouping"), name.alias("name"))
    groups = F.concat(F.array(under("all", F.lit(None).cast("string")), under("status", F.col("verification_status"))), F.coalesce(F.transform(names, lambda x: under("repository", x)), F.array()))
    rows = scored.select(F.explode(groups).alias("g"), "hit", "recall", "mrr").select("g.*", "hit", "recall", "mrr")
    return rows.groupBy("grouping", "name").agg(F.count(F.lit(1)).alias("n_cases"), *[F.avg(c).alias(c) for c in ("hit", "recall", "mrr")])


def compared(modes: dict[str, DataFrame], cases: DataFrame) -> DataFrame:
    """The summaries of several retrieval modes over the same cases, side by side under ``mode``."""
    out = None
    for name, results in modes.items():
        rows = retrieval_summary(cases, retrieval_metrics(cases, results)).withColumn("mode", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def changed_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases whose metrics differ between two runs, with both values: what a change of scope gained and lost."""
    both = before.alias("b").join(after.alias("a"), "case_id")
    pair = lambda c: F.struct(F.col(f"b.{c}").alias("before"), F.col(f"a.{c}").alias("after")).alias(c)
    differs = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    return both.where(differs("hit") | differs("recall") | differs("mrr")).select("case_id", *map(pair, ("hit", "recall", "mrr")))


def cutoff_confusion(scores: DataFrame, cutoff: Column | float) -> DataFrame:
    """answerable, refused and n for (answerable, score) at a frozen cutoff; no score is refused."""
    refused = F.coalesce(F.col("score") < cutoff, F.lit(True))
    return scores.groupBy("answerable", refused.alias("refused")).agg(F.count(F.lit(1)).alias("n"))


def same_scope(a: Column, b: Column) -> Column:
    """Whether two arrays of names are the same set."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """With place: every row's position, from 1, in a pseudorandom order that depends on key and seed alone."""
    from .ordering import global_rank

    return global_rank(df.withColumn("_h", F.xxhash64(F.lit(seed), *key)), [F.col("_h"), *map(F.col, key)], "place").drop("_h")


def sampled(df: DataFrame, group: str, n: int, seed: int, *key: str) -> DataFrame:
    """n rows of each group in the order of a seeded hash; an error names groups that are too small."""
    short = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n).limit(5).collect()
    if short:
        raise ValueError("; ".join(f"{r[0]} has {r.n} of {n} rows" for r in short))
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def within_budget(first: DataFrame, then: DataFrame, limit: int, *key: str) -> DataFrame:
    """The rows of ``first`` in the order of ``key``, and of ``then`` as many as the limit leaves."""
    both = first.withColumn("_turn", F.lit(0)).unionByName(then.withColumn("_turn", F.lit(1)))
    return both.orderBy("_turn", *key).limit(limit).drop("_turn")


def write_evaluation(header: dict[str, str], metrics: DataFrame, folder: str, run_id: str) -> None:
    """Appends a run: its case rows, and then its header, so that a header always has its rows.

    A run that failed before its header leaves rows that ``read_evaluations`` doesn't show.
    """
    spark = metrics.sparkSession
    metrics.select(F.lit(run_id).alias("run_id"), "*").write.mode("append").parquet(f"{folder}/cases")
    spark.createDataFrame([(run_id, header)], "run_id string, header map<string, string>").coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def read_evaluations(spark, folder: str) -> DataFrame:
    """The case rows of all runs that have a header."""
    runs = spark.read.parquet(f"{folder}/runs")
    return spark.read.parquet(f"{folder}/cases").join(runs, "run_id")
