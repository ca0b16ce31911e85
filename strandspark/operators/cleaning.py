"""Raw threads to clean rows: ordered reject reasons, labels, comments, resolution, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_hash
from ..functions.text import normal_body, normal_title, unescaped
from ..staging import written

# Author roles that count as maintainers, and the host of thread addresses.
MAINTAINERS = ("OWNER", "MEMBER", "COLLABORATOR")
THREAD_HOST = "github.com"
# End of the fixed values.


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds gives the reason; null when none does."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), reason) for broken, reason in rules])


def timestamp(x: Column) -> Column:
    """ISO text to an instant, a missing zone is UTC (the session's); junk is null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(x))


def iso(x: Column, zone: str) -> Column:
    """An instant as ISO text in UTC (the session's zone), microseconds only where there are some, with ``zone`` at its end."""
    whole = F.unix_micros(x) % 1_000_000 == 0
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(whole, "").otherwise(F.date_format(x, ".SSSSSS")), F.lit(zone))


def repository_name(x: Column) -> Column:
    """owner/name of plain characters, else null."""
    return F.when(x.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), x)


def path_safe(repository: Column) -> Column:
    """For object keys: other characters become two underscores."""
    return F.regexp_replace(repository, r"[^A-Za-z0-9_.-]", "__")


def resolution(comments: Column, closed_at: Column) -> Column:
    """The last maintainer comment before closure; the first of equally late ones; struct of text and state."""
    late = F.transform(comments, lambda c, i: F.struct(timestamp(c["created_at"]).alias("at"), (-i).alias("order"), c["body"].alias("body"), c["author_association"].alias("role")))
    able = F.filter(late, lambda c: (c["at"] < closed_at) & c["role"].isin(*MAINTAINERS))
    last = F.struct(F.coalesce(F.size(able), F.lit(0)).alias("n"), F.array_max(able)["body"].alias("body"))
    state = (
        lambda x: F.when(closed_at.isNull(), "unavailable_missing_closed_at")
        .when(x["n"] <= 0, "unavailable_no_maintainer_comment_before_closure")
        .when(F.coalesce(x["body"], F.lit("")) == "", "unavailable_last_maintainer_comment_has_no_text")
        .otherwise("last_maintainer_comment_before_closure")
    )
    found = F.transform(F.array(last), lambda x: F.struct(F.when(state(x) == "last_maintainer_comment_before_closure", x["body"]).alias("text"), state(x).alias("state")))
    return F.get(found, F.lit(0))  # the lambda's variable keeps the walk from being copied into each use


def _kind(v: Column, path: str = "$") -> Column:
    return F.upper(F.schema_of_variant(F.try_variant_get(v, path, "variant")))


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _not_text(v: Column, path: str) -> Column:
    """There, but neither text nor null."""
    return F.coalesce(~_kind(v, path).isin("STRING", "VOID"), F.lit(False))


def _comment_reason(c: Column) -> Column:
    return first_reason(
        (F.coalesce(~_kind(c).startswith("OBJECT"), F.lit(True)), "each comment must be an object"),
        (_not_text(c, "$.created_at"), "timestamps must be text"),
        (_not_text(c, "$.body"), "text fields must be text"),
    )


def parsed_threads(raw: DataFrame) -> DataFrame:
    """repository, seq, reason, and the fields of every raw JSON object (repository, seq, json), parsed once.

    Reasons come in a fixed order: repository, object, issue, number, address, times,
    comments one by one, title, body, labels. Rows with a reason have no further fields.
    """
    v = F.col("v")
    at = raw.select("repository", "seq", F.try_parse_json("json").alias("v"))
    number = F.try_variant_get(v, "$.issue.number", "string").try_cast("bigint")
    url = _text(v, "$.issue.html_url")
    part = lambda name: F.lower(F.try_parse_url(url, F.lit(name)))
    at = at.select("*", number.alias("number"), url.alias("github_url"), F.try_variant_get(v, "$.comments", "array<variant>").alias("cs"), F.try_variant_get(v, "$.issue.labels", "array<variant>").alias("ls"))
    reasons = first_reason(
        (F.coalesce(F.trim("repository"), F.lit("")) == "", "repository is required"),
        (F.coalesce(~_kind(v).startswith("OBJECT"), F.lit(True)), "record must contain an object"),
        (F.coalesce(~_kind(v, "$.issue").startswith("OBJECT"), F.lit(True)), "issue is required"),
        (F.coalesce(~_kind(v, "$.issue.number").isin("BIGINT", "STRING"), F.lit(True)) | F.col("number").isNull(), "issue number must be an integer"),
        (F.col("number") < 1, "issue number must be positive"),
        (F.coalesce((part("PROTOCOL") != "https") | (part("HOST") != THREAD_HOST), F.lit(True)), "a valid issue URL is required"),
        (_not_text(v, "$.issue.created_at") | _not_text(v, "$.issue.closed_at"), "timestamps must be text"),
        (F.coalesce(~_kind(v, "$.comments").startswith("ARRAY"), F.lit(True)), "comments must be a list"),
    )
    of_comments = F.get(F.filter(F.transform("cs", _comment_reason), lambda x: x.isNotNull()), F.lit(0))
    last = first_reason(
        (_not_text(v, "$.issue.updated_at"), "timestamps must be text"),
        (_not_text(v, "$.issue.title") | _not_text(v, "$.issue.body"), "title and body must be text"),
        (F.coalesce(~(_kind(v, "$.issue.labels").startswith("ARRAY") | (_kind(v, "$.issue.labels") == "VOID")), F.lit(False)), "labels must be a list"),
    )
    at = at.withColumn("reason", F.coalesce(reasons, of_comments, last))
    label = lambda x: F.when(_kind(x).startswith("OBJECT") & (_kind(x, "$.name") == "STRING"), _text(x, "$.name")).when(_kind(x) == "STRING", _text(x))
    comment = lambda c: F.struct(
        _text(c, "$.id").alias("id"), F.lit(None).cast("string").alias("body"), _text(c, "$.created_at").alias("created_at"), _text(c, "$.user.login").alias("author_login"),
        _text(c, "$.author_association").alias("author_association"), _text(c, "$.html_url").alias("html_url"),
    )
    texts = F.concat(F.array(_text(v, "$.issue.title"), _text(v, "$.issue.body")), F.coalesce(F.transform("cs", lambda c: _text(c, "$.body")), F.array()), F.coalesce(F.transform("ls", label), F.array()))
    valid = F.col("reason").isNull()
    at = at.select(
        "repository", F.col("number").alias("issue_number"), "seq", "reason", "github_url", F.size("cs").alias("comment_count"), F.when(valid, F.transform("cs", comment)).alias("bare"),
        *[F.when(valid, timestamp(_text(v, f"$.issue.{c}"))).alias(c) for c in ("created_at", "closed_at", "updated_at")],
        F.when(valid, _text(v, "$.issue.user.login")).alias("author_login"), F.when(valid, _text(v, "$.issue.author_association")).alias("author_association"),
        unescaped(F.when(valid, texts)).alias("texts"),
    )
    bodies = F.slice("texts", F.lit(3), F.greatest(F.col("comment_count"), F.lit(0)))
    comments = F.zip_with("bare", bodies, lambda c, b: c.withField("body", normal_body(b)).withField("created_at", iso(timestamp(c["created_at"]), "+00:00")))
    labels = F.filter(F.transform(F.slice("texts", F.col("comment_count") + 3, F.size("texts")), normal_title), lambda x: F.coalesce(x, F.lit("")) != "")
    at = at.select("*", normal_title(F.get("texts", F.lit(0))).alias("title"), normal_body(F.get("texts", F.lit(1))).alias("body"), F.when(F.col("reason").isNull(), comments).alias("comments"), F.when(F.col("reason").isNull(), labels).alias("labels"))
    at = at.withColumn("res", F.when(F.col("reason").isNull(), resolution(F.col("comments"), F.col("closed_at"))))
    confidence = F.when(F.col("res.text").isNotNull(), "low").otherwise("none")
    spoken = F.transform(F.filter("comments", lambda c: F.coalesce(c["body"], F.lit("")) != ""), lambda c: F.struct(c["body"].alias("body"), c["html_url"].alias("html_url")))
    digest = content_hash(title=F.col("title"), body=F.col("body"), github_url=F.col("github_url"), comments=spoken, resolution_text=F.col("res.text"), resolution_confidence=confidence)
    roles = F.array_distinct(F.filter(F.transform("comments", lambda c: c["author_association"]), lambda x: x.isNotNull()))
    return at.select(
        "repository", "issue_number", "seq", "reason", "title", "body", "github_url", "labels", "author_login", "author_association", "created_at", "closed_at", "updated_at", "comments", "comment_count", roles.alias("author_associations"),
        F.col("res.text").alias("resolution_text"), F.col("res.state").alias("resolution_heuristic"), F.when(F.col("reason").isNull(), confidence).alias("resolution_confidence"), F.when(F.col("reason").isNull(), digest).alias("content_hash"),
    )


def clean_threads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of raw JSON objects (repository, seq, json).

    A row is rejected for its first broken rule; of a key's good rows the first by seq
    is kept and the others are rejected as duplicates. Nothing is raised for a row. The
    parsed rows are a table, as both results read them.
    """
    key = ["repository", "issue_number", "seq"]
    at = written(parsed_threads(raw), "parsed-threads")
    good = at.where("reason IS NULL").drop("reason")
    first = written(good.groupBy("repository", "issue_number").agg(F.min("seq").alias("seq")), "first-threads")
    later = good.select(*key).join(first, key, "left_anti").withColumn("reason", F.lit("duplicate key"))
    return good.join(first, key, "left_semi"), at.where("reason IS NOT NULL").select(*key, "reason").unionByName(later)


def validation_counters(raw: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """By repository and over all: source, valid, rejected and duplicate records, missing bodies and resolutions."""
    one = lambda df, **flags: df.select("repository", *[(flags.get(c, F.lit(0))).cast("int").alias(c) for c in COUNTERS])
    blank = (F.coalesce("body", F.lit("")) == "").cast("int")
    rows = one(raw, source_records=F.lit(1)).unionByName(one(good, valid_records=F.lit(1), missing_bodies=blank, missing_resolutions=F.col("resolution_text").isNull()))
    rows = rows.unionByName(one(bad, rejected_records=F.lit(1), duplicate_records=F.col("reason") == "duplicate key"))
    return rows.rollup("repository").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS], F.grouping("repository").cast("int").alias("is_total"))


COUNTERS = ("source_records", "valid_records", "rejected_records", "duplicate_records", "missing_bodies", "missing_resolutions")
