"""Quality rules whose cutoffs carry a statistical guarantee; DataFrame functions only.

Counts of each whole text feed a fixed base rule and three ratios. For every
stratum and ratio, a fixed grid of cutoffs is tried on labelled documents. A
cutoff is certified when the exact binomial lower tail of its false rejections
among good documents, at the risk allowed for one rule, is at most ``delta``
divided by the number of all tests (Bonferroni). Of the certified cutoffs the one
that rejects most bad documents is used, the loosest on ties; without one the rule
doesn't act in that stratum. With probability 1 - delta no stratum loses more than
``risk`` of its good documents to the rules.

Edge cases: a null or blank text has no words and fails the base rule; a null
stratum is a stratum of its own; a document with several label rows counts as good
only if all say so; label rows with a null id or quality are left out; repeated
rows are judged alike, each on its own; empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, words_of, written

#: Ratio and the grid of cutoffs tried on it; a document above the cutoff is rejected.
RULES = {
    "symbol": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "line": ("n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeat": ("n_repeat_words / n_words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.45)),
}
RISK, DELTA = 0.03, 0.05
#: Terms of the binomial sum that are added one by one, from the largest; the others are bounded from above.
TERMS = 20_000


def text_counts(docs: DataFrame, carry: dict[str, str]) -> DataFrame:
    """``carry`` (new name -> column of docs) and the counts of each whole text.

    Repeated three-word windows are found within the row: windows' hashes are
    sorted with their positions, equal neighbours are marked, and the union of the
    marked windows is summed over the sorted positions, so no row is exploded.
    """
    kept = list(carry)
    at = docs.select(*[F.col(old).alias(new) for new, old in carry.items()], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    at = at.select(*kept, "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "").alias("lines"))
    window_at = lambda w, i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
    at = at.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: window_at(F.col("w"), i)))).alias("s"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    same = lambda k, x: F.get(F.col("s"), k)["h"] == x["h"]
    marked = F.filter(F.col("s"), lambda x, k: F.coalesce(same(k - 1, x), F.lit(False)) | F.coalesce(same(k + 1, x), F.lit(False)))
    at = at.select(*kept, *counts, F.sort_array(F.transform(marked, lambda x: x["i"])).alias("p"))
    width = F.transform(F.col("p"), lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(3))))
    return at.select(*kept, *counts, F.coalesce(F.aggregate(width, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln n!, by the table of exact values up to 20 and Stirling's series beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def lower_tail(k: Column, n: Column, p: float, terms: int = TERMS) -> Column:
    """P(Binomial(n, p) <= k), never less; 1 where k / n >= p, as no such cutoff can be certified.

    The sum is exact up to ``terms`` terms. Each lower term is less than the one above
    it by a ratio that falls on the way down, so beyond that the first term left out,
    over one minus its ratio, bounds all others, and is added.
    """
    term = lambda j: F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j) + j * math.log(p) + (n - j) * math.log1p(-p))
    lowest = F.greatest(F.lit(0).cast("long"), k - (terms - 1))
    below = F.greatest(lowest - 1, F.lit(0).cast("long"))
    ratio = below * (1 - p) / ((n - below + 1) * p)  # of the term under ``below`` to that at it
    rest = F.when(lowest > 0, term(below) / (1 - ratio)).otherwise(0.0)
    return F.when(k < n * p, F.aggregate(F.sequence(lowest, k), F.lit(0.0), lambda a, j: a + term(j)) + rest).otherwise(F.lit(1.0))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row a stratum: ``stratum`` and a cutoff for each rule, null if none is certified.

    ``labelled`` has stratum, quality (0 or 1) and the ratios. The counts a grid point
    needs are sums, so the labels are aggregated once, before any shuffle.
    """
    sums = [
        F.sum(F.when((F.col("quality") == good) & (F.col(rule) > cut), 1).otherwise(0)).alias(f"{rule}_{i}_{good}")
        for rule, (_, grid) in RULES.items() for i, cut in enumerate(grid) for good in (0, 1)
    ]
    by_stratum = labelled.groupBy("stratum").agg(F.sum("quality").cast("long").alias("n_good"), *sums)
    tests = by_stratum.select(
        "stratum", "n_good",
        F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{i}_1").cast("long").alias("lost"), F.col(f"{rule}_{i}_0").cast("long").alias("caught"))
            for rule, (_, grid) in RULES.items() for i, cut in enumerate(grid)
        ])).alias("x"),
    ).select("stratum", "n_good", "x.*")
    n_tests = by_stratum.agg((F.count(F.lit(1)) * sum(len(g) for _, g in RULES.values())).alias("n_tests"))
    passed = tests.where((F.col("caught") > 0) & (lower_tail(F.col("lost"), F.col("n_good"), risk / len(RULES)) <= F.lit(delta) / n_tests.scalar()))
    best = passed.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max_by("cutoff", F.struct("caught", "cutoff")))
    return best.select("stratum", *[F.col(rule).alias(f"{rule}_cutoff") for rule in RULES])


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", carry: tuple[str, ...] = ("doc_id",), risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts of every document, base_failed and kept, with ``carry`` of its columns.

    The counts are written to the shared folder once: calibration reads its few
    columns for the labelled rows, the verdict reads all. A document's one label is
    read from a table, as an aggregate right before the join would keep Spark from
    splitting a document that is a third of all rows. Cutoffs have a row a
    stratum; as a table their size is known to Spark, which broadcasts them if they
    are small, so that no document is shuffled by its stratum, and joins by shuffle
    if they are not.
    """
    counts = text_counts(docs, {f"c_{c}": c for c in carry} | {"id": "doc_id", "stratum": stratum})
    ratios = [F.coalesce(F.try_divide(*map(F.col, of.split(" / "))), F.lit(0.0)).alias(rule) for rule, (of, _) in RULES.items()]
    counts = written(counts.select("*", base_failed().alias("base_failed"), *ratios), "quality-counts")
    quality = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    labelled = counts.where(~F.col("base_failed")).select("id", "stratum", *RULES).join(written(quality, "quality-labels"), "id")
    cutoffs = written(certified_cutoffs(labelled, risk, delta), "cutoffs").withColumnRenamed("stratum", "of_stratum")
    over = [F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in RULES]
    kept = ~F.col("base_failed")
    for x in over:
        kept = kept & ~x
    verdict = counts.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    return verdict.select(*[F.col(f"c_{c}").alias(c) for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def without_rejected(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the given columns."""
    return judged(docs, labels, carry=columns).where("kept").select(*columns)


