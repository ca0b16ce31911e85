"""The binomial tail beyond the terms that are added one by one."""

from math import exp, lgamma, log, log1p

import pytest
from pyspark.sql import functions as F

from strandspark.llm import quality_rules


def tail(k, n, p):
    """All terms, added from the least."""
    of = lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p))
    return sum(of(j) for j in range(k + 1))


@pytest.mark.parametrize("k, n, p", [(9_500, 1_000_000, 0.01), (29_700, 3_000_000, 0.01), (9_950, 1_000_000, 0.01), (24_000, 2_500_000, 0.01)])
@pytest.mark.parametrize("terms", [1, 40, 500, quality_rules.TERMS])
def test_bounded_terms_never_make_the_tail_smaller(spark, k, n, p, terms):
    exact = tail(k, n, p)
    got = spark.range(1).select(quality_rules.lower_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p, terms).alias("x")).first().x
    assert got >= exact * (1 - 1e-7)
    if terms == quality_rules.TERMS:
        assert got == pytest.approx(exact, rel=1e-6)


def test_more_labels_than_terms_certify_and_reject(spark):
    """A stratum with over 20,000 labels that a cutoff loses: certified below the risk, not at it."""
    made = "stratum string, quality int, symbol double, line double, repeat double"
    good = spark.range(4_000_000).selectExpr("'a' AS stratum", "1 AS quality", "CASE WHEN id < 39000 THEN 0.5D WHEN id < 40500 THEN 0.3D ELSE 0D END AS symbol", "0D AS line", "0D AS repeat")
    bad = spark.createDataFrame([("a", 0, 0.9, 0.0, 0.0)] * 50 + [("a", 0, 0.6, 0.0, 0.0)] * 10, made)
    cuts = quality_rules.certified_cutoffs(good.unionByName(bad)).first()
    assert cuts.symbol_cutoff == 0.4 and cuts.line_cutoff is None
