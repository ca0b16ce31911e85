"""Repeated rows without words."""

from collections import Counter

import pytest

from strandspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [1, 3])
def test_repeated_rows_without_words_each_have_a_row(spark, n):
    rows = [(1, "", "en", "s", 0), (1, None, "en", "s", None), (None, None, "en", "s", None), (2, " \n", None, None, 2), (4, "some words here", "en", "s", 15)] * n
    got = Counter((r.doc_id, r["size"]) for r in mixing.mixed_sizes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(1, 0): 2 * n, (None, 0): n, (2, 0): n, (4, 3): n})
    assert all(r.taken == 0 for r in mixing.mixed_sizes(spark.createDataFrame(rows, SCHEMA)).where("size = 0").collect())
