"""Query sets that visit the data in rounds.

The data stays where it is stored. A round sends a lot of queries, of bounded size, to
all tasks; each task holds its own rows against them and returns what is best there.
Nothing is shuffled but the few best rows, and a larger query set is more rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written

#: Queries of a round, on average at most.
LOT = 16_384


def lots(queries: DataFrame, key: str, most: int = LOT) -> Iterator[pd.DataFrame]:
    """The queries, in lots by the hash of ``key``; what is no lot of its own is not on the driver at once."""
    held = written(queries, "queries")
    n = max(1, -(-held.count() // most))
    for i in range(n):
        lot = (held.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else held).toPandas()
        if len(lot):
            yield lot


def in_rounds(data: DataFrame, queries: DataFrame, key: str, visit: Callable[[pd.DataFrame], Callable], schema: str, most: int = LOT, arrow: bool = False) -> DataFrame:
    """The rows that ``visit(lot)``, a function of a task's batches, returns over all rounds; with ``arrow`` of Arrow batches, else of pandas frames."""
    out = data.sparkSession.createDataFrame([], schema)
    for lot in lots(queries, key, most):
        out = out.unionByName((data.mapInArrow if arrow else data.mapInPandas)(visit(lot), schema))
    return out
