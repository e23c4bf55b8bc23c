"""Size guards for anything broadcast or brought to the driver.

A side is broadcast only after its row count is proven below a bound; above
it the plan falls back to a shuffle join chosen by AQE.  Query blocks that go
to Python workers are collected only under the same kind of bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when ``df`` has at most ``max_rows`` rows (one cheap count)."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> pd.DataFrame:
    """Bring a small table to the driver, refusing unbounded input."""
    head = df.limit(max_rows + 1).toPandas()
    if len(head) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; process it in blocks")
    return head


def spread(df: DataFrame, keys: list[str] | None = None, min_partitions: int | None = None) -> DataFrame:
    """Repartition only when a scan yields fewer partitions than the cluster runs in parallel.

    Text tables stored as one large row group would otherwise tokenise in a
    single task.  Hash-partitioning by the row key also lets later per-row
    aggregations (e.g. postings grouped by doc_id, term) run without a shuffle.
    On large inputs (many splits) this is a no-op.
    """
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
