"""Monitoring over request / search logs: counters, running means, rates, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tessera.operators import sequence as S


# G8
def search_metrics(log: DataFrame, by: str = "day") -> DataFrame:
    """Total searches, cache hits, hit rate and mean response time per ``by`` and overall (rollup)."""
    return log.rollup(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("cache_hit").alias("cache_hits"),
        (F.count_if("cache_hit") / F.count(F.lit(1))).alias("hit_rate"),
        F.avg("response_ms").alias("avg_response_ms"),
    )


# W2
def running_metrics(log: DataFrame, scope: str = "day", ts: str = "ts", rid: str = "event_id", value: str = "response_ms",
                    decimals: int | None = None) -> DataFrame:
    """Running count and mean per scope in time order (ordered parallel scan: a hot scope is split).

    Decimal columns are summed as exact integers in units of their own scale, others as
    doubles; ``decimals`` says that a column of doubles holds so many decimals and is to be
    summed exactly too (what lies beyond is rounded).  Rows without a value are left out.
    """
    kind = log.schema[value].dataType
    decimals = kind.scale if decimals is None and isinstance(kind, DecimalType) else decimals
    unit = 10 ** (decimals or 0)
    x = log.where(F.col(value).isNotNull()).select(scope, ts, rid, value)
    units = F.col(value) if decimals is None else F.round(F.col(value) * F.lit(unit)).cast("bigint")
    x = x.withColumn("_a", F.lit(1.0)).withColumn("_b", units.cast("double"))
    out = S.affine_scan(x, scope, [ts, rid], "_a", "_b", 0.0, [scope, rid, ts])
    return out.select(scope, rid, ts, F.col("idx").alias("n"), (F.col("value") / F.col("idx") / F.lit(float(unit))).alias("running_avg"))


# T3 (batch form)
def request_rate(req: DataFrame, by: str = "model", ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Requests per second over a sliding window (count / window length)."""
    w = F.window(F.col(ts).cast("timestamp"), length, slide)
    return req.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n", (F.col("n") / F.lit(float(seconds))).alias("rate")
    )


# W9
def anomalies(series: DataFrame, key: str, order: str, value: str, n: int = 24, z: float = 3.0) -> DataFrame:
    """z-score of each point against the ``n`` preceding points of its series; ``|z| > z`` flags an anomaly."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    mu, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    zc = F.try_divide(F.col(value) - mu, sd)
    return series.select(key, order, value, zc.alias("z")).withColumn("anomaly", F.coalesce(F.abs("z") > F.lit(z), F.lit(False)))
