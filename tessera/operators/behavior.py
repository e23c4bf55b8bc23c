"""User behaviour: sessions with inactivity expiry, baskets, frequent patterns.

Sessionisation is an ordered parallel scan (see ``sequence``): events are
range-partitioned by (user, time), so a user holding a large share of all
events never lands in one task; the previous event time and current session
start are carried across partition borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sequence as S


def sessionize(events: DataFrame, gap_seconds: int = 1800, salt: str = "", user_col: str = "user_id", ts_col: str = "ts",
               id_col: str = "event_id", n_parts: int | None = None) -> DataFrame:
    """Per-event session assignment (W5) with a pseudonymous id.

    A gap ``>= gap_seconds`` since the user's previous event starts a new
    session.  ``session_id = sha256(user-start_micros || salt)``.  Runs as an
    ordered parallel scan over (user, time), so a user with a large share of
    all events is split over many partitions.
    """
    s = S.session_starts(events, user_col, gap_seconds, ts_col, id_col, n_parts)
    start = F.col("session_start_us")
    sid = F.sha2(F.concat(F.concat_ws("-", F.col(user_col).cast("string"), start.cast("string")), F.lit(salt)), 256)
    return s.withColumn("session_id", sid).withColumn(
        "session_start", F.timestamp_micros(start).cast(events.schema[ts_col].dataType)).drop("session_start_us")


# G3
def session_baskets(sessions: DataFrame, gap_seconds: int = 1800, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """One row per session: size, span, sorted distinct event types.  Partial aggregation makes a huge session cheap."""
    return sessions.groupBy(user_col, "session_id", "session_start").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.max(ts_col) + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("session_end"),
        F.array_sort(F.collect_set("event_type")).alias("items"),
    )


# G4
def frequent_patterns(baskets: DataFrame, min_support: float = 0.05, items_col: str = "items") -> DataFrame:
    """FP-growth (Spark ML, parallel FP-growth) -> ``items`` (sorted), ``freq``, ``support``."""
    from pyspark.ml.fpm import FPGrowth

    n = baskets.select(F.count(F.lit(1))).scalar()
    model = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=1.0).fit(baskets.select(items_col))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint").alias("freq"), (F.col("freq") / n).alias("support"))


def session_window_summary(events: DataFrame, gap: str = "30 minutes", user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Built-in ``session_window`` form of the same sessions (aggregates only; used by the stream T1)."""
    return events.groupBy(user_col, F.session_window(F.col(ts_col).cast("timestamp"), gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("items")
    ).select(user_col, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "items")
