"""Registered behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.operators import behavior as Bh
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register

SALT = "tessera-session-salt"


@register("sessions")
def sessions(spark, sf_dir):
    s = Bh.sessionize(fx.table(spark, sf_dir, "events"), 1800, SALT)
    return s.select("event_id", "user_id", "ts", "event_type", "session_id", "session_start")


@register("session_summary")
def session_summary(spark, sf_dir):
    s = Bh.sessionize(fx.table(spark, sf_dir, "events"), 1800, SALT)
    b = Bh.session_baskets(s, 1800)
    return b.select("user_id", "session_id", "session_start", "session_end", "n_events", F.array_join("items", ",").alias("items"))


@register("frequent_patterns")
def frequent_patterns(spark, sf_dir):
    """FP-growth over 12-hour sessions, minimum support 0.05."""
    s = Bh.sessionize(fx.table(spark, sf_dir, "events"), 12 * 3600, SALT)
    fp = Bh.frequent_patterns(Bh.session_baskets(s, 12 * 3600), 0.05)
    return fp.select(F.array_join("items", ",").alias("items"), "freq", round6("support").alias("support"))
