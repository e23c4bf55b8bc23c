"""Registered monitoring queries (G8, W2, T3 batch form, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import monitoring as M
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register


def _log(spark, sf_dir):
    return fx.search_log(spark, sf_dir).withColumn("day", F.to_date(F.col("ts").cast("timestamp")))


@register("search_metrics")
def search_metrics(spark, sf_dir):
    m = M.search_metrics(_log(spark, sf_dir), "day")
    return m.select("day", "total", "cache_hits", round6("hit_rate").alias("hit_rate"), round6("avg_response_ms").alias("avg_response_ms"))


@register("running_metrics")
def running_metrics(spark, sf_dir):
    r = M.running_metrics(_log(spark, sf_dir), "day", decimals=2)
    return r.select("day", "event_id", "n", round6("running_avg").alias("running_avg"))


@register("request_rate")
def request_rate(spark, sf_dir):
    req = fx.request_log(spark, sf_dir).join(fx.registry(spark).select("model_idx", "model"), "model_idx")
    r = M.request_rate(req, "model")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "n", round6("rate").alias("rate"))


@register("anomalies")
def anomalies(spark, sf_dir):
    """Hourly request counts per event type, z-score against the previous 24 hours."""
    e = fx.table(spark, sf_dir, "events")
    hourly = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    a = M.anomalies(hourly, "event_type", "hour", "n", 24, 3.0)
    return a.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", round6("z").alias("z"), "anomaly")
