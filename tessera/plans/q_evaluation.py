"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.operators import evaluation as E
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register

DIMS = ["cat0", "cat1", "cat2"]
WEIGHTS = [("cat0", 0.5), ("cat1", 0.3), ("cat2", 0.2)]
REQUIREMENTS = [(1, "cat0", 1.0), (1, "cat1", 0.0), (1, "cat2", 0.0), (2, "cat0", 0.2), (2, "cat1", 0.3), (2, "cat2", 0.5)]


def _scores(spark, sf_dir):
    s = E.batch_evaluate(fx.eval_cases(spark, sf_dir), fx.eval_responses(spark, sf_dir))
    return s.where(F.col("metric") == "accuracy")


@register("eval_scores")
def eval_scores(spark, sf_dir):
    s = E.batch_evaluate(fx.eval_cases(spark, sf_dir), fx.eval_responses(spark, sf_dir))
    return s.select("model", "dim", "metric", round6("score").alias("score"), "n_cases", "n_responses")


@register("eval_composite")
def eval_composite(spark, sf_dir):
    w = spark.createDataFrame(WEIGHTS, "dim string, weight double")
    return E.composite(_scores(spark, sf_dir), w).select("model", round6("composite").alias("composite"))


@register("eval_radar")
def eval_radar(spark, sf_dir):
    r = E.radar(_scores(spark, sf_dir), DIMS)
    return r.select("model", *[round6(d).alias(d) for d in DIMS])


@register("eval_recommend")
def eval_recommend(spark, sf_dir):
    req = spark.createDataFrame(REQUIREMENTS, "req_id int, dim string, weight double")
    r = E.recommend(req, _scores(spark, sf_dir), 3)
    return r.select(F.col("req_id").cast("bigint").alias("req_id"), "rank", "model", round6("cosine").alias("cosine"))


@register("eval_strengths")
def eval_strengths(spark, sf_dir):
    return E.strengths(_scores(spark, sf_dir)).select("dim", "model", round6("score").alias("score"))


@register("eval_trend")
def eval_trend(spark, sf_dir):
    """History: one run per ``conv_id % 5`` group of cases."""
    cases = fx.eval_cases(spark, sf_dir)
    resp = fx.eval_responses(spark, sf_dir)
    hist = (
        resp.join(cases.select("case_id", "expected"), "case_id")
        .groupBy("model", "run")
        .agg(F.avg((E.strip(F.col("response")) == E.strip(F.col("expected"))).cast("double")).alias("score"))
        .select("model", F.lit("all").alias("dim"), F.lit("accuracy").alias("metric"), F.col("run").cast("bigint").alias("run"), "score")
    )
    t = E.trend(hist, 3)
    return t.select("model", "run", round6("score").alias("score"), round6("delta").alias("delta"), round6("moving_avg").alias("moving_avg"))


@register("eval_results")
def eval_results(spark, sf_dir):
    return E.result_rows(_scores(spark, sf_dir).select("model", "dim", round6("score").alias("score")), "conversations", F.lit("2024-01-01T00:00:00")).select("model", "scores", "metadata")
