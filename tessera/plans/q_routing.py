"""Registered routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.operators import hooks as H
from tessera.operators import routing as Rt
from tessera.operators import sequence as S
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register

BUDGET = "0.5"  # per UTC day; the reference's 100 is never reached by the fixture (about 0.9 a day)
QUALITY_SCALE = 50.0  # request quality stand-in = value / 50
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5]


def _requests(spark, sf_dir):
    return fx.request_log(spark, sf_dir)


def _routed(spark, sf_dir):
    req = _requests(spark, sf_dir)
    return Rt.route_log(req, fx.registry(spark), F.col("value") / QUALITY_SCALE, ttl=3600, budget=BUDGET)


@register("ttl_cache")
def ttl_cache(spark, sf_dir):
    req = _requests(spark, sf_dir).withColumn("cache_key", F.md5("input"))
    return S.ttl_cache_replay(req, "cache_key", 3600).select("cache_key", "req_id", "ts", "hit", "served_by")


@register("budget_admission")
def budget_admission(spark, sf_dir):
    req = Rt.with_registry(_requests(spark, sf_dir), fx.registry(spark))
    req = req.select("req_id", "ts", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "cost",
                     (F.col("value") / QUALITY_SCALE >= 0.5).alias("quality_ok"))
    return S.admit_by_budget(req, BUDGET, key="day", cost="cost", spends="quality_ok")


@register("route_log")
def route_log(spark, sf_dir):
    return _routed(spark, sf_dir).select("req_id", "day", "model", "status")


@register("spending_report")
def spending_report(spark, sf_dir):
    r = Rt.spending_report(_routed(spark, sf_dir))
    return r.select("day", "model", F.col("spend").cast("decimal(18,6)").alias("spend"), "calls", F.col("level").cast("bigint").alias("level"))


@register("outcome_counts")
def outcome_counts(spark, sf_dir):
    return Rt.outcome_counts(_routed(spark, sf_dir))


def _calls(spark, sf_dir):
    req = Rt.with_registry(_requests(spark, sf_dir), fx.registry(spark))
    return req.select("model", "req_id", "ts", "success", "latency")


@register("model_performance")
def model_performance(spark, sf_dir):
    p = Rt.model_performance(_calls(spark, sf_dir))
    return p.select("model", "req_id", "n", round6("success_rate").alias("success_rate"), round6("avg_latency").alias("avg_latency"))


@register("model_summary")
def model_summary(spark, sf_dir):
    s = Rt.model_summary(Rt.model_performance(_calls(spark, sf_dir)))
    return s.select("model", "calls", "failures", round6("success_rate").alias("success_rate"), round6("avg_latency").alias("avg_latency"))


@register("latency_histogram")
def latency_histogram(spark, sf_dir):
    return Rt.latency_histogram(_requests(spark, sf_dir), "latency", LATENCY_BOUNDS)


def _user_inputs(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(F.concat_ws("-", "conv_id", "turn").alias("input_id"), F.col("text").alias("input"))


@register("workflow_runs")
def workflow_runs(spark, sf_dir):
    return Rt.run_workflow(_user_inputs(spark, sf_dir), fx.workflow_steps(spark), H.stub_model, "text_generation")


@register("input_features")
def input_features(spark, sf_dir):
    return Rt.input_features(_user_inputs(spark, sf_dir)).select("input_id", "length", "special_chars")


@register("tfidf_features")
def tfidf_features(spark, sf_dir):
    """TF-IDF (1000 terms) fit on all user inputs; number of non-zero weights per input."""
    inputs = _user_inputs(spark, sf_dir)
    model = Rt.fit_tfidf(inputs)
    from pyspark.ml.functions import vector_to_array

    out = model.transform(inputs)
    return out.select("input_id", F.size(F.filter(vector_to_array("tfidf"), lambda v: v != 0)).cast("bigint").alias("n_terms"))


@register("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    """The weights themselves (1000 terms, smoothed idf, unit length), one row per user input and term."""
    w = Rt.tfidf_weights(_user_inputs(spark, sf_dir), vocab=1000)
    return w.select("input_id", F.explode("weights").alias("term", "weight")).select("input_id", "term", round6("weight").alias("weight"))


@register("model_selector")
def model_selector(spark, sf_dir):
    """Random forest on embeddings -> model index, name and confidence for every vector."""
    emb = fx.table(spark, sf_dir, "embeddings")
    model = Rt.fit_selector(emb, "embedding", "label", trees=100)
    out = Rt.select_model(model, emb, fx.registry(spark))
    return out.select("vec_id", "label", "model_idx", "model", round6("confidence").alias("confidence"))


@register("similar_inputs")
def similar_inputs(spark, sf_dir):
    """Request inputs with character-trigram Jaccard >= 0.6 to another distinct input (M5, exact)."""
    r = Rt.similar_inputs(_requests(spark, sf_dir), 0.6, "input", 3)
    a = F.least("input_a", "input_b")
    b = F.greatest("input_a", "input_b")
    return r.select(a.alias("input_a"), b.alias("input_b"), round6("jaccard").alias("jaccard"))
