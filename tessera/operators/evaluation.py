"""Model evaluation over tables of cases and responses.

Shapes: cases ``case_id, category, input, expected``; responses
``model, case_id, response`` (+ ``run`` for history).  Scores are long form
``(model, dim, metric, score)``; maps exist only for presentation (G20).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

GRID_BUCKETS = 64  # parts by which models meet dimensions

# A metric is a per-response Column over (response, expected) plus an aggregate.
METRICS = {
    "accuracy": lambda r, e: (strip(r) == strip(e)).cast("double"),
}


def batch_evaluate(cases: DataFrame, responses: DataFrame, metrics: dict | None = None, dim_col: str = "category") -> DataFrame:
    """Scores per (model, dim, metric).

    A case a model did not answer counts as a miss: the denominator is the
    number of cases in the dimension, not the number of responses.  Several
    responses to one case count as their mean.  A model has a row for every
    dimension that has cases, with score 0 where it answered none (D10); a null
    dimension or model is one of its own.
    """
    metrics = metrics or METRICS
    n_cases = cases.groupBy(dim_col).agg(F.count(F.lit(1)).alias("n_cases"))
    x = responses.join(cases.select("case_id", dim_col, "expected"), "case_id")
    means = [F.avg(F.coalesce(fn(F.col("response"), F.col("expected")), F.lit(0.0))).alias(name) for name, fn in metrics.items()]
    by_case = x.groupBy("model", dim_col, "case_id").agg(*means, F.count(F.lit(1)).alias("n"))
    got = by_case.groupBy("model", dim_col).agg(*[F.sum(n).alias(n) for n in metrics], F.sum("n").alias("n_responses"))
    # every model meets every dimension, null too, by a shuffle join over buckets of dimensions
    models = responses.select("model").distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(GRID_BUCKETS - 1))))
    grid = models.join(n_cases.withColumn("_bucket", F.pmod(F.xxhash64(dim_col), F.lit(GRID_BUCKETS)).cast("int")), "_bucket").drop("_bucket").alias("g")
    same = F.col("g.model").eqNullSafe(F.col("s.model")) & F.col(f"g.{dim_col}").eqNullSafe(F.col(f"s.{dim_col}"))
    agg = grid.join(got.alias("s"), same, "left").select("g.*", *[F.col(f"s.{n}") for n in [*metrics, "n_responses"]]).fillna(0.0, [*metrics]).fillna(0, ["n_responses"])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(n) / F.col("n_cases")).alias("score")) for n in metrics]))
    return agg.select("model", F.col(dim_col).alias("dim"), "n_cases", "n_responses", stack.alias("m")).select(
        "model", "dim", "m.metric", "m.score", "n_cases", "n_responses"
    )


def consistency(responses: DataFrame) -> DataFrame:
    """Per (model, case): share of responses equal to the most frequent response."""
    c = responses.groupBy("model", "case_id", F.col("response")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("model", "case_id").agg((F.max("n") / F.sum("n")).alias("consistency"))


# G16
def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean ``sum(w*s)/sum(w)`` per model over the dimensions that have a weight."""
    x = scores.join(F.broadcast(weights), "dim")
    return x.groupBy("model").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("composite"))


# G14
def radar(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Models x fixed dimension list, for charting."""
    return scores.groupBy("model").pivot("dim", dims).agg(F.first("score"))


# G20
def result_rows(scores: DataFrame, test_set: str, ts: Column | None = None) -> DataFrame:
    """One evaluation record per model: JSON map of scores, test-set id, timestamp."""
    ts = ts if ts is not None else F.current_timestamp()
    return scores.groupBy("model").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "score"))))).alias("scores")
    ).select("model", "scores", F.to_json(F.create_map(F.lit("test_set"), F.lit(test_set))).alias("metadata"), ts.alias("timestamp"))


# J12 / L3
def recommend(requirements: DataFrame, scores: DataFrame, top_n: int = 3) -> DataFrame:
    """Cosine of each requirement vector with each model's score vector, in long form (no pivot).

    requirements: ``req_id, dim, weight``; scores: ``model, dim, score``.
    Missing dimensions count as 0.  Top ``top_n`` per requirement, ties by model.
    """
    dot = requirements.join(scores, "dim").groupBy("req_id", "model").agg(F.sum(F.col("weight") * F.col("score")).alias("dot"))
    rn = requirements.groupBy("req_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("rn"))
    mn = scores.groupBy("model").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("mn"))
    cos = dot.join(F.broadcast(rn), "req_id").join(F.broadcast(mn), "model").select(
        "req_id", "model", F.try_divide(F.col("dot"), F.col("rn") * F.col("mn")).alias("cosine")
    )
    w = Window.partitionBy("req_id").orderBy(F.col("cosine").desc_nulls_last(), F.col("model"))
    return cos.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= F.lit(top_n))


# W8
def trend(history: DataFrame, window: int = 3) -> DataFrame:
    """Per (model, dim, metric) series over runs: delta to the previous run and moving mean."""
    w = Window.partitionBy("model", "dim", "metric").orderBy("run")
    return history.select(
        "model", "dim", "metric", "run", "score",
        (F.col("score") - F.lag("score").over(w)).alias("delta"),
        F.avg("score").over(w.rowsBetween(-(window - 1), 0)).alias("moving_avg"),
    )


# G21
def strengths(scores: DataFrame) -> DataFrame:
    """Best model per dimension (ties by model name)."""
    w = Window.partitionBy("dim").orderBy(F.col("score").desc(), F.col("model"))
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).select("dim", "model", "score")
