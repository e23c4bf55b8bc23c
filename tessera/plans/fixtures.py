"""Adapters from the driver's tables to the shapes the operators take.

Every adapter reads the given parquet tables and derives its input with Spark
expressions, so the work of every registered query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.guards import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Model registry of the routing module (name, cost per call, type), in its order.
MODEL_REGISTRY = [
    ("gpt-3.5", "0.002", "text"),
    ("claude-2", "0.0018", "text"),
    ("stable-diffusion", "0.005", "image"),
    ("whisper", "0.003", "audio"),
    ("palm-2", "0.0015", "text"),
]

# Role -> permissions of the tool-governance module.
ROLE_PERMISSIONS = [
    ("admin", ["*"]),
    ("developer", ["api:access", "data:process"]),
    ("guest", ["basic:read"]),
]

# Workflow steps (workflow, position, step, model).
WORKFLOW_STEPS = [
    ("text_generation", 1, "preprocess", "claude-2"),
    ("text_generation", 2, "generate", "gpt-3.5"),
    ("text_generation", 3, "refine", "palm-2"),
    ("question_answering", 1, "retrieve", "claude-2"),
    ("question_answering", 2, "analyze", "gpt-3.5"),
    ("question_answering", 3, "verify", "palm-2"),
]


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; text tables get spread (by their key) when the scan has too few splits."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, [TEXT_TABLES[name]]) if name in TEXT_TABLES else df


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, n, c, t) for i, (n, c, t) in enumerate(MODEL_REGISTRY)],
        "model_idx int, model string, cost string, type string",
    ).withColumn("cost", F.col("cost").cast("decimal(9,6)"))


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_PERMISSIONS, "role string, perms array<string>")


def workflow_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORKFLOW_STEPS, "workflow string, pos int, step string, model string")


# ---- retrieval stand-ins

def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), "lang", "n_chars")


def search_queries(spark, sf_dir) -> DataFrame:
    """Whole benchmark texts as queries; no KB restriction."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array().cast("array<string>").alias("kb_ids")
    )


def kb_queries(spark, sf_dir) -> DataFrame:
    """Queries restricted to one knowledge base: the source of the document sharing the query's id."""
    q = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return q.join(d, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("source").isNull(), F.array().cast("array<string>")).otherwise(F.array("source")).alias("kb_ids"),
    )


def mixed_queries(spark, sf_dir) -> DataFrame:
    """Queries with a mode (by id: hybrid, semantic, bm25) and a top_k (1 to 10) each."""
    mode = F.element_at(F.array(F.lit("hybrid"), F.lit("semantic"), F.lit("bm25")), (F.col("query_id") % 3 + 1).cast("int"))
    return search_queries(spark, sf_dir).withColumns({"mode": mode, "top_k": (F.col("query_id") % 10 + 1).cast("int")})


def doc_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dvec"))


def query_vectors(spark, sf_dir) -> DataFrame:
    """The stored vector with ``vec_id = item_id`` stands in for the encoded query."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def feedback_from_labels(spark, sf_dir) -> DataFrame:
    """score = 1 + 4*quality - toxic, clamped to 1..5."""
    l = table(spark, sf_dir, "labels")
    return l.select("doc_id", F.greatest(F.lit(1), F.lit(1) + 4 * F.col("quality") - F.col("toxic")).cast("int").alias("score"))


def feedback_events(spark, sf_dir) -> DataFrame:
    """Last-write-wins feedback stream: ``doc_id = user_id``, score ``1 + event_id % 5``."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("doc_id"), (F.lit(1) + F.pmod("event_id", F.lit(5))).cast("int").alias("score"))


def search_log(spark, sf_dir) -> DataFrame:
    """Search log: query = event_type, response time = value, cache hit when ``event_id % 4 = 0``."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("query"), F.col("value").alias("response_ms"),
                    (F.pmod("event_id", F.lit(4)) == 0).alias("cache_hit"))


# ---- routing stand-ins

def request_log(spark, sf_dir) -> DataFrame:
    """Routed requests: input = props, latency = value/1000 s, success unless error, model = event_id % 5."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("req_id"), "ts", "user_id", F.col("props").alias("input"),
        (F.col("value") / 1000.0).alias("latency"), (F.col("event_type") != "error").alias("success"),
        F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx"), "value",
    )


# ---- evaluation stand-ins

def eval_cases(spark, sf_dir) -> DataFrame:
    """User turn = input, next assistant turn = expected; category from the turn number."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), "conv_id", "turn", "input", "expected",
        F.concat(F.lit("cat"), F.pmod("turn", F.lit(3)).cast("string")).alias("category"),
    )


def eval_responses(spark, sf_dir, n_models: int = 5) -> DataFrame:
    """Model m answers a case correctly iff ``(conv_id*31 + turn*7) % 10 >= m``."""
    cases = eval_cases(spark, sf_dir)
    models = F.sequence(F.lit(0), F.lit(n_models - 1))
    x = cases.select("case_id", "conv_id", "turn", "expected", F.explode(models).alias("m"))
    ok = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(10)) >= F.col("m")
    return x.select(
        F.concat(F.lit("model-"), F.col("m").cast("string")).alias("model"), "case_id",
        F.when(ok, F.concat(F.lit("  "), F.col("expected"), F.lit("\n"))).otherwise(F.lit("I do not know.")).alias("response"),
        F.pmod("conv_id", F.lit(5)).cast("int").alias("run"),
    )
