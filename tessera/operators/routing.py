"""Replay of routed model requests: cache, registry, quality gate, budget, spend, metrics.

The reference couples cache -> budget -> quality per request inside one
process.  Here the log is staged: TTL cache replay (W3) -> registry lookup (J3)
-> quality gate (G11/P5) -> budget admission (W4) -> status, each a
distributed operator over the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import sequence as S
from tessera.plans.guards import bounded_broadcast
from tessera.session import materialize

QUALITY_THRESHOLD = 0.5
CACHE_TTL = 3600
DAILY_BUDGET = "100"


# F16
def input_features(req: DataFrame, col: str = "input") -> DataFrame:
    return req.withColumn("length", F.length(col).cast("bigint")).withColumn("special_chars", T.special_char_count(col).cast("bigint"))


# F17
def fit_tfidf(corpus: DataFrame, col: str = "input", vocab: int = 1000):
    """TF-IDF over whitespace tokens, fit on the corpus (not on one input), L2-normalised."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer

    tok = SQLTransformer(statement=f"SELECT *, filter(split({col}, '\\\\s+'), t -> t != '') AS _tokens FROM __THIS__")
    return Pipeline(stages=[
        tok, CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=vocab),
        IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="tfidf", p=2.0),
    ]).fit(corpus)


def tfidf_weights(corpus: DataFrame, key: str = "input_id", col: str = "input", vocab: int = 1000) -> DataFrame:
    """F17 with its weights: ``key``, ``weights`` (term -> weight), one row per key.

    The vocabulary is the ``vocab`` terms that occur most often in the corpus (ties by term).
    A weight is the term's count times ``ln((1 + n) / (1 + df)) + 1``, then each row is scaled
    to length 1.  Rows that repeat a key are one text; a null key is a key of its own; a text
    that is null or has no term of the vocabulary has an empty map, and counts in n.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"\s+"), lambda t: t != "")
    counts = corpus.select(key, F.explode_outer(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = materialize(counts, "tfidf-counts")
    n = counts.agg(F.count_distinct(F.struct(key))).first()[0]
    terms = counts.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = terms.orderBy(F.desc("total"), "term").limit(vocab).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    x = counts.join(bounded_broadcast(kept, 100_000), "term", "left")
    weight = F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))
    by_key = x.groupBy(key).agg(F.array_sort(F.collect_list(weight)).alias("ws"))  # at most vocab terms a key
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    return by_key.select(key, norm.alias("norm"), "ws").select(key, F.map_from_entries(F.transform("ws", lambda e: F.struct(e["term"], e["w"] / F.col("norm")))).alias("weights"))


# M3
def fit_selector(train: DataFrame, features: str = "embedding", label: str = "label", trees: int = 100, seed: int = 42):
    """Random forest over embedding vectors -> model class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = train.withColumn("features", array_to_vector(features)).withColumn(label, F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(x)


# L4
def select_model(model, req: DataFrame, registry: DataFrame | None = None, features: str = "embedding") -> DataFrame:
    """Arg-max class and its probability; class index -> registry row when given."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(req.withColumn("features", array_to_vector(features)))
    p = vector_to_array("probability")
    out = out.withColumn("confidence", F.array_max(p)).withColumn("model_idx", (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    out = out.drop("features", "rawPrediction", "probability", "prediction")
    if registry is not None:
        out = out.join(F.broadcast(registry.select("model_idx", "model")), "model_idx", "left")
    return out


# J3
def with_registry(req: DataFrame, registry: DataFrame, on: str = "model_idx") -> DataFrame:
    """Registry lookup (broadcast: the registry is a bounded dimension)."""
    return req.join(bounded_broadcast(registry, 100_000), on, "left")


# G11
def response_quality(embedding: Column) -> Column:
    return T.vector_mean(embedding)


# P5 + W3 + J3 + W4
def route_log(req: DataFrame, registry: DataFrame, quality: Column, ttl: int = CACHE_TTL, budget: str = DAILY_BUDGET,
              threshold: float = QUALITY_THRESHOLD, key: Column | None = None) -> DataFrame:
    """Status per request: ``cache_hit`` | ``unknown_model`` | ``budget_exceeded`` | ``quality_failed`` | ``ok``.

    Quality-failed requests pass the budget check but add no spend (D19);
    every cache miss is stored (D18).
    """
    key = key if key is not None else F.md5(F.col("input"))
    base = req.withColumn("cache_key", key).withColumn("quality", quality)
    cache = S.ttl_cache_replay(base.select("cache_key", "req_id", "ts"), "cache_key", ttl)
    x = base.join(cache.select("req_id", "hit", "served_by"), "req_id")
    x = with_registry(x, registry)
    miss = x.where(~F.col("hit") & F.col("cost").isNotNull()).select(
        "req_id", "ts", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "cost", (F.col("quality") >= threshold).alias("quality_ok")
    )
    adm = S.admit_by_budget(miss, budget, key="day", cost="cost", spends="quality_ok")
    x = x.join(adm.select("req_id", "admitted", "spent_before"), "req_id", "left")
    status = (
        F.when(F.col("hit"), "cache_hit")
        .when(F.col("cost").isNull(), "unknown_model")
        .when(~F.col("admitted"), "budget_exceeded")
        .when(F.col("quality") < threshold, "quality_failed")
        .otherwise("ok")
    )
    return x.withColumn("status", status).withColumn("day", F.to_date(F.col("ts").cast("timestamp")))


# G6
def spending_report(routed: DataFrame) -> DataFrame:
    """Spend of admitted, quality-passed calls: rollup (day, model) with grouping level."""
    ok = routed.where(F.col("status") == "ok")
    return ok.rollup("day", "model").agg(
        F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("level")
    )


# W1 / G7
def model_performance(calls: DataFrame, model: str = "model", ts: str = "ts", rid: str = "req_id") -> DataFrame:
    """Per call, in time order per model: calls so far, success-rate EWMA and mean latency, exactly as the recurrence.

    success: ``r <- 0.9 r + 0.1``; failure: ``r <- 0.9 r``; start 1.0.
    latency (successes only, n counts every call): ``a <- (a (n-1) + x) / n``.  A success
    without a latency leaves the mean as it is; a null success is a failure.
    """
    base = calls.select(model, ts, rid, F.coalesce("success", F.lit(False)).alias("success"), "latency")
    ew = S.affine_scan(base.withColumn("_a", F.lit(0.9)).withColumn("_b", F.when(F.col("success"), 0.1).otherwise(0.0)),
                       model, [ts, rid], "_a", "_b", 1.0, [model, rid, ts, "success", "latency"])
    ew = ew.withColumnRenamed("value", "success_rate").withColumnRenamed("idx", "n")
    n = F.col("n").cast("double")
    ew = ew.withColumns({"_ok": F.col("success") & F.col("latency").isNotNull(), "latency": F.coalesce("latency", F.lit(0.0))})
    lat = ew.withColumn("_a", F.when(F.col("_ok"), (n - 1) / n).otherwise(1.0)).withColumn(
        "_b", F.when(F.col("_ok"), F.col("latency") / n).otherwise(0.0))
    out = S.affine_scan(lat, model, [ts, rid], "_a", "_b", 0.0, [model, rid, ts, "n", "success", "success_rate"],
                        mean_of=("n", "latency", "_ok"))
    return out.withColumnRenamed("value", "avg_latency").drop("idx")


def model_summary(perf: DataFrame, model: str = "model") -> DataFrame:
    """Final state per model."""
    last = F.struct("n", "success_rate", "avg_latency")
    return perf.groupBy(model).agg(F.max_by(last, F.col("n")).alias("s"), F.count_if(~F.col("success")).alias("failures")).select(
        model, F.col("s.n").alias("calls"), "failures", F.col("s.success_rate").alias("success_rate"), F.col("s.avg_latency").alias("avg_latency")
    )


# G18
def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, col: str, bounds: list[float]) -> DataFrame:
    """Cumulative ``le`` buckets (Prometheus style): count of rows with value <= bound, plus ``+Inf``."""
    agg = [F.count_if(F.col(col) <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(bounds)] + [F.count(F.lit(1)).alias("le_inf")]
    row = df.agg(*agg)
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.le", "e.n")


# J13 / G12 / U1
def run_workflow(inputs: DataFrame, steps: DataFrame, fn, workflow: str, max_steps: int = 1000) -> DataFrame:
    """Each input through every step of ``workflow``: prompt ``step:input`` to the step's model, merged with blank lines.

    Steps are a bounded dimension (checked), attached by exploding a literal
    step array, so no join with all pairs is planned.  Every step sees the
    original input (D13).
    """
    from tessera.operators.hooks import batch_invoke
    from tessera.plans.guards import collect_bounded

    st = collect_bounded(steps.where(F.col("workflow") == workflow).orderBy("pos"), max_steps, "workflow steps")
    arr = F.array(*[F.struct(F.lit(int(r.pos)).alias("pos"), F.lit(r.step).alias("step"), F.lit(r.model).alias("model")) for r in st.itertuples()])
    x = inputs.select("input_id", "input", F.explode(arr).alias("s")).select(
        "input_id", "input", "s.pos", F.col("s.model").alias("model"), F.concat(F.col("s.step"), F.lit(":"), F.col("input")).alias("prompt")
    )
    resp = batch_invoke(x, fn, "response string")
    return resp.groupBy("input_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "response"))), lambda e: e["response"]), "\n\n").alias("result"),
        F.count("response").alias("n_steps"),
    )


# M5
def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams (the whole string when shorter than n)."""
    return F.array_distinct(F.when(F.length(c) <= n, F.array(c)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))))


def similar_inputs(req: DataFrame, threshold: float = 0.8, col: str = "input", n: int = 3) -> DataFrame:
    """Pairs of distinct inputs whose shingle sets have Jaccard similarity >= ``threshold`` (exact).

    Prefix-filtered set-similarity join: exact copies are collapsed first; every
    set is ordered by global token frequency (rarest first); two sets can reach
    the threshold only if their prefixes of length ``|s| - ceil(t*|s|) + 1``
    share a token, so candidates come from an equi-join on prefix tokens and
    are verified exactly.  No false negatives, no all-pairs join.
    """
    d = req.groupBy(col).agg(F.count(F.lit(1)).alias("n_requests")).select(
        F.md5(col).alias("h"), col, "n_requests", shingles(F.col(col), n).alias("toks"))
    freq = d.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    ranked = d.select("h", F.explode("toks").alias("tok")).join(freq, "tok").groupBy("h").agg(
        F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("ordered"))
    sz = F.size("ordered")
    plen = sz - F.ceil(F.lit(threshold) * sz - F.lit(1e-9)).cast("int") + 1
    pref = ranked.select("h", F.explode(F.slice("ordered", 1, plen)).alias("e")).select("h", F.col("e.tok").alias("tok"))
    cand = pref.alias("a").join(pref.alias("b"), "tok").where(F.col("a.h") < F.col("b.h")).select(
        F.col("a.h").alias("ha"), F.col("b.h").alias("hb")).distinct()
    sa = d.select(F.col("h").alias("ha"), F.col(col).alias("input_a"), F.col("toks").alias("ta"))
    sb = d.select(F.col("h").alias("hb"), F.col(col).alias("input_b"), F.col("toks").alias("tb"))
    x = cand.join(sa, "ha").join(sb, "hb")
    inter = F.size(F.array_intersect("ta", "tb"))
    jac = inter / (F.size("ta") + F.size("tb") - inter)
    return x.select("input_a", "input_b", jac.alias("jaccard")).where(F.col("jaccard") >= F.lit(threshold))
