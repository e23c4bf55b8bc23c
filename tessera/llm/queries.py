"""One query for each operator of ``llm``, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audit, bpe, contamination, exact, html, jaccard, licenses, lines, periods, pii, quality, substrings, toxicity
from tessera.session import ensure_checkpoint_dir, materialize, ship_package

#: The vocabulary of operator 1 (another rank file and pattern can be given to ``bpe``).
RANK_FILE, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def vocabulary(spark: SparkSession):
    return bpe.vocabulary_bytes(spark, public_tokenizers.path(RANK_FILE))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(spark)
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN, decoded="decoded")
    return tokens.select("doc_id", *bpe.digests())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_lang")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans; ``spans`` has the added ones too, and ``n_added`` their number."""
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.ORDER]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"), added)


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is the older half of the ids, the incoming rows are the younger one; every row is in the result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    out = exact.dedup(docs.where(~old), docs.where(old))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, compressed=True))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_base``, the first and last word and ``base_labels`` are of the phrases; ``labels`` and ``score`` of all templates."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["template"] < len(licenses.PHRASES))
    listed = lambda found: F.array_join(F.array_sort(F.array_distinct(found["label"])), ",")
    starts = base["first_word"]
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0)).alias("score"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The words that operator 13's query reads: of one document in ten (by a hash of its id) the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # an array of one, so that the words are split once and not for every place
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    changed = (h % 10 == 0) & F.col("text").isNotNull()
    return docs.select("doc_id", F.when(changed, F.get(F.transform(words, repeated), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.find(with_planted_runs(table(spark, sf_dir, "documents")))
    out = out.withColumn("top", periods.best(F.col("runs")))
    exponent = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    out = out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", exponent,
        F.sha2(periods.written(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return materialize(out, "periods", periods.READ)  # the texts pass a few at a time


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_toxicity, op3_jaccard, op4_quality, op5_pii, op6_exact, op7_html, op8_lines, op9_substrings, op10_contamination, op11_audit, op12_licenses, op13_periods)
}


def prepared(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same with the package on the executors and a checkpoint folder set."""

    def run(spark: SparkSession, *args) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, *args)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: prepared(fn) for name, fn in QUERIES.items()}
