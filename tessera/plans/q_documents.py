"""Registered document-pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register


@register("doc_chunks")
def doc_chunks(spark, sf_dir):
    return D.chunk_documents(fx.table(spark, sf_dir, "documents"))


@register("page_chunks")
def page_chunks(spark, sf_dir):
    """HTML pages with a line break put before each ``<h1>``: structural chunks."""
    p = fx.table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<h1>"), F.lit("\n<h1>")).alias("html"))
    return D.chunk_documents(p, "page_id", "html")


@register("doc_metadata")
def doc_metadata(spark, sf_dir):
    m = D.extract_metadata(fx.table(spark, sf_dir, "documents"))
    return m.select("doc_id", "title", F.array_join("dates", ",").alias("dates"))


@register("page_metadata")
def page_metadata(spark, sf_dir):
    return D.extract_metadata(fx.table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", F.array_join("dates", ",").alias("dates"))


@register("order_dates")
def order_dates(spark, sf_dir):
    """ISO dates found in order texts built from ``orders``."""
    o = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text")
    )
    return o.select("o_orderkey", F.array_join(T.iso_dates("text"), ",").alias("dates"), T.first_title_line("text").alias("title"))


@register("quality_features")
def quality_features(spark, sf_dir):
    q = D.quality_features(fx.table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_chars", "n_words", round6("stop_ratio").alias("stop_ratio"), round6("repetition").alias("repetition"))


@register("skip_processed")
def skip_processed(spark, sf_dir):
    """Documents whose content hash is new: labelled documents count as already processed."""
    docs = fx.table(spark, sf_dir, "documents")
    done = docs.join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(T.content_hash("text").alias("file_hash"))
    return D.skip_processed(docs, done)


def _versions(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), F.col("text").alias("content"))


@register("version_delta")
def version_delta(spark, sf_dir):
    return D.version_line_delta(_versions(spark, sf_dir))


@register("quality_scores")
def quality_scores(spark, sf_dir):
    feats = D.quality_features(fx.table(spark, sf_dir, "documents"))
    train = feats.join(fx.table(spark, sf_dir, "labels"), "doc_id")
    model = D.fit_quality(train)
    return D.score_quality(model, feats).select("doc_id", round6("p_quality").alias("p_quality"), "low_quality")


@register("processed_documents")
def processed_documents(spark, sf_dir):
    """Batch flow over the document table: labelled documents count as processed; new content is chunked and scored."""
    docs = fx.table(spark, sf_dir, "documents")
    done = docs.join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(T.content_hash("text").alias("file_hash"))
    summary, _ = D.process_documents(docs, done)
    return summary.select("file_hash", "doc_id", "n_copies", "title", "n_chunks", "n_chars", "n_words",
                          round6("stop_ratio").alias("stop_ratio"), round6("repetition").alias("repetition"))
