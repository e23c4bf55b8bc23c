"""The training-data pipeline: documents in, encoded documents out.

Every stage works on all that its predecessor kept, which is written as Parquet and
read again in between.  All but the last return the columns of ``documents``.  Null and
empty texts pass all stages (a null text is one empty line after line dedup); repeated
rows are judged each; empty tables give empty results; further columns pass through the
stages before the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, jaccard, lines, queries, toxicity
from tessera.session import materialize


def unused() -> str:
    """A column name that no input has."""
    return f"_{uuid.uuid4().hex}"


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 2 doesn't reject (score below 0.5)."""
    learn = queries.fold(F.col("doc_id"), 5) != 0
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), learn)
    score, lang = unused(), unused()
    return toxicity.score(docs, model, score=score, lang=lang).where(F.col(score) < 0.5).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that operator 8 drops; n_chars counts the text that is left."""
    rest = unused()
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias(rest))
    kept = lines.apply_bitmaps(packed, lines.keep_bitmaps(docs, compressed=True), kept="kept")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*(changed.get(c, F.col(rest)[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of operator 3 the document with the smallest id."""
    gone = jaccard.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 10 finds no benchmark item."""
    matches = unused()
    found = contamination.annotate(docs, queries.table(spark, sf_dir, "benchmark"), matches=matches)
    return found.where(F.size(matches) == 0).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text by operator 1, and whether they decode to it."""
    ranks = queries.vocabulary(spark)
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), ranks, queries.PATTERN, decoded="decoded")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return tokens.select("doc_id", "lang", "source", "n_chars", *bpe.digests(), whole.alias("decodes"), "ids")


STAGES = [
    ("toxicity", queries.prepared(toxic_documents)),
    ("line_dedup", queries.prepared(repeated_lines)),
    ("ngram_jaccard_join", queries.prepared(near_duplicates)),
    ("benchmark_decontamination", queries.prepared(contaminated)),
    ("byte_level_bpe", queries.prepared(encoded)),
]

#: SQL can't express the classifier of the first stage; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
