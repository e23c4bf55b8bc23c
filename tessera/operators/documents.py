"""Document pipeline: chunk, metadata, quality, incremental skip, version diffs.

Documents are independent, so everything except J1/J2 is a narrow
(per-row) transformation: no shuffle, one document per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

LINE_BREAK = r"\r\n|\n|\r"


def _chunked(docs: DataFrame, keep: list[str], text_col: str, max_length: int) -> DataFrame:
    """``keep``, the text and the array ``chunks``; structured texts split at headings, others by sentence packing.

    Sentences and chunk starts are separate projections, so the sentence
    split runs once per document (HOF lambdas get no common-subexpression
    elimination); one document is one row, no shuffle.
    """
    x = docs.select(*keep, text_col, T.is_structured(text_col).alias("_st"))
    x = x.select("*", F.when(~F.col("_st"), T.sentences(text_col)).alias("_sents"))
    x = x.select("*", T.chunk_starts("_sents", max_length).alias("_starts"))
    chunks = F.when(F.col("_st"), T.structural_chunks(text_col)).otherwise(T.slice_chunks("_sents", "_starts"))
    return x.select(*keep, text_col, chunks.alias("chunks"))


def _chunk_rows(chunked: DataFrame, keep: list[str]) -> DataFrame:
    # posexplode_outer + null filter: a plain posexplode makes Spark infer a size(chunks) > 0 filter
    # that re-runs the whole chunking expression a second time
    return chunked.select(*keep, F.posexplode_outer("chunks").alias("pos", "chunk")).where(F.col("pos").isNotNull()).select(
        *keep, (F.col("pos") + 1).cast("bigint").alias("chunk_no"), "chunk", F.length("chunk").cast("bigint").alias("n_chars")
    )


# F8 (F4-F7)
def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = 1000) -> DataFrame:
    """``doc_id, chunk_no (1-based), chunk, n_chars``."""
    return _chunk_rows(_chunked(docs, [id_col], text_col, max_length), [id_col])


# F9, F9b, F9c
def extract_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Title (HTML ``<title>`` wins for HTML pages), author (always null), ISO date strings."""
    return docs.select(
        id_col,
        T.title(text_col).alias("title"),
        F.lit(None).cast("string").alias("author"),
        T.iso_dates(text_col).alias("dates"),
    )


# G13 (F10-F12)
def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Length, stop-word ratio and repetition over word tokens.

    Stop words are counted with ``StopWordsRemover`` (JVM hash set, case-insensitive).
    """
    from pyspark.ml.feature import StopWordsRemover

    x = docs.select(id_col, F.length(text_col).cast("bigint").alias("n_chars"), T.word_tokens(text_col).alias("words"))
    rem = StopWordsRemover(inputCol="words", outputCol="_kept", stopWords=T.ENGLISH_STOP_WORDS, caseSensitive=False, locale="en_US")
    x = rem.transform(x)
    n = F.size("words")
    return x.select(
        id_col, "n_chars", n.cast("bigint").alias("n_words"),
        F.try_divide((n - F.size("_kept")).cast("double"), n.cast("double")).alias("stop_ratio"),
        T.repetition_score("words").alias("repetition"),
    )


# J1 (+ S9 key)
def skip_processed(new: DataFrame, done_hashes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New content hashes only: copies within the batch collapse to the smallest id; known hashes are skipped.

    Partial aggregation collapses a hot hash (many copies) map-side before the shuffle.
    """
    h = new.select(T.content_hash(text_col).alias("file_hash"), F.col(id_col))
    uniq = h.groupBy("file_hash").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies"))
    return uniq.join(done_hashes.select("file_hash").distinct(), "file_hash", "left_anti")


def lines(c) -> "F.Column":
    """Python ``str.splitlines()`` for \\n, \\r\\n and \\r: no trailing empty line, '' -> []."""
    col = F.col(c) if isinstance(c, str) else c
    body = F.regexp_replace(col, r"(\r\n|\n|\r)$", "")
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def with_previous(versions: DataFrame) -> DataFrame:
    """Previous content per document (``''`` for the first version), one row out for each row in.

    Null ids are one document, a null version comes first, and rows that repeat a
    version follow each other by the hash of their content.

    An ordered scan rather than ``lag`` over a per-document window, so a
    document with a huge number of versions is split over partitions.  The scan
    carries row numbers and hashes only; an equi-join on the row number, written
    with the text so that it stays the same, attaches the text.
    """
    from tessera.operators.sequence import lag_scan
    from tessera.session import materialize

    v = materialize(versions.select("doc_id", "version", "content", F.monotonically_increasing_id().alias("row")), "versions")
    order = lag_scan(v.select("doc_id", "version", F.xxhash64("content").alias("hash"), "row"), "doc_id", ["version", "hash", "row"], "row", "before").select("row", "before")
    before = v.select(F.col("row").alias("before"), F.col("content").alias("prev"))
    return v.join(order, "row").join(before, "before", "left").select("doc_id", "version", "content", F.coalesce("prev", F.lit("")).alias("prev"))


# J2a / X1
def version_line_delta(versions: DataFrame) -> DataFrame:
    """Bag difference of lines between consecutive versions: ``doc_id, version, line, change, n``."""
    v = with_previous(versions)
    sides = [v.select("doc_id", "version", F.explode_outer(lines(c)).alias("line"), F.lit(n).alias("n")) for c, n in (("content", 1), ("prev", -1))]
    # one aggregate over both sides: null ids and versions group like any other, which a join on them would not do
    d = sides[0].unionByName(sides[1]).where(F.col("line").isNotNull()).groupBy("doc_id", "version", "line").agg(F.sum("n").alias("diff"))
    return d.where(F.col("diff") != 0).select(
        "doc_id", "version", "line",
        F.when(F.col("diff") > 0, "added").otherwise("removed").alias("change"),
        F.abs("diff").cast("bigint").alias("n"),
    )


# Hash skip -> chunk -> metadata -> quality, per new content
def process_documents(docs: DataFrame, done_hashes: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_length: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Process only content not seen before.

    Returns ``(summary, chunks)``: one summary row per new content hash
    (representative id, title, dates, chunk count, quality features) and the
    chunk rows of those documents (``file_hash`` and the id first).  The smallest id of
    a hash represents it, a null one only if there is no other; rows that repeat an id
    or a text are one document of that text.  Null texts have no hash and are left out.
    Error rows from ingest should be split off before (``where(error is null)``).
    """
    new = skip_processed(docs, done_hashes, id_col, text_col).where("file_hash is not null")
    new = new.select(F.col("file_hash").alias("_hash"), F.col(id_col).alias("_id"), "n_copies")
    todo = docs.select(T.content_hash(text_col).alias("file_hash"), id_col, text_col)
    todo = todo.join(new, (F.col("file_hash") == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id"))).dropDuplicates(["file_hash"])
    keep = ["file_hash", id_col, "n_copies"]
    chunked = _chunked(todo, keep, text_col, max_length)
    # every value comes from the row's own text: the rest of the row travels as one column, nothing is joined by id
    facts = F.struct(*keep, T.title(text_col).alias("title"), F.lit(None).cast("string").alias("author"), T.iso_dates(text_col).alias("dates"),
                     F.greatest(F.size("chunks"), F.lit(0)).cast("bigint").alias("n_chunks")).alias("facts")
    summary = quality_features(chunked.select(facts, text_col), "facts", text_col).select("facts.*", "n_chars", "n_words", "stop_ratio", "repetition")
    return summary, _chunk_rows(chunked, ["file_hash", id_col])


# M1 / P8
def fit_quality(train: DataFrame, label_col: str = "quality", seed: int = 42):
    """Logistic regression on the three quality features (length, stop-word ratio, repetition)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    feats = ["n_chars_d", "stop_ratio_f", "repetition_f"]
    x = _quality_inputs(train).withColumn("label", F.col(label_col).cast("double"))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=100),
    ])
    return pipe.fit(x)


def _quality_inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars_d", F.col("n_chars").cast("double")).withColumn(
        "stop_ratio_f", F.coalesce("stop_ratio", F.lit(0.0))
    ).withColumn("repetition_f", F.coalesce("repetition", F.lit(0.0)))


def score_quality(model, feats: DataFrame, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_quality_inputs(feats))
    p = vector_to_array("probability")[1]
    return out.select(id_col, p.alias("p_quality"), (p < threshold).alias("low_quality"))
