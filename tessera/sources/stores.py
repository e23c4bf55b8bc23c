"""Tables that the pipelines append to and read back.

All writes are appends of new rows only (idempotent by key where a key
exists), in parquet, to folders given by the caller.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

TEST_CASE = Ty.StructType([
    Ty.StructField("input", Ty.StringType()),
    Ty.StructField("expected", Ty.StringType()),
    Ty.StructField("difficulty", Ty.StringType()),
    Ty.StructField("category", Ty.StringType()),
    Ty.StructField("criteria", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("evaluator", Ty.StringType()),
])

EVENT_SCHEMA = "user_id string, ts timestamp, event_type string, metadata string"
FEEDBACK_SCHEMA = "user_id string, query string, doc_id string, score int, ts timestamp"
SEARCH_LOG_SCHEMA = "ts timestamp, query string, mode string, kb_ids array<string>, n_results int, duration_ms double, cache_hit boolean"


# S6
def read_test_sets(spark: SparkSession, path: str) -> DataFrame:
    """Test-set JSON files (``{test_set: [case, ...]}``) -> one row per case with its position.

    Files that can't be read as such are rows of ``rejected_test_sets``.
    """
    x = _test_set_files(spark, path).select(F.explode("sets").alias("test_set", "cases"))
    return x.select("test_set", F.posexplode("cases").alias("pos", "case")).select("test_set", "pos", "case.*")


def rejected_test_sets(spark: SparkSession, path: str) -> DataFrame:
    """path, test_set, error of every file (test_set null) or test set of a file that gives no cases because it is malformed."""
    files = _test_set_files(spark, path)
    whole = files.where(F.col("sets").isNull()).select("path", F.lit(None).cast("string").alias("test_set"), F.lit("malformed test set file").alias("error"))
    sets = files.select("path", F.explode("sets").alias("test_set", "cases")).where(F.col("cases").isNull())
    return whole.union(sets.select("path", "test_set", F.lit("test set is not a list of cases").alias("error")))


def _test_set_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", Ty.MapType(Ty.StringType(), Ty.ArrayType(TEST_CASE)))
    return raw.select(F.col("_metadata.file_path").alias("path"), m.alias("sets"))


def missing(e: AnalysisException) -> bool:
    """Whether a read failed because there is nothing yet; all other errors are real."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# S9
def save_processed(processed: DataFrame, store: str) -> DataFrame:
    """Append rows whose ``file_hash`` is not in the store yet; returns the rows written."""
    spark = processed.sparkSession
    try:
        known = spark.read.parquet(store).select("file_hash")
        new = processed.join(known, "file_hash", "left_anti")
    except AnalysisException as e:
        if not missing(e):
            raise
        new = processed
    new = new.dropDuplicates(["file_hash"])
    new.write.mode("append").parquet(store)
    return new


def load_processed(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON document per row (``to_json``), as line-delimited text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


# S11
def run_logged(hits: DataFrame, sink, log: str, query: str, mode: str, kb_ids: list[str] | None = None, cache_hit: bool = False) -> dict:
    """Run a search by ``sink`` (an action on its hits, such as a write) and append its log record.

    The number of results is observed while the sink runs, so the search is not run again for
    it.  A sink that fails leaves no record.  Returns the record (``SEARCH_LOG_SCHEMA``).
    """
    spark = hits.sparkSession
    seen = Observation()
    at, began = dt.datetime.now(dt.timezone.utc), time.monotonic()
    sink(hits.observe(seen, F.count(F.lit(1)).alias("n_results")))
    record = {"ts": at, "query": query, "mode": mode, "kb_ids": kb_ids, "n_results": seen.get["n_results"],
              "duration_ms": (time.monotonic() - began) * 1000, "cache_hit": cache_hit}
    append(spark.createDataFrame([tuple(record.values())], SEARCH_LOG_SCHEMA), log)
    return record


def read_search_log(spark: SparkSession, log: str) -> DataFrame:
    """The records as input of the search metrics (``response_ms`` is the duration)."""
    return spark.read.schema(SEARCH_LOG_SCHEMA).parquet(log).withColumn("response_ms", F.col("duration_ms"))


# S7 / S10 / S11
def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT_SCHEMA).parquet(path)
