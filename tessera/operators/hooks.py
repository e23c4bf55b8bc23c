"""Pluggable calls (U1, U4): model invocation and embedding over batches.

``fn`` takes a pandas DataFrame batch and returns a pandas Series (or, for
``embed``, a Series of lists).  One client per partition; failures become a
per-row ``error`` column instead of failing the job.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty


def batch_invoke(df: DataFrame, fn, schema: str = "response string") -> DataFrame:
    """Arrow-batched call of ``fn(batch) -> Series``, with ``error`` and ``latency`` (seconds) for each row.

    If a batch fails, its rows are called one by one, so that a failing row has a
    null result and its error, and the others their results.  The latency of a row
    called in a batch is its share of the batch's time.
    """
    out_field = Ty._parse_datatype_string(schema)
    name = out_field.fields[0].name if isinstance(out_field, Ty.StructType) else "response"
    out_schema = Ty.StructType(list(df.schema.fields) + [
        Ty.StructField(name, out_field.fields[0].dataType if isinstance(out_field, Ty.StructType) else out_field),
        Ty.StructField("error", Ty.StringType()), Ty.StructField("latency", Ty.DoubleType()),
    ])

    def call(pdf):
        began = time.perf_counter()
        try:
            res, error = pd.Series(list(fn(pdf)), index=pdf.index), None
        except Exception as e:  # noqa: BLE001 - told row by row
            if len(pdf) > 1:
                return pd.concat([call(pdf.iloc[i : i + 1]) for i in range(len(pdf))])
            res, error = pd.Series([None], index=pdf.index, dtype=object), f"{type(e).__name__}: {e}"
        return pdf.assign(**{name: res, "error": error, "latency": (time.perf_counter() - began) / max(1, len(pdf))})

    def run(it):
        for pdf in it:
            yield call(pdf)

    return df.mapInPandas(run, out_schema)


def stub_model(batch: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in for a model call: ``<model> response to <prompt>``."""
    return batch["model"].astype(str) + " response to " + batch["prompt"].astype(str)


def embed(df: DataFrame, fn, col: str = "text", out: str = "embedding") -> DataFrame:
    """U4: embedding hook; ``fn(Series[str]) -> Series[list[float]]``."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<float>")
    def _embed(s: pd.Series) -> pd.Series:
        return fn(s)

    return df.withColumn(out, _embed(F.col(col)))
