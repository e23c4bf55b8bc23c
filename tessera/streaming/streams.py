"""Structured Streaming forms of the stateful operators.

Event time: ``timestamp_ntz`` columns are cast to ``timestamp`` (watermarks
need it; the session time zone is UTC) and cast back on output.

Stateful per-key logic uses ``applyInPandasWithState``: rows of a key inside
one micro-batch are sorted by (event time, id) and folded into the state, so
arrival order across micro-batches must respect event time (late rows are
the watermark's business).  The ``ordered_`` forms hold rows back until the watermark
passes them, so files out of order within the watermark give the batch result, and end
their state by event-time timers (``transformWithStateInPandas``; they need the RocksDB
state store).  Batch equivalents: W3 (TTL), W1 (model metrics),
W4 (budget), W5 (sessions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

#: Micros of a day.
DAY = 86_400_000_000


def _ts(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# T1
def stream_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Closed sessions per user (append mode): start, end, size, sorted distinct event types."""
    e = _ts(events, ts).withWatermark(ts, watermark)
    return e.groupBy(user, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("items")
    ).select(user, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events", "items")


# T2
def stream_ttl(req: DataFrame, key: str, ttl_seconds: int, ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour") -> DataFrame:
    """Exact TTL cache replay per key with keyed state (expiry, storing request)."""
    ttl = ttl_seconds * 1_000_000
    x = _ts(req, ts).withWatermark(ts, watermark).select(key, rid, ts, F.unix_micros(ts).alias("_t"))

    def fn(k, pdfs, state):
        exp, sid = state.get if state.exists else (None, None)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", rid], kind="stable")
        hit, served = [], []
        for t, r in zip(pdf["_t"].to_numpy(np.int64), pdf[rid].to_numpy(np.int64)):
            if exp is not None and t < exp:
                hit.append(True)
                served.append(sid)
            else:
                exp, sid = int(t) + ttl, int(r)
                hit.append(False)
                served.append(sid)
        state.update((exp, sid))
        yield pd.DataFrame({key: pdf[key].to_numpy(), rid: pdf[rid].to_numpy(), "hit": hit, "served_by": served})

    out_schema = f"{key} {x.schema[key].dataType.simpleString()}, {rid} long, hit boolean, served_by long"
    return x.groupBy(key).applyInPandasWithState(fn, out_schema, "expiry long, served_by long", "append", GroupStateTimeout.NoTimeout)


def stream_ttl_loose(req: DataFrame, key: str, ttl: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The loose form: the requests that run, as Spark's duplicate suppression within the watermark sees them.

    State is one expiry a key and ends behind the watermark.  No two requests of a key that
    come out lie closer than ``ttl``.  Unlike ``stream_ttl`` a request may be suppressed for
    longer, until the watermark (greatest event time less ``ttl``, moved between micro-batches)
    passes the stored one's expiry, and the first to arrive is stored, not the first in time.
    """
    return _ts(req, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


class OrderedFold(StatefulProcessor):
    """Holds a key's rows until the watermark passes them, then folds them in (event time, id) order.

    ``fold(state, rows)`` takes the state (None at first) and tuples ``(t, id, ...)`` with t in
    micros, and returns the new state and one output tuple a row, without the key.
    ``expires(key, state)`` gives the time in micros at which the state may go, or None.  Rows
    behind the watermark are dropped by Spark, which counts them (``numRowsDroppedByWatermark``);
    rows without a time take no part.
    """

    def __init__(self, fold, columns: list[str], row_schema: str, state_schema: str, out_names: list[str], expires=None) -> None:
        self.fold, self.columns, self.row_schema, self.state_schema, self.out_names, self.expires = fold, columns, row_schema, state_schema, out_names, expires

    def init(self, handle) -> None:
        self.handle = handle
        self.rows, self.state = handle.getListState("rows", self.row_schema), handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for pdf in rows for r in pdf[self.columns].astype(object).itertuples(index=False)]
        self.rows.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.rows.get()]
        ready, later = sorted(r for r in held if r[0] <= passed), [r for r in held if r[0] > passed]
        if ready:
            state, out = self.fold(self.state.get() if self.state.exists() else None, ready)
            self.state.update(state)
            self.rows.put(later) if later else self.rows.clear()
            yield pd.DataFrame([(*key, *o) for o in out], columns=self.out_names)
        if later:
            self._wake(min(r[0] for r in later))
        end = self.expires(key, self.state.get()) if self.expires and self.state.exists() else None
        if end is not None and end <= passed:
            if not later:
                self.state.clear()
        elif end is not None:
            self._wake(end)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def close(self) -> None:
        pass


def _ordered(x: DataFrame, key: str, rid: str, fold, more: list[str], state_schema: str, out: str, expires=None) -> DataFrame:
    columns = ["at_us", rid, *more]
    row_schema = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in columns)
    out_schema = f"{key} {x.schema[key].dataType.simpleString()}, {rid} long, {out}"
    names = [key, rid, *(c.split()[0] for c in out.split(", "))]
    return x.where(F.col("at_us").isNotNull()).groupBy(key).transformWithStateInPandas(OrderedFold(fold, columns, row_schema, state_schema, names, expires), out_schema, "Append", "EventTime")


def ordered_ttl(req: DataFrame, key: str, ttl_seconds: int, ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour") -> DataFrame:
    """``stream_ttl`` for files out of order within the watermark; an entry's state ends when the watermark passes its expiry."""
    ttl = ttl_seconds * 1_000_000
    x = _ts(req, ts).withWatermark(ts, watermark).select(key, F.col(rid).cast("long").alias(rid), ts, F.unix_micros(ts).alias("at_us"))

    def fold(state, rows):
        expiry, sid = state or (None, None)
        out = []
        for t, r in rows:
            hit = expiry is not None and t < expiry
            if not hit:
                expiry, sid = t + ttl, r
            out.append((r, hit, sid))
        return (expiry, sid), out

    return _ordered(x, key, rid, fold, [], "expiry long, served_by long", "hit boolean, served_by long", lambda k, s: s[0])


# T3
def stream_rate(req: DataFrame, by: str = "model", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Requests per second over a 5-minute window sliding by 1 minute."""
    x = _ts(req, ts).withWatermark(ts, watermark)
    return x.groupBy(F.window(ts, "5 minutes", "1 minute").alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", (F.col("n") / F.lit(300.0)).alias("rate"))


# T4
def stream_model_metrics(calls: DataFrame, model: str = "model", ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour") -> DataFrame:
    """Per call: calls so far, success EWMA (0.9/0.1, start 1.0) and mean latency, with keyed state."""
    x = _ts(calls, ts).withWatermark(ts, watermark).select(model, rid, ts, "success", "latency")

    def fn(k, pdfs, state):
        n, r, a = state.get if state.exists else (0, 1.0, 0.0)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, rid], kind="stable")
        ns, rs, as_ = [], [], []
        for ok, lat in zip(pdf["success"].to_numpy(bool), pdf["latency"].to_numpy(np.float64)):
            n += 1
            if ok:
                a = (a * (n - 1) + lat) / n
                r = 0.9 * r + 0.1
            else:
                r = 0.9 * r
            ns.append(n)
            rs.append(r)
            as_.append(a)
        state.update((n, r, a))
        yield pd.DataFrame({model: pdf[model].to_numpy(), rid: pdf[rid].to_numpy(), "n": ns, "success_rate": rs, "avg_latency": as_})

    out_schema = f"{model} string, {rid} long, n long, success_rate double, avg_latency double"
    return x.groupBy(model).applyInPandasWithState(fn, out_schema, "n long, r double, a double", "append", GroupStateTimeout.NoTimeout)


def ordered_model_metrics(calls: DataFrame, model: str = "model", ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour") -> DataFrame:
    """``stream_model_metrics`` for files out of order within the watermark; the running values of a model don't end.

    A successful call without a latency counts as a call and leaves the mean as it is.
    """
    x = _ts(calls, ts).withWatermark(ts, watermark).select(
        model, F.col(rid).cast("long").alias(rid), ts, F.unix_micros(ts).alias("at_us"), F.coalesce("success", F.lit(False)).alias("ok"), F.coalesce(F.col("latency").cast("double"), F.lit(-1.0)).alias("lat"))

    def fold(state, rows):
        n, rate, mean = state or (0, 1.0, 0.0)
        out = []
        for _, r, ok, lat in rows:
            n += 1
            mean = (mean * (n - 1) + lat) / n if ok and lat >= 0 else mean
            rate = 0.9 * rate + (0.1 if ok else 0.0)
            out.append((r, n, rate, mean))
        return (n, rate, mean), out

    return _ordered(x, model, rid, fold, ["ok", "lat"], "n long, r double, a double", "n long, success_rate double, avg_latency double")


# T5
def stream_spend(calls: DataFrame, model: str = "model", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Daily spend per model (tumbling 1-day windows)."""
    x = _ts(calls, ts).withWatermark(ts, watermark)
    return x.groupBy(F.window(ts, "1 day").alias("w"), model).agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("calls")).select(
        F.to_date("w.start").alias("day"), model, "spend", "calls")


def stream_admission(req: DataFrame, budget: str, ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour", scale: int = 1_000_000) -> DataFrame:
    """Daily budget admission with keyed state (spent so far, integer units); spend counts only ``spends`` rows."""
    bud = int(round(float(budget) * scale))
    x = _ts(req, ts).withWatermark(ts, watermark).select(
        F.to_date(ts).alias("day"), rid, ts, F.round(F.col("cost").cast("decimal(38,9)") * scale).cast("long").alias("_c"),
        F.coalesce(F.col("spends"), F.lit(True)).alias("_s"))

    def fn(k, pdfs, state):
        spent = state.get[0] if state.exists else 0
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, rid], kind="stable")
        adm, before = [], []
        for c, s in zip(pdf["_c"].to_numpy(np.int64), pdf["_s"].to_numpy(bool)):
            before.append(spent)
            ok = spent + c <= bud
            adm.append(ok)
            if ok and s:
                spent += int(c)
        state.update((spent,))
        yield pd.DataFrame({"day": pdf["day"].to_numpy(), rid: pdf[rid].to_numpy(), "admitted": adm, "spent_before": before})

    return x.groupBy("day").applyInPandasWithState(fn, f"day date, {rid} long, admitted boolean, spent_before long", "spent long",
                                                   "append", GroupStateTimeout.NoTimeout)


def ordered_admission(req: DataFrame, budget: str, ts: str = "ts", rid: str = "req_id", watermark: str = "1 hour", scale: int = 1_000_000_000) -> DataFrame:
    """``stream_admission`` for files out of order within the watermark, exact to nine decimals; a day's state ends a day after it began, by the watermark."""
    bud = int(round(float(budget) * scale))
    x = _ts(req, ts).withWatermark(ts, watermark).select(
        F.to_date(ts).alias("day"), F.col(rid).cast("long").alias(rid), ts, F.unix_micros(ts).alias("at_us"),
        F.round(F.col("cost").cast("decimal(38,9)") * scale).cast("long").alias("units"), F.coalesce(F.col("spends"), F.lit(True)).alias("counts"))

    def fold(state, rows):
        spent, day_end = state or (0, (rows[0][0] // DAY + 1) * DAY)
        out = []
        for _, r, cost, spends in rows:
            ok = spent + cost <= bud
            out.append((r, ok, spent))
            spent += cost if ok and spends else 0
        return (spent, day_end), out

    return _ordered(x, "day", rid, fold, ["units", "counts"], "spent long, day_end long", "admitted boolean, spent_before long", lambda k, s: s[1])


# T6
def stream_feedback(fb: DataFrame, snapshot_dir: str, checkpoint: str, trigger: dict | None = None):
    """Upsert latest feedback per document into versioned parquet snapshots (``snapshot_dir/v=<epoch>``)."""
    from tessera.operators.retrieval import latest_feedback
    from tessera.sources.stores import missing

    def merge(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        try:
            prev = spark.read.parquet(snapshot_dir)
            prev = prev.where(F.col("v") == prev.select(F.max("v")).scalar()).drop("v")
            prev_rows = prev.select("doc_id", "score", "ts", F.lit(-1).cast("bigint").alias("event_id"))
        except AnalysisException as e:
            if not missing(e):
                raise
            prev_rows = None  # first batch
        rows = batch.select("doc_id", "score", "ts", "event_id")
        allr = rows if prev_rows is None else prev_rows.unionByName(rows)
        latest_feedback(allr).drop("n_feedback").write.mode("overwrite").parquet(f"{snapshot_dir}/v={epoch}")

    w = fb.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# T7
def stream_ingest(spark, src_dir: str, store: str, checkpoint: str, trigger: dict | None = None, rejects: str | None = None):
    """Incremental ingest: new files -> parse -> skip known hashes -> append to the processed store (J1 + S9).

    Files that can't be parsed are rows (path, ext, file_hash, error) of ``rejects``, by default
    ``<store>_rejects``; a replayed micro-batch writes its folder again.
    """
    rejects = rejects or store.rstrip("/") + "_rejects"
    from tessera.sources.files import parse_binary_rows
    from tessera.sources.stores import save_processed

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(src_dir)

    def each(batch: DataFrame, epoch: int):
        parsed = parse_binary_rows(batch).persist()
        try:
            save_processed(parsed.where(F.col("error").isNull()), store)
            parsed.where(F.col("error").isNotNull()).select("path", "ext", "file_hash", "error").write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
        finally:
            parsed.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# T8
def stream_search_metrics(log: DataFrame, ts: str = "ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Per tumbling window: searches, cache hits, mean response time (update mode)."""
    x = _ts(log, ts).withWatermark(ts, watermark)
    return x.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("cache_hit").alias("cache_hits"), F.avg("response_ms").alias("avg_response_ms")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "total", "cache_hits", "avg_response_ms")
