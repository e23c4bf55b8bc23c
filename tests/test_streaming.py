"""Stream = batch on the same rows (sf0.001 events split into time-ordered files, one file per micro-batch)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import behavior as Bh
from tessera.operators import retrieval as R
from tessera.operators import routing as Rt
from tessera.operators import sequence as S
from tessera.plans import fixtures as fx
from tessera.streaming import streams as St


@pytest.fixture(scope="module")
def event_dir(spark):
    import tempfile

    d = tempfile.mkdtemp(prefix="tessera-stream-")
    ev = fx.table(spark, SF_SMALL, "events")
    days = sorted(r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())
    chunks = [days[i:i + 6] for i in range(0, len(days), 6)]
    for i, ch in enumerate(chunks):
        ev.where(F.to_date("ts").isin(ch)).coalesce(1).write.parquet(os.path.join(d, f"part{i:02d}"))
    far = dt.datetime(2030, 1, 1)
    for j in range(2):  # sentinels: advance the watermark, then let a later batch emit closed windows
        sent = spark.createDataFrame([(10**9 + j, far + dt.timedelta(days=j), -1, "sentinel", 0.0, '{"k": -1}')], ev.schema)
        sent.coalesce(1).write.parquet(os.path.join(d, f"part{len(chunks) + j:02d}"))
    return d, ev.schema


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stream(spark, event_dir):
    d, schema = event_dir
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)


def test_stream_ttl_equals_batch(spark, event_dir):
    s = _stream(spark, event_dir).where("user_id >= 0")
    req = s.select(F.col("event_id").alias("req_id"), "ts", F.md5("props").alias("cache_key"))
    got = {(r.req_id, r.hit, r.served_by) for r in _run(spark, St.stream_ttl(req, "cache_key", 3600), "ttl_s").collect()}
    b = fx.request_log(spark, SF_SMALL).withColumn("cache_key", F.md5("input"))
    want = {(r.req_id, r.hit, r.served_by) for r in S.ttl_cache_replay(b, "cache_key", 3600).collect()}
    assert got == want


def test_stream_model_metrics_equals_batch(spark, event_dir):
    s = _stream(spark, event_dir).where("user_id >= 0")
    reg = fx.registry(spark).select("model_idx", "model")
    calls = s.select(F.col("event_id").alias("req_id"), "ts", (F.col("event_type") != "error").alias("success"),
                     (F.col("value") / 1000.0).alias("latency"), F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx")).join(reg, "model_idx")
    got = {r.req_id: (r.n, round(r.success_rate, 9), round(r.avg_latency, 9)) for r in _run(spark, St.stream_model_metrics(calls), "mm_s").collect()}
    b = Rt.with_registry(fx.request_log(spark, SF_SMALL), fx.registry(spark)).select("model", "req_id", "ts", "success", "latency")
    want = {r.req_id: (r.n, round(r.success_rate, 9), round(r.avg_latency, 9)) for r in Rt.model_performance(b).collect()}
    assert got == want


def test_stream_sessions_equal_batch(spark, event_dir):
    s = _stream(spark, event_dir)
    got = {(r.user_id, r.session_start, r.n_events) for r in _run(spark, St.stream_sessions(s, "30 minutes", "1 hour"), "sess_s").collect()
           if r.user_id >= 0}
    b = Bh.session_baskets(Bh.sessionize(fx.table(spark, SF_SMALL, "events"), 1800, "x"), 1800)
    want = {(r.user_id, r.session_start, r.n_events) for r in b.collect()}
    assert got == want


def test_stream_admission_equals_batch(spark, event_dir):
    s = _stream(spark, event_dir).where("user_id >= 0")
    reg = fx.registry(spark).select("model_idx", "cost")
    req = s.select(F.col("event_id").alias("req_id"), "ts", F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx"),
                   (F.col("value") / 50.0 >= 0.5).alias("spends")).join(reg, "model_idx")
    got = {(r.req_id, r.admitted) for r in _run(spark, St.stream_admission(req, "0.05"), "adm_s").collect()}
    b = Rt.with_registry(fx.request_log(spark, SF_SMALL), fx.registry(spark)).select(
        "req_id", "ts", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "cost", (F.col("value") / 50.0 >= 0.5).alias("spends"))
    want = {(r.req_id, r.admitted) for r in S.admit_by_budget(b, "0.05", key="day", cost="cost", spends="spends").collect()}
    assert got == want


def test_stream_feedback_snapshot_is_latest(spark, event_dir, tmpdir_path):
    s = _stream(spark, event_dir).where("user_id >= 0")
    fb = s.select("event_id", "ts", F.col("user_id").alias("doc_id"), (F.lit(1) + F.pmod("event_id", F.lit(5))).cast("int").alias("score"))
    snap = os.path.join(tmpdir_path, "snap")
    q = St.stream_feedback(fb, snap, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    last = spark.read.parquet(snap)
    last = last.where(F.col("v") == last.select(F.max("v")).scalar())
    got = {(r.doc_id, r.score, r.ts) for r in last.collect()}
    want = {(r.doc_id, r.score, r.ts) for r in R.latest_feedback(fx.feedback_events(spark, SF_SMALL)).collect()}
    assert got == want


def test_stream_ingest_skips_known_hashes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for name, body in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"one"), ("d.bin", b"?")):
        with open(os.path.join(src, name), "wb") as fh:
            fh.write(body)
    store = os.path.join(tmpdir_path, "store")
    St.stream_ingest(spark, src, store, os.path.join(tmpdir_path, "ck")).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert sorted(r.content for r in rows) == ["one", "two"]


def test_stream_rate_equals_batch(spark, event_dir):
    from tessera.operators import monitoring as M

    s = _stream(spark, event_dir)
    reg = fx.registry(spark).select("model_idx", "model")
    req = s.select("ts", F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx"), "user_id").join(reg, "model_idx")
    got = {(r.window_start, r.model, r.n) for r in _run(spark, St.stream_rate(req), "rate_s").collect()
           if r.window_start.year < 2029}
    b = fx.request_log(spark, SF_SMALL).join(reg, "model_idx")
    want = {(r.window_start.replace(tzinfo=None), r.model, r.n) for r in M.request_rate(b).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model", "n").collect()}
    assert got == want


def test_stream_search_metrics_equals_batch(spark, event_dir):
    s = _stream(spark, event_dir).where("user_id >= 0")
    log = s.select("ts", F.col("value").alias("response_ms"), (F.pmod("event_id", F.lit(4)) == 0).alias("cache_hit"))
    got = {(r.window_start, r.total, r.cache_hits) for r in _run(spark, St.stream_search_metrics(log), "sm_s", "update").collect()}
    b = fx.search_log(spark, SF_SMALL).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cache_hit").alias("hits"))
    want = {(r.h, r.n, r.hits) for r in b.collect()}
    assert got == want


def test_stream_spend_equals_batch(spark, event_dir):
    s = _stream(spark, event_dir)  # sentinels stay in: they advance the watermark past the last day
    reg = fx.registry(spark).select("model_idx", "model", "cost")
    calls = s.select("ts", F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx")).join(reg, "model_idx")
    got = {(r.day, r.model, str(r.spend), r.calls) for r in _run(spark, St.stream_spend(calls), "spend_s").collect() if r.day.year < 2029}
    b = fx.request_log(spark, SF_SMALL).join(reg, "model_idx").groupBy(F.to_date(F.col("ts").cast("timestamp")).alias("day"), "model").agg(
        F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("calls"))
    want = {(r.day, r.model, str(r.spend), r.calls) for r in b.collect()}
    assert got == want


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def mixed_dir(spark):
    """The events of sf0.001 in files out of order, then the sentinels, each file a micro-batch."""
    import tempfile

    d = tempfile.mkdtemp(prefix="tessera-mixed-")
    ev = fx.table(spark, SF_SMALL, "events")
    for i in range(3):
        ev.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.parquet(os.path.join(d, f"part{i:02d}"))
    far = dt.datetime(2030, 1, 1)
    for j in range(2):
        sent = spark.createDataFrame([(10**9 + j, far + dt.timedelta(days=800 * j), -1, "sentinel", 0.0, '{"k": -1}')], ev.schema)
        sent.coalesce(1).write.parquet(os.path.join(d, f"part{9 + j:02d}"))
    return d, ev.schema


def test_ordered_ttl_of_mixed_files_equals_batch(spark, mixed_dir, rocksdb):
    req = _stream(spark, mixed_dir).select(F.col("event_id").alias("req_id"), "ts", F.when(F.col("user_id") < 0, "end").otherwise(F.pmod("user_id", F.lit(5)).cast("string")).alias("cache_key"))
    rows = _run(spark, St.ordered_ttl(req, "cache_key", 3600, watermark="700 days"), "ottl_s").where("req_id < 1000000000").collect()
    got = {(r.req_id, r.hit, r.served_by) for r in rows}
    b = fx.table(spark, SF_SMALL, "events").select(F.col("event_id").alias("req_id"), "ts", F.pmod("user_id", F.lit(5)).cast("string").alias("cache_key"))
    want = {(r.req_id, r.hit, r.served_by) for r in S.ttl_cache_replay(b, "cache_key", 3600).collect()}
    assert len(rows) == len(got) and got == want
    assert any(hit for _, hit, _ in got)


def test_ordered_state_ends_behind_the_watermark(spark, tmpdir_path, rocksdb):
    """Late rows are dropped and counted, and the state of expired entries goes."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "req_id long, ts timestamp, cache_key string"
    batches = [[(i, t0 + dt.timedelta(seconds=i), f"k{i}") for i in range(20)], [(100, t0 + dt.timedelta(days=1), "x")],
               [(101, t0 + dt.timedelta(seconds=5), "k5"), (102, t0 + dt.timedelta(days=2), "x")], [(103, t0 + dt.timedelta(days=3), "x")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(tmpdir_path, f"part{i}"))
    req = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(tmpdir_path)
    q = St.ordered_ttl(req, "cache_key", 60, watermark="10 seconds").writeStream.format("memory").queryName("oend_s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.req_id for r in spark.table("oend_s").collect()}
    assert set(range(20)) <= out and 101 not in out
    operators = [p.stateOperators[0] for p in q.recentProgress]
    assert sum(o.numRowsDroppedByWatermark for o in operators) == 1


def test_ordered_metrics_and_admission_of_mixed_files_equal_batch(spark, mixed_dir, rocksdb):
    s = _stream(spark, mixed_dir)
    reg = fx.registry(spark).select("model_idx", "model", "cost")
    req = s.select(F.col("event_id").alias("req_id"), "ts", (F.col("event_type") != "error").alias("success"), (F.col("value") / 1000.0).alias("latency"),
                   F.pmod("event_id", F.lit(5)).cast("int").alias("model_idx"), (F.col("value") / 50.0 >= 0.5).alias("spends")).join(reg, "model_idx")
    rows = _run(spark, St.ordered_model_metrics(req, watermark="700 days"), "omm_s").where("req_id < 1000000000").collect()
    got = {r.req_id: (r.n, round(r.success_rate, 9), round(r.avg_latency, 9)) for r in rows}
    b = Rt.with_registry(fx.request_log(spark, SF_SMALL), fx.registry(spark))
    want = {r.req_id: (r.n, round(r.success_rate, 9), round(r.avg_latency, 9)) for r in Rt.model_performance(b.select("model", "req_id", "ts", "success", "latency")).collect()}
    assert got == want
    got = {(r.req_id, r.admitted) for r in _run(spark, St.ordered_admission(req, "0.05", watermark="700 days"), "oadm_s").collect() if r.req_id < 10**9}
    b = b.select("req_id", "ts", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "cost", (F.col("value") / 50.0 >= 0.5).alias("spends"))
    want = {(r.req_id, r.admitted) for r in S.admit_by_budget(b, "0.05", key="day", cost="cost", spends="spends").collect()}
    assert got == want


def test_loose_ttl_keeps_requests_apart(spark, event_dir):
    s = _stream(spark, event_dir).where("user_id >= 0").select(F.col("event_id").alias("req_id"), "ts", F.pmod("user_id", F.lit(5)).alias("cache_key"))
    kept = sorted((r.cache_key, r.ts, r.req_id) for r in _run(spark, St.stream_ttl_loose(s, "cache_key", "1 hour"), "loose_s").collect())
    assert all(a[0] != b[0] or b[1] - a[1] >= dt.timedelta(hours=1) for a, b in zip(kept, kept[1:]))
    b = fx.table(spark, SF_SMALL, "events").select(F.col("event_id").alias("req_id"), "ts", F.pmod("user_id", F.lit(5)).alias("cache_key"))
    exact = S.ttl_cache_replay(b, "cache_key", 3600).where("not hit").count()
    assert 5 <= len(kept) <= exact


def test_stream_ingest_keeps_rejects(spark, tmpdir_path):
    src, store = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "store")
    os.makedirs(src)
    for name, body in (("a.txt", b"one"), ("d.bin", b"?"), ("e.docx", b"no zip")):
        with open(os.path.join(src, name), "wb") as fh:
            fh.write(body)
    St.stream_ingest(spark, src, store, os.path.join(tmpdir_path, "ck")).awaitTermination()
    assert [r.content for r in spark.read.parquet(store).collect()] == ["one"]
    rejects = spark.read.parquet(store + "_rejects").collect()
    assert sorted(r.ext for r in rejects) == [".bin", ".docx"] and all(r.error for r in rejects)
