"""Hand-computed unit tables and naive-loop equivalence for the custom operators."""

import datetime as dt
import io
import json
import math
import os
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import behavior as Bh
from tessera.operators import clustering as C
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import governance as G
from tessera.operators import monitoring as M
from tessera.operators import retrieval as R
from tessera.operators import routing as Rt
from tessera.operators import segments as SG
from tessera.operators import sequence as S
from tessera.sources import files as FS
from tessera.sources import stores as ST

T0 = dt.datetime(2024, 1, 1)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


# ---------------------------------------------------------------- chunking / metadata

def test_structural_chunks_preamble_and_heading_first(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny"), (2, "# A\nx\n  # B  \nz")], "doc_id long, text string")
    out = {(r.doc_id, r.chunk_no): r.chunk for r in D.chunk_documents(df).collect()}
    assert out == {(1, 1): "intro", (1, 2): "# A\nx", (1, 3): "## B\ny", (2, 1): "# A\nx", (2, 2): "  # B  \nz"}


def test_sentence_packing_oversized_first_and_empty(spark):
    big = "A" * 1200 + "."
    df = spark.createDataFrame([(1, big + " Short one. Two."), (2, ""), (3, "   ")], "doc_id long, text string")
    out = sorted((r.doc_id, r.chunk_no, r.chunk) for r in D.chunk_documents(df).collect())
    assert out == [(1, 1, big), (1, 2, "Short one. Two.")]


def test_sentence_packing_limit_is_inclusive(spark):
    s1, s2, s3 = "a" * 499 + ".", "b" * 499 + ".", "c."
    df = spark.createDataFrame([(1, f"{s1} {s2} {s3}")], "doc_id long, text string")
    out = [r.chunk for r in D.chunk_documents(df).orderBy("chunk_no").collect()]
    assert out == [f"{s1} {s2}", s3]  # 500 + 500 = 1000 fits; + 2 overflows


def test_title_and_html_title(spark):
    df = spark.createDataFrame([
        (1, "\n   \n" + "x" * 120 + "\n  Real title  \nbody"),
        (2, '<html lang="en"><head><title>A &amp; B &lt;C&gt;</title></head></html>'),
        (3, "<HTML><title></title></HTML>\nFallback"),
        (4, "no html <title>T</title>"),
    ], "doc_id long, text string")
    out = {r.doc_id: r.title for r in D.extract_metadata(df).collect()}
    assert out[1] == "Real title"
    assert out[2] == "A & B <C>"
    assert out[3] is None  # an empty <title> on an HTML page gives no title
    assert out[4] == "no html <title>T</title>"


def test_quality_features_edges(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT!"), (2, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in D.quality_features(df).collect()}
    # tokens: The cat , the CAT !  -> stop words: The, the
    assert out[1].n_words == 6 and out[1].stop_ratio == pytest.approx(2 / 6)
    assert out[1].repetition == pytest.approx(1 - 6 / 6)
    assert out[2].n_words == 0 and out[2].stop_ratio is None and out[2].repetition is None


def test_version_delta_duplicates_and_moves(spark):
    v = spark.createDataFrame([(1, 1, "a\nb\nb"), (1, 2, "b\na\nc")], "doc_id long, version long, content string")
    out = sorted((r.version, r.line, r.change, r.n) for r in D.version_line_delta(v).collect())
    assert out == [(1, "a", "added", 1), (1, "b", "added", 2), (2, "b", "removed", 1), (2, "c", "added", 1)]


def test_version_delta_null_and_repeated_versions(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (1, 3, "b\nc"), (2, None, "x"), (2, 1, "x\ny"), (None, 1, "n"), (None, 2, "n\nm"), (None, None, "k"), (3, 1, None), (3, 2, "z")]
    v = spark.createDataFrame(rows, "doc_id long, version long, content string").repartition(3)
    got = D.with_previous(v).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + tuple(x or "" for x in r[2:])
    assert sorted(map(tuple, got), key=key) == sorted([
        (1, 1, "a", ""), (1, 2, "b", "a"), (1, 2, "b", "b"), (1, 3, "b\nc", "b"), (2, None, "x", ""), (2, 1, "x\ny", "x"),
        (None, None, "k", ""), (None, 1, "n", "k"), (None, 2, "n\nm", "n"), (3, 1, None, ""), (3, 2, "z", ""),
    ], key=key)
    out = {(r.doc_id, r.version, r.line, r.change, r.n) for r in D.version_line_delta(v).collect()}
    assert out == {
        (1, 1, "a", "added", 1), (1, 2, "b", "added", 1), (1, 2, "a", "removed", 1), (1, 3, "c", "added", 1), (2, None, "x", "added", 1), (2, 1, "y", "added", 1),
        (None, None, "k", "added", 1), (None, 1, "n", "added", 1), (None, 1, "k", "removed", 1), (None, 2, "m", "added", 1), (3, 2, "z", "added", 1),
    }


def test_skip_processed_copies_and_known(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "doc_id long, text string")
    done = spark.createDataFrame([(T_md5("z"),)], "file_hash string")
    out = sorted((r.doc_id, r.n_copies) for r in D.skip_processed(new, done).collect())
    assert out == [(1, 2), (3, 1)]


def T_md5(s):
    import hashlib
    return hashlib.md5(s.encode()).hexdigest()


# ---------------------------------------------------------------- retrieval

def brute_bm25(corpus, query, k1=1.5, b=0.75, eps=0.25):
    toks = [d.split() for d in corpus]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        tf = Counter(t)
        s = 0.0
        for q in query.split():
            f = tf.get(q, 0)
            s += idf.get(q, 0) * (f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avgdl)))
        out.append(s)
    return out


def test_bm25_matches_brute_force(spark):
    corpus = ["a b c a", "b b d", "c e", "f g h", "a a a a b", ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(1, "a b b", []), (2, "zzz", [])], "query_id long, query string, kb_ids array<string>")
    found = SG.raw_best(SG.build(docs), q.withColumnRenamed("kb_ids", "kb"), 100)
    got = {(r.query_id, r.doc_id): r.raw for r in found.collect()}
    want = brute_bm25(corpus, "a b b")
    for d, s in enumerate(want):
        if s > 0:
            assert got[(1, d)] == pytest.approx(s)
    hits = R.bm25_search(q, docs, k=3).collect()
    by_q = {}
    for r in hits:
        by_q.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert [d for _, d, _ in sorted(by_q[2])] == [0, 1, 2]  # no match: constant 0.5, ties by doc id
    assert all(s == 0.5 for _, _, s in by_q[2])
    top = sorted(by_q[1])[0]
    assert top[1] == max(range(len(want)), key=lambda i: (want[i], -i)) and top[2] == 1.0


def test_kb_filter_restricts_corpus(spark):
    docs = spark.createDataFrame([(0, "a", "kb1"), (1, "a a", "kb2"), (2, "b", "kb1")], "doc_id long, text string, source string")
    q = spark.createDataFrame([(1, "a", ["kb1"])], "query_id long, query string, kb_ids array<string>")
    out = sorted((r.rank, r.doc_id) for r in R.bm25_search(q, docs, k=10).collect())
    assert [d for _, d in out] == [0, 2]


def test_top_k_plans_window_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    plan = R.top_k(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hybrid_plan_has_no_cartesian(spark):
    from tessera.plans import fixtures as fx
    from conftest import SF_SMALL

    docs = fx.documents(spark, SF_SMALL)
    h = R.hybrid_search(fx.search_queries(spark, SF_SMALL), docs, fx.query_vectors(spark, SF_SMALL), fx.doc_vectors(spark, SF_SMALL), k=5)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---------------------------------------------------------------- sessions

def test_sessionize_gap_exactly_30_minutes_and_bucket_carry(spark):
    rows = [(1, 1, ts(0)), (2, 1, ts(1799)), (3, 1, ts(1799 + 1800)), (4, 1, ts(1799 + 1800 + 7200)), (5, 2, ts(10))]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").withColumn("event_type", F.lit("view"))
    for parts in (1, 3, 5):  # sessions must not depend on how the scan is partitioned
        s = {r.event_id: r.session_start for r in Bh.sessionize(ev, 1800, "salt", n_parts=parts).collect()}
        assert s[1] == s[2] == ts(0)
        assert s[3] == ts(3599)
        assert s[4] == ts(3599 + 7200)
        assert s[5] == ts(10)


# ---------------------------------------------------------------- ordered scans vs naive loops

def naive_ttl(events, ttl):
    out, state = {}, {}
    for key, t, rid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        exp, sid = state.get(key, (None, None))
        if exp is not None and t < exp:
            out[rid] = (True, sid)
        else:
            state[key] = (t + ttl, rid)
            out[rid] = (False, rid)
    return out


def test_ttl_replay_equals_naive_loop_with_hot_key(spark):
    rnd = random.Random(7)
    ev = []
    for rid in range(3000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}"
        ev.append((key, rnd.randint(0, 200_000), rid))
    ev.append(("edge", 0, 10_000))
    ev.append(("edge", 3600, 10_001))  # exactly at expiry -> miss
    ev.append(("edge", 3601, 10_002))
    df = spark.createDataFrame([(k, ts(t), r) for k, t, r in ev], "key string, ts timestamp_ntz, req_id long")
    got = {r.req_id: (r.hit, r.served_by) for r in S.ttl_cache_replay(df, "key", 3600, n_parts=7).collect()}
    want = naive_ttl([(k, t, r) for k, t, r in ev], 3600)
    assert got == want
    assert got[10_001] == (False, 10_001) and got[10_002] == (True, 10_001)


@pytest.mark.parametrize("span, ttl", [(20_000, 7), (20_000, 900), (20_000, 30_000), (300, 1), (50, 0)])
def test_ttl_replay_of_one_key_over_many_ranges(spark, span, ttl):
    """One key fills 11 ranges: entries shorter than a range, longer than several, longer than all; ties."""
    rnd = random.Random(span + ttl)
    ev = [("hot", rnd.randint(0, span), rid) for rid in range(1500)] + [("a", 5, 5000), ("z", 5, 5001)]
    df = spark.createDataFrame([(k, ts(t), r) for k, t, r in ev] + [("hot", None, 6000), (None, ts(4), 6001)], "key string, ts timestamp_ntz, req_id long")
    got = {r.req_id: (r.hit, r.served_by) for r in S.ttl_cache_replay(df, "key", ttl, n_parts=11).collect()}
    assert got == naive_ttl(ev, ttl) | {6000: (False, 6000), 6001: (False, 6001)}


def test_ttl_summary_of_a_range_has_constant_size():
    import pandas as pd

    n = 20_000  # all in the first entry's time to live
    seg = pd.DataFrame({"_t": range(10**15, 10**15 + n), "req_id": range(n)})
    kernel = S.TTLKernel("_t", "req_id", 10**9, [])
    assert len(json.dumps(kernel.bounds(seg))) < 1000
    assert len(kernel.heads(seg)) == n  # a table of Spark's, not of the driver


def naive_budget(reqs, budget):
    out, spent = {}, {}
    for day, t, rid, cost, spends in sorted(reqs, key=lambda r: (r[0], r[1], r[2])):
        s = spent.get(day, 0)
        ok = s + cost <= budget
        out[rid] = ok
        if ok and spends:
            spent[day] = s + cost
    return out


def test_budget_rounds_equal_naive_loop(spark):
    rnd = random.Random(3)
    costs = [2, 3, 5, 7, 11]
    reqs = [("d1" if rnd.random() < 0.7 else "d2", rnd.randint(0, 10_000), rid, rnd.choice(costs), rnd.random() < 0.8) for rid in range(1500)]
    reqs += [("d3", 1, 90_001, 60, True), ("d3", 2, 90_002, 40, True), ("d3", 3, 90_003, 1, True)]  # exact fit, then reject
    df = spark.createDataFrame([(d, ts(t), r, c / 1000.0, s) for d, t, r, c, s in reqs],
                               "day string, ts timestamp_ntz, req_id long, cost double, spends boolean")
    got = {r.req_id: r.admitted for r in S.admit_by_budget(df, "0.1", key="day", cost="cost", spends="spends", n_parts=5).collect()}
    assert got == naive_budget(reqs, 100)
    assert got[90_002] and not got[90_003]


def test_affine_scan_equals_naive_fold(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else "m2", rnd.randint(0, 100000), i, rnd.random() < 0.8) for i in range(2000)]
    df = spark.createDataFrame([(m, ts(t), i, ok) for m, t, i, ok in rows], "model string, ts timestamp_ntz, req_id long, success boolean")
    x = df.withColumn("_a", F.lit(0.9)).withColumn("_b", F.when(F.col("success"), 0.1).otherwise(0.0))
    got = {r.req_id: (r.idx, r.value) for r in S.affine_scan(x, "model", ["ts", "req_id"], "_a", "_b", 1.0, ["model", "req_id"], n_parts=6).collect()}
    state = {}
    for m, t, i, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, r = state.get(m, (0, 1.0))
        n, r = n + 1, 0.9 * r + (0.1 if ok else 0.0)
        state[m] = (n, r)
        assert got[i][0] == n and got[i][1] == pytest.approx(r, rel=1e-12)


# ---------------------------------------------------------------- governance

def test_permission_audit_edges(spark):
    roles = spark.createDataFrame([("admin", ["*"]), ("dev", ["api:access", "data:process"]), ("guest", ["basic:read"])], "role string, perms array<string>")
    calls = spark.createDataFrame([
        (1, ["guest"], ["data:process"]), (2, ["admin"], ["x:y"]), (3, ["nobody"], []), (4, ["guest", "dev"], ["basic:read", "api:access"]),
        (5, ["nobody"], ["basic:read"]),
    ], "id long, roles array<string>, req array<string>")
    out = {r.id: (r.allowed, r.missing) for r in G.permission_audit(calls, roles, F.col("req")).collect()}
    assert out == {1: (False, ["data:process"]), 2: (True, []), 3: (True, []), 4: (True, []), 5: (False, ["basic:read"])}


def test_validate_params_edges(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"limit": 5}'), (3, '{"k": "x", "limit": 2}'), (4, "not json")], "id long, params string")
    out = {r.id: (r.k, r.limit, r.is_valid, r.errors) for r in G.validate_params(df, [("k", "int", True, None), ("limit", "int", False, 10)]).collect()}
    assert out[1] == (3, 10, True, [])
    assert out[2] == (None, 5, False, ["k: field required"])
    assert out[3] == (None, 2, False, ["k: not a valid int"])
    assert out[4][2] is False and out[4][3] == ["params: not a JSON object"]


def test_rule_filter_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, f string")
    assert [r.id for r in G.rule_filter(df, [("f", None)]).collect()] == [2]
    assert [r.id for r in G.rule_filter(df, [("f", "a")]).collect()] == [1]


def test_tool_log_round_trip(spark):
    ev = spark.createDataFrame([(ts(1), "t1", "{}", False), (ts(2), "t1", "{}", True)], "ts timestamp_ntz, tool string, params string, bad boolean")
    lines = G.format_tool_log(ev, "ts", "tool", "params", F.col("bad"), F.lit("boom"))
    out = G.tool_outcomes(G.parse_tool_log(lines)).collect()
    assert [(r.tool, r.invocations, r.successes, r.failures) for r in out] == [("t1", 2, 1, 1)]


# ---------------------------------------------------------------- evaluation

def test_accuracy_strip_and_missing_responses(spark):
    cases = spark.createDataFrame([("c1", "cat", "x", "ans"), ("c2", "cat", "y", "b"), ("c3", "other", "z", "q")],
                                  "case_id string, category string, input string, expected string")
    resp = spark.createDataFrame([("m", "c1", "  ans\n"), ("m", "c2", "nope")], "model string, case_id string, response string")
    out = {(r.model, r.dim): (r.score, r.n_cases, r.n_responses) for r in E.batch_evaluate(cases, resp).collect()}
    assert out == {("m", "cat"): (0.5, 2, 2), ("m", "other"): (0.0, 1, 0)}  # an unanswered dimension counts as 0


def test_repeated_responses_average_and_unanswered_dimensions_lower_the_composite(spark):
    cases = spark.createDataFrame([("c1", "a", "x", "yes"), ("c2", "b", "y", "no")], "case_id string, category string, input string, expected string")
    resp = spark.createDataFrame([("m", "c1", "yes"), ("m", "c1", "yes"), ("n", "c1", "yes"), ("n", "c1", "no"), ("n", "c2", "no")], "model string, case_id string, response string")
    scores = E.batch_evaluate(cases, resp)
    out = {(r.model, r.dim): (r.score, r.n_responses) for r in scores.collect()}
    assert out == {("m", "a"): (1.0, 2), ("m", "b"): (0.0, 0), ("n", "a"): (0.5, 2), ("n", "b"): (1.0, 1)}
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "dim string, weight double")
    assert {r.model: r.composite for r in E.composite(scores, weights).collect()} == {"m": 0.5, "n": 0.75}


def test_an_answered_null_dimension_keeps_its_score(spark):
    cases = spark.createDataFrame([("c1", None, "x", "yes"), ("c2", "b", "y", "no")], "case_id string, category string, input string, expected string")
    resp = spark.createDataFrame([("m", "c1", "yes"), ("m", "c2", "yes"), ("n", "c2", "no")], "model string, case_id string, response string")
    out = {(r.model, r.dim): (r.score, r.n_cases, r.n_responses) for r in E.batch_evaluate(cases, resp).collect()}
    assert out == {("m", None): (1.0, 1, 1), ("m", "b"): (0.0, 1, 1), ("n", None): (0.0, 1, 0), ("n", "b"): (1.0, 1, 1)}


def test_more_dimensions_than_fit_a_small_table(spark):
    cases = spark.range(10_500).selectExpr("concat('c', id) case_id", "concat('d', id) category", "'x' input", "'yes' expected")
    resp = spark.createDataFrame([("m", "c7", "yes")], "model string, case_id string, response string")
    rows = E.batch_evaluate(cases, resp).collect()
    assert len(rows) == 10_500 and [r.dim for r in rows if r.score] == ["d7"]


def test_one_failing_prompt_keeps_the_others(spark):
    from tessera.operators import hooks as H
    from tessera.operators import routing as Rt

    def sometimes(batch):
        if batch["prompt"].str.contains("bad").any():
            raise ValueError("no answer")
        return "re " + batch["prompt"]

    calls = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(6)], "id long, prompt string").coalesce(1)
    got = {r.id: (r.response, r.error) for r in H.batch_invoke(calls, sometimes).collect()}
    assert got[3] == (None, "ValueError: no answer")
    assert all(got[i] == (f"re p{i}", None) for i in got if i != 3)
    steps = spark.createDataFrame([("w", 1, "s", "m"), ("w", 2, "t", "m")], "workflow string, pos int, step string, model string")
    inputs = spark.createDataFrame([(1, "good"), (2, "bad")], "input_id long, input string").coalesce(1)
    runs = {r.input_id: (r.result, r.n_steps) for r in Rt.run_workflow(inputs, steps, sometimes, "w").collect()}
    assert runs == {1: ("re s:good\n\nre t:good", 2), 2: ("", 0)}


def test_processed_store_reports_read_errors(spark, tmpdir_path):
    from tessera.sources import stores

    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "file_hash string, n int")
    store = tmpdir_path + "/store"
    assert stores.save_processed(rows, store).count() == 2
    broken = tmpdir_path + "/broken"
    open(broken, "w").write("not parquet")
    with pytest.raises(Exception):
        stores.save_processed(rows, broken)


def test_unicode_white_space(spark):
    from tessera.functions import text as T

    df = spark.createDataFrame([("你好\u3000世界 a\u00a0b", "\u2003x \u3000")], "a string, b string")
    row = df.select(T.ws_tokens("a").alias("t"), T.strip("b").alias("s")).first()
    assert row.t == "你好\u3000世界 a\u00a0b".split() and row.s == "x"


def test_recommend_cosine_missing_dims(spark):
    scores = spark.createDataFrame([("a", "d1", 1.0), ("b", "d1", 1.0), ("b", "d2", 1.0), ("c", "d2", 1.0)], "model string, dim string, score double")
    req = spark.createDataFrame([(1, "d1", 1.0), (1, "d2", 0.0)], "req_id long, dim string, weight double")
    out = [(r.rank, r.model) for r in E.recommend(req, scores, 2).orderBy("rank").collect()]
    assert out == [(1, "a"), (2, "b")]


# ---------------------------------------------------------------- clustering

def brute_dbscan(points, eps, min_samples):
    n = len(points)
    nb = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    labels, cid = [None] * n, -1
    for i in range(n):
        if labels[i] is not None or len(nb[i]) < min_samples:
            continue
        cid += 1
        labels[i] = cid
        stack = list(nb[i])
        while stack:
            j = stack.pop(0)
            if labels[j] in (None, -1):
                was_unvisited = labels[j] is None
                labels[j] = cid
                if was_unvisited and len(nb[j]) >= min_samples:
                    stack.extend(nb[j])
    return [(-1 if l is None else l) for l in labels]




@pytest.mark.parametrize("small_group", [0, 10_000])
@pytest.mark.parametrize("min_samples", [2, 5])
def test_dbscan_of_many_blocks_null_keys_and_copies(spark, monkeypatch, small_group, min_samples):
    """Both paths: blocks of a few points, keys that are null, vectors that are null or repeat, the same pids under two keys."""
    import numpy as np

    monkeypatch.setattr(C, "CELL", 7)
    monkeypatch.setattr(C, "PIVOTS", 5)
    rng = np.random.default_rng(12)
    rows = []
    for key in (None, "a", "b"):
        vecs = np.concatenate([rng.normal(c, 0.25, (25, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 3, 1))] + [rng.uniform(-3, 4, (20, 3)), np.zeros((30, 3))]).astype(np.float32)
        rng.shuffle(vecs)
        rows += [(key, i, i, v.tolist()) for i, v in enumerate(vecs)] + [(key, 1000, 1000, None)]
    df = spark.createDataFrame(rows, "key string, pid long, pos long, vec array<float>").repartition(4)
    got = {(r.key, r.pid): r.cluster_id for r in C.dbscan(df, eps=0.5, min_samples=min_samples, small_group=small_group).collect()}
    want = {}
    for key in (None, "a", "b"):
        mine = [r for r in rows if r[0] == key and r[3] is not None]
        labels = brute_dbscan([np.array(r[3], dtype=np.float64) for r in mine], 0.5, min_samples)
        want |= {(key, r[1]): c for r, c in zip(mine, labels)} | {(key, 1000): -1}
    assert got == want and len(set(want.values())) > 3


@pytest.mark.parametrize("solved", [0, 100, 10_000])
def test_components_by_contraction_and_in_one_task(spark, monkeypatch, solved):
    monkeypatch.setattr(C, "SOLVED", solved)
    links = [("=a", i, i + 1) for i in range(150)] + [("=b", 7, i) for i in range(40)] + [("=b", 100, 101)]
    both = links + [(k, b, a) for k, a, b in links]
    nodes = [("=a", i, 500 - i) for i in range(152)] + [("=b", i, i) for i in range(40)] + [("=b", 100, 8000), ("=b", 101, 9000)]
    out = C.connected_min_label(spark.createDataFrame(nodes, "key string, pid long, label long"), spark.createDataFrame(both, "key string, a long, b long"))
    got = {(r.key, r.pid): r.label for r in out.collect()}
    assert got == {("=a", i): 350 for i in range(151)} | {("=a", 151): 349} | {("=b", i): 0 for i in range(40)} | {("=b", 100): 8000, ("=b", 101): 8000}


def test_no_point_meets_a_block_that_is_too_far(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vecs = np.concatenate([rng.normal(0, 0.1, (200, 4)), rng.normal(9, 0.1, (200, 4))])
    pts = spark.createDataFrame([("k", i, 1, v.tolist()) for i, v in enumerate(vecs)], "kk string, pid long, weight long, vec array<double>")
    placed = C._placed(pts, 0.3).collect()
    sides = {}
    for r in placed:
        sides.setdefault((r.cell, r.salt), set()).add(r.pid < 200)
    assert all(len(x) == 1 for x in sides.values()) and sum(r.role == 0 for r in placed) == 400


def test_points_known_to_be_of_one_component_are_not_compared(monkeypatch):
    import numpy as np
    import pandas as pd

    compared = []
    monkeypatch.setattr(C, "_pairs", lambda a, b, eps, was=C._pairs: compared.append((len(a), len(b))) or was(a, b, eps))
    rows = lambda label, at: pd.DataFrame({"pid": range(50), "vec": [np.array([at, k / 50]) for k in range(50)], "label": label})
    home = rows([1] * 49 + [3], 0.0)
    block = C.Forest(home, 0.5)
    block.guests(rows(1, 0.1))
    assert compared == [(50, 1)] and block.edges == [(1, 3)]
    block.guests(rows(1, 0.1))
    block.guests(rows(2, 0.2))
    block.guests(rows(2, 0.2))
    assert compared == [(50, 1), (50, 50)] and block.end().values.tolist() == [[1, 3], [1, 2]]


def test_pairs_within_eps_are_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    unit = rng.normal(size=(60, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for offset, eps in ((0, 1.1), (1000, 1.1), (1e8, 0.5), (0, 1e-7), (0, 1e18)):
        a = rng.normal(size=(60, 8)) * eps + offset
        b = a + unit * eps * (1 + rng.choice([-1e-3, -1e-7, -1e-12, 0, 1e-12, 1e-7, 1e-3], 60))[:, None]
        a[3], b[5] = np.nan, np.inf
        with np.errstate(invalid="ignore"):
            want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) <= eps
            got = np.zeros_like(want)
            got[C._pairs(a, b, eps)] = True
        assert (got == want).all()


@pytest.mark.parametrize("min_samples,small_group", [(2, 0), (4, 0), (2, 2000), (4, 2000)])
def test_dbscan_matches_brute_force(spark, min_samples, small_group):
    rnd = random.Random(11)
    pts = [(rnd.gauss(c, 0.3), rnd.gauss(c, 0.3)) for c in (0, 3, 6) for _ in range(12)] + [(rnd.uniform(-5, 10), rnd.uniform(-5, 10)) for _ in range(10)]
    rnd.shuffle(pts)
    df = spark.createDataFrame([(0, i, i, list(p)) for i, p in enumerate(pts)], "key long, pid long, pos long, vec array<float>")
    got = {r.pid: r.cluster_id for r in C.dbscan(df, eps=0.5, min_samples=min_samples, small_group=small_group).collect()}
    import numpy as np
    f32 = [tuple(float(np.float32(v)) for v in p) for p in pts]
    want = brute_dbscan(f32, 0.5, min_samples)
    assert [got[i] for i in range(len(pts))] == want


# ---------------------------------------------------------------- sources

def _docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = ('<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f"<w:body>{body}</w:body></w:document>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def _xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>name</t></si><si><t>bob</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c></row></sheetData></worksheet>')
    return buf.getvalue()


def test_ingest_files_formats_and_errors(spark, tmpdir_path):
    files = {"a.txt": b"hello\nworld", "b.CSV": b"x,y\n1,2\n3,4\n", "c.docx": _docx(["p1", "p2"]), "d.xlsx": _xlsx(),
             "e.pdf": b"%PDF-1.4", "f.docx": b"not a zip"}
    for name, data in files.items():
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            fh.write(data)
    out = {os.path.basename(r.path): r for r in FS.ingest_files(spark, tmpdir_path).collect()}
    assert out["a.txt"].content == "hello\nworld" and out["a.txt"].error is None
    assert json.loads(out["b.CSV"].format_meta) == {"rows": 2, "columns": ["x", "y"]}
    assert out["c.docx"].content == "p1\np2" and json.loads(out["c.docx"].format_meta) == {"paragraphs": 2}
    assert out["d.xlsx"].content.startswith("Sheet: S1\n") and "bob" in out["d.xlsx"].content and "42" in out["d.xlsx"].content
    assert out["e.pdf"].error.startswith("unsupported format")
    assert out["f.docx"].error is not None and out["f.docx"].content is None
    assert out["a.txt"].file_hash == T_md5("hello\nworld")


def test_read_test_sets(spark, tmpdir_path):
    doc = {"reading": [{"input": "q1", "expected": "a1", "difficulty": "easy", "category": "c"}],
           "writing": [{"input": "q2", "criteria": ["x", "y"], "evaluator": "judge"}, {"input": "q3", "expected": "a3"}]}
    p = os.path.join(tmpdir_path, "sets.json")
    with open(p, "w") as fh:
        json.dump(doc, fh)
    out = sorted((r.test_set, r.pos, r.input, r.expected, r.criteria) for r in ST.read_test_sets(spark, p).collect())
    assert out == [("reading", 0, "q1", "a1", None), ("writing", 0, "q2", None, ["x", "y"]), ("writing", 1, "q3", "a3", None)]


def test_consistency_metric(spark):
    resp = spark.createDataFrame([("m", "c1", "a"), ("m", "c1", "a"), ("m", "c1", "b"), ("m", "c2", "x")], "model string, case_id string, response string")
    out = {r.case_id: r.consistency for r in E.consistency(resp).collect()}
    assert out == {"c1": pytest.approx(2 / 3), "c2": 1.0}


def test_csv_as_markdown_and_json_export(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1,\n3,4\n")
    rows = sorted(r.markdown_row for r in FS.csv_as_markdown(spark, p).collect())
    assert rows == ["| 1 |  |", "| 3 | 4 |"]
    out = os.path.join(tmpdir_path, "json")
    ST.export_json(spark.createDataFrame([(1, "x")], "id long, v string"), out)
    assert [json.loads(r.value) for r in spark.read.text(out).collect()] == [{"id": 1, "v": "x"}]


def test_semantic_query_blocks_equal_single_block(spark):
    from tessera.plans import fixtures as fx
    from conftest import SF_SMALL

    q = R._queries_norm(fx.search_queries(spark, SF_SMALL))
    qv = fx.query_vectors(spark, SF_SMALL).join(q.select("query_id", F.col("kb_ids").alias("kb")), "query_id")
    dv = fx.doc_vectors(spark, SF_SMALL).withColumn("source", F.lit(""))
    one = {r.query_id: r for r in R.semantic_stats(qv, dv).collect()}
    many = {r.query_id: r for r in R.semantic_stats(qv, dv, max_queries=7).collect()}
    assert set(one) == set(many) and len(one) > 7
    for k, r in one.items():  # BLAS may sum in a different order for other block shapes
        assert (r.n, r.mn, r.mx) == (many[k].n, pytest.approx(many[k].mn, abs=1e-12), pytest.approx(many[k].mx, abs=1e-12))


def test_scans_are_pruned_and_filters_pushed(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as entry

    meta = entry.queries()["doc_metadata"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in meta or "struct<doc_id:bigint,text:string>" in meta
    rf = entry.queries()["rule_filter"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in rf and "l_returnflag" in rf.split("PushedFilters")[1][:200]


def test_sessionize_hot_user_equals_naive(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(3000):
        u = 1 if rnd.random() < 0.6 else rnd.randint(2, 9)
        rows.append((i, u, rnd.randint(0, 400_000)))
    ev = spark.createDataFrame([(i, u, ts(t), "view") for i, u, t in rows], "event_id long, user_id long, ts timestamp_ntz, event_type string")
    got = {r.event_id: r.session_start for r in Bh.sessionize(ev, 1800, "x", n_parts=7).collect()}
    last, start, want = {}, {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if u not in last or t - last[u] >= 1800:
            start[u] = t
        last[u] = t
        want[i] = ts(start[u])
    assert got == want


def test_lag_scan_hot_key_equals_naive(spark):
    rnd = random.Random(21)
    rows = [(("hot" if rnd.random() < 0.7 else f"d{rnd.randint(0, 5)}"), v, f"c{v}") for v in range(1500)]
    df = spark.createDataFrame(rows, "doc string, version long, content string")
    got = {r.version: r.prev for r in S.lag_scan(df, "doc", ["version"], "content", "prev", "", n_parts=6).collect()}
    last, want = {}, {}
    for d, v, c in sorted(rows, key=lambda r: (r[0], r[1])):
        want[v] = last.get(d, "")
        last[d] = c
    assert got == want


def test_embed_and_batch_invoke_hooks(spark):
    import pandas as pd
    from tessera.operators import hooks as H

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    emb = H.embed(df, lambda s: s.map(lambda t: [float(len(t)), 1.0]))
    assert {r.id: list(r.embedding) for r in emb.collect()} == {1: [2.0, 1.0], 2: [4.0, 1.0]}
    calls = spark.createDataFrame([(1, "m", "p")], "id long, model string, prompt string")
    assert H.batch_invoke(calls, H.stub_model).collect()[0].response == "m response to p"

    def boom(batch: pd.DataFrame):
        raise RuntimeError("down")

    assert H.batch_invoke(calls, boom).collect()[0].response is None


@pytest.mark.parametrize("words", ["abcdefghijkl", "abc"])  # three common words: mean idf and matched scores are negative
def test_searches_equal_brute_force(spark, words):
    import numpy as np

    rnd, rng = random.Random(31), np.random.default_rng(31)
    n, n_queries, k = 80, 6, 5
    longest = 15 if len(words) > 3 else 8
    corpus = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, longest))) for _ in range(n)]
    vecs, qv = rng.normal(size=(n, 6)).astype(np.float32), rng.normal(size=(n_queries, 6)).astype(np.float32)
    queries = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n_queries)]
    has, qhas = [i % 3 != 0 for i in range(n)], [j != 4 for j in range(n_queries)]  # a third of the documents and a query have no vector
    source = [f"s{i % 2}" for i in range(n)]
    kbs = [["s1"] if j == 2 else [] for j in range(n_queries)]
    docs = spark.createDataFrame(list(zip(range(n), corpus, source)), "doc_id long, text string, source string").repartition(5)
    dvecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs) if has[i]], "doc_id long, dvec array<float>")
    q = spark.createDataFrame(list(zip(range(n_queries), queries, kbs)), "query_id long, query string, kb_ids array<string>")
    qvecs = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(qv) if qhas[j]], "query_id long, qvec array<float>")

    def norm(x):
        lo, hi = min(x), max(x)
        return [0.5] * len(x) if hi == lo else [(v - lo) / (hi - lo) for v in x]

    def r6(x):
        return math.floor(x * 1e6 + 0.5) / 1e6

    # segments of a few documents, so that bounds skip some; built over two halves and appended
    halves = [SG.build(docs.where(f"doc_id % 2 = {i}"), dvecs, most=4) for i in (0, 1)]
    index = SG.append(*halves)
    whole = SG.build(docs, dvecs)
    assert (index.n_docs, index.n_tokens) == (whole.n_docs, whole.n_tokens)
    assert sorted(index.terms.collect()) == sorted(whole.terms.collect())
    got = {name: {} for name in ("bm25", "hybrid", "semantic")}
    for name, found in got.items():
        for r in R.search(q, docs, qvecs, dvecs, mode=name, k=k, index=index).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    negative = 0
    for j, text in enumerate(queries):
        seen = [i for i in range(n) if not kbs[j] or source[i] in kbs[j]]
        raw = brute_bm25(corpus, text)
        negative += min(raw) < 0
        bm = dict(zip(seen, norm([raw[i] for i in seen])))
        filled = [i for i in seen if has[i] and qhas[j]]
        inner = [float(np.dot(qv[j].astype(np.float64), vecs[i].astype(np.float64))) for i in filled]
        sem = dict(zip(filled, norm(inner))) if filled else {}
        scores = {"bm25": bm, "hybrid": {i: 0.6 * bm[i] + 0.4 * sem.get(i, 0.0) for i in seen}, "semantic": sem}
        for name, of in scores.items():
            want = sorted(of, key=lambda i: (-r6(of[i]), i))[:k]
            assert [d for d, _ in got[name].get(j, [])] == want, (name, j)
            assert [s for _, s in got[name].get(j, [])] == pytest.approx([r6(of[i]) for i in want], abs=1.1e-6)
    assert bool(negative) == (len(words) == 3)


def test_modes_and_top_k_by_query_over_one_index(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["a b", "a a", "b c", "c", None, ""])], "doc_id long, text string, source string")
    dvecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "doc_id long, dvec array<float>")
    asked = [(1, "a", None, "bm25", 2), (2, "a b", ["s"], "hybrid", 3), (3, "c", None, "semantic", 9), (4, "c", None, "fulltext", 1), (5, "a", None, None, 3), (6, "a", None, "odd", 3), (7, "a", None, "bm25", None), (8, None, None, "bm25", 2)]
    q = spark.createDataFrame(asked, "query_id long, query string, kb_ids array<string>, mode string, top_k int")
    qvecs = spark.createDataFrame([(i, [1.0, 0.5]) for i in (2, 3)], "query_id long, qvec array<float>")
    out = R.search_each(q, SG.build(docs, dvecs), qvecs).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault((r.query_id, r["mode"]), []).append(r.doc_id)
    plain = q.drop("mode", "top_k")
    hybrid = [r.doc_id for r in R.hybrid_search(plain.where("query_id = 2"), docs, qvecs, dvecs, k=3).orderBy("rank").collect()]
    assert got == {(1, "bm25"): [1, 0], (2, "hybrid"): hybrid, (3, "semantic"): [2, 1, 0], (4, "fulltext"): [3], (8, "bm25"): [0, 1]}


def test_bounds_of_segments_hold():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    toks = [[f"t{rng.integers(12)}" for _ in range(rng.integers(0, 20))] for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "source": ["s"] * 60, "text": [" ".join(t) for t in toks]})
    names = [f"t{i}" for i in range(12)]
    weights, terms, queries = rng.normal(size=30), rng.integers(0, 12, 30), rng.integers(0, 5, 30)
    vectors = list(rng.normal(size=(5, 4)))
    chunk = SG.Chunk(np.arange(5), [None] * 5, vectors, terms, queries, weights, np.ones(30), {}, 60, 12)
    avgdl = float(np.mean([len(t) for t in toks]))
    texts = list(SG._segments([batch], 8))
    assert [len(x.column("doc_ids")[0]) for x in texts] == [8] * 7 + [4]
    for x in texts:
        places = list(range(0, len(x.column("doc_ids")[0]), 2))
        held = [{"place": p, "dvec": rng.normal(size=4).tolist()} for p in places]
        packed = next(SG._packed([pa.RecordBatch.from_pydict({"seg": x.column("seg"), "held": [held]})]))
        row = pa.RecordBatch.from_arrays([*x.columns, *packed.columns[1:]], [*x.schema.names, *packed.schema.names[1:]])
        (segment,) = SG._rows([row], names, avgdl, SG.K1, SG.B)
        raw = segment.raw(chunk, np.ones(5, bool))
        assert (raw.max(1) <= segment.bound(chunk) + 1e-9).all()
        for place, doc in enumerate(segment.ids):
            for j in range(5):
                own = [(names[t], w) for t, j2, w in zip(terms, queries, weights) if j2 == j]
                tf = [toks[doc].count(t) for t, _ in own]
                want = sum(w * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks[doc]) / avgdl)) for (_, w), f in zip(own, tf))
                assert raw[j, place] == pytest.approx(want, abs=1e-9)
        inner = chunk.matrix @ segment.matrix.T
        low, high = segment.semantic_bound(chunk)
        assert (inner.min(1) >= low).all() and (inner.max(1) <= high).all()


def test_best_keeps_all_that_may_round_to_the_last_place():
    import numpy as np

    best = SG.Best(2, 2, np.array([0.1, 0.0]))
    best.add(np.array([0, 0, 0, 0, 1, 1, 1]), np.array([9, 8, 7, 6, 5, 4, 3]), np.array([1.0, 0.95, 0.9, 0.5, 1.0, 1.0, 1.0]))
    assert list(zip(best.query, best.doc)) == [(0, 9), (0, 8), (0, 7), (1, 3), (1, 4)]
    best.add(np.array([0]), np.array([1]), np.array([2.0]))
    assert list(zip(best.query, best.doc))[:3] == [(0, 1), (0, 9), (0, 8)]


def test_best_text_match_without_a_vector_is_found(spark):
    docs = spark.createDataFrame([(1, "rare word", "s"), (2, "other text", "s"), (3, "more text", "s"), (4, "even more", "s")], "doc_id long, text string, source string")
    dvecs = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, dvec array<float>")
    q = spark.createDataFrame([(7, "rare word", None)], "query_id long, query string, kb_ids array<string>")
    hits = R.hybrid_search(q, docs, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qvec array<float>"), dvecs, k=3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in hits] == [(1, 0.6), (2, 0.4), (3, 0.0)]


def test_search_flow_collapses_before_the_cut(spark):
    from tessera.operators import search_flow as SF

    docs = spark.createDataFrame([(i, "term " * (10 - i), "s") for i in range(1, 9)], "doc_id long, text string, source string")
    near = [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [0.2, 0.0]), (4, [9.0, 0.0]), (5, [0.0, 9.0]), (6, [0.0, 9.1])]  # 7 and 8 have no vector
    dvecs = spark.createDataFrame(near, "doc_id long, dvec array<float>")
    hits = spark.createDataFrame([(1, r, r, 1.0 - r / 10) for r in range(1, 9)], "query_id long, rank long, doc_id long, score double")
    out = SF.collapsed_top_k(hits, dvecs, 4, eps=0.5, min_samples=2).orderBy("rank").collect()
    assert [(r.rank, r.doc_id, r.cluster_id) for r in out] == [(1, 1, 0), (2, 4, -1), (3, 5, 1), (4, 7, -1)]


def test_sessions_with_null_keys_over_many_ranges(spark):
    rows = [(i, None if i % 3 == 0 else 1, ts(i * 60)) for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").withColumn("event_type", F.lit("view"))
    for parts in (1, 2, 3, 7):
        got = {r.event_id: r.session_start for r in Bh.sessionize(ev, 1800, "salt", n_parts=parts).collect()}
        assert got == {i: ts(0) if u is None else ts(60) for i, u, _ in rows}, parts


def test_budget_with_many_descending_costs(spark):
    reqs = [("d", i, i, 400 - i, True) for i in range(300)]
    df = spark.createDataFrame([(d, ts(t), r, c / 1000.0, s) for d, t, r, c, s in reqs], "day string, ts timestamp_ntz, req_id long, cost double, spends boolean")
    got = {r.req_id: r.admitted for r in S.admit_by_budget(df, "1.5", key="day", cost="cost", spends="spends", n_parts=4).collect()}
    assert got == naive_budget(reqs, 1500)


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    nodes = spark.createDataFrame([(0, i, i) for i in range(302)], "key long, pid long, label long")
    links = [(0, a, b) for a, b in zip(order, order[1:])] + [(0, 300, 301)]
    edges = spark.createDataFrame(links + [(k, b, a) for k, a, b in links], "key long, a long, b long")
    got = {r.pid: r.label for r in C.connected_min_label(nodes, edges).collect()}
    assert got == {i: 0 if i < 300 else 300 for i in range(302)}


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = df.select(T.dot("a", "b").alias("dot"), T.cosine("a", "b").alias("cosine"), T.vector_mean("a").alias("mean")).first()
    assert (r.dot, r.mean) == (11.0, 1.5) and r.cosine == pytest.approx(11 / (5 * math.sqrt(5)))


def test_processed_documents_with_null_and_repeated_ids(spark):
    rows = [(None, "one text. here"), (5, "other text"), (None, "one text. here"), (5, "other text"), (5, "third # text"), (7, "other text"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    summary, chunks = D.process_documents(docs, spark.createDataFrame([], "file_hash string"))
    got = sorted((r.doc_id or -1, r.n_copies, r.n_chars, r.n_chunks) for r in summary.collect())
    assert got == [(-1, 2, 14, 1), (5, 1, 12, 1), (5, 3, 10, 1)]
    assert sorted((r.doc_id or -1, r.chunk) for r in chunks.collect()) == [(-1, "one text. here"), (5, "other text"), (5, "third # text")]


def test_events_without_a_time_have_a_session_of_their_own(spark):
    rows = [(1, 1, ts(0)), (2, 1, None), (3, 1, ts(60)), (4, None, None), (5, 2, None), (6, 1, None)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").withColumn("event_type", F.lit("view"))
    got = {r.event_id: (r.session_start, r.session_id) for r in Bh.sessionize(ev, 1800, "x", n_parts=3).collect()}
    assert got[1] == got[3] and got[1][0] == ts(0)
    assert got[2] == got[6] and got[2][0] is None and len({got[i][1] for i in (1, 2, 4, 5)}) == 4


def test_a_null_latency_leaves_the_mean(spark):
    rows = [("m", ts(i), i, ok, lat) for i, (ok, lat) in enumerate([(True, 2.0), (True, None), (None, 9.0), (False, 5.0), (True, 4.0)])]
    calls = spark.createDataFrame(rows, "model string, ts timestamp_ntz, req_id long, success boolean, latency double")
    got = [r.avg_latency for r in Rt.model_performance(calls).orderBy("req_id").collect()]
    assert got == pytest.approx([2.0, 2.0, 2.0, 2.0, (2.0 * 4 + 4.0) / 5])


def test_small_costs_and_values_are_exact(spark):
    reqs = [("d", ts(i), i, 0.0000004, True) for i in range(5)]
    df = spark.createDataFrame(reqs, "day string, ts timestamp_ntz, req_id long, cost double, spends boolean")
    out = S.admit_by_budget(df, "0.000001", key="day", cost="cost", spends="spends").orderBy("req_id").collect()
    assert [r.admitted for r in out] == [True, True, False, False, False] and float(out[0].cost) == 4e-7
    log = spark.createDataFrame([("d", ts(i), i, v) for i, v in enumerate([0.004, None, 0.008])], "day string, ts timestamp_ntz, event_id long, response_ms double")
    assert [(r.n, r.running_avg) for r in M.running_metrics(log).orderBy("event_id").collect()] == [(1, pytest.approx(0.004)), (2, pytest.approx(0.006))]
    exact = log.withColumn("response_ms", F.col("response_ms").cast("decimal(10,4)"))
    assert [r.running_avg for r in M.running_metrics(exact).orderBy("event_id").collect()] == pytest.approx([0.004, 0.006])


def test_log_lines_that_miss_the_pattern_are_rejected_rows(spark):
    lines = spark.createDataFrame([("2024-01-01 10:00:00,123 - AgentTools - INFO - Invoking search with params {}",), ("garbage",), (None,)], "value string")
    out = G.parse_tool_log(lines)
    assert sorted((r.outcome, r.detail or "", r.tool or "") for r in out.collect()) == [("invocation", "{}", "search"), ("rejected", "", ""), ("rejected", "garbage", "")]
    assert [(r.tool, r.invocations) for r in G.tool_outcomes(out).collect()] == [("search", 1)]


# ---------------------------------------------------------------- rejects, search log, TF-IDF weights

def test_malformed_test_sets_are_rejects(spark, tmpdir_path):
    from tessera.sources import stores

    for name, body in (("a.json", '{"s": [{"input": "x", "expected": "y"}]}'), ("b.json", "{broken"), ("c.json", '{"t": "no list"}'), ("d.json", "")):
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            fh.write(body)
    assert [(r.test_set, r.pos, r.input) for r in stores.read_test_sets(spark, tmpdir_path).collect()] == [("s", 0, "x")]
    rejects = {os.path.basename(r.path) for r in stores.rejected_test_sets(spark, tmpdir_path).collect()}
    assert {"b.json", "c.json"} <= rejects and "a.json" not in rejects


def test_files_above_max_bytes_are_error_rows(spark, tmpdir_path):
    from tessera.sources import files

    for name, body in (("a.txt", "short"), ("b.TXT", "x" * 100), ("c", "x" * 100)):
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            fh.write(body)
    rows = {os.path.basename(r.path): r for r in files.ingest_files(spark, tmpdir_path, max_bytes=50).collect()}
    assert rows["a.txt"].content == "short" and rows["a.txt"].error is None
    assert rows["b.TXT"].ext == ".txt" and rows["c"].ext == "" and "100 bytes" in rows["b.TXT"].error


def test_search_metrics_read_the_log_that_a_search_wrote(spark, tmpdir_path):
    from tessera.sources import stores

    log, out = os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "hits")
    for n, query, hit in ((7, "a", False), (0, "b", True)):
        hits = spark.range(n).withColumnRenamed("id", "doc_id")
        stores.run_logged(hits, lambda df: df.write.mode("overwrite").parquet(out), log, query, "hybrid", ["kb"], hit)
        assert spark.read.parquet(out).count() == n
    with pytest.raises(ZeroDivisionError):
        stores.run_logged(spark.range(1), lambda df: 1 / 0, log, "c", "hybrid")
    records = stores.read_search_log(spark, log)
    assert sorted((r.query, r.mode, r.n_results, r.cache_hit) for r in records.collect()) == [("a", "hybrid", 7, False), ("b", "hybrid", 0, True)]
    total = [r for r in M.search_metrics(records.withColumn("day", F.to_date("ts")), "day").collect() if r.day is None][0]
    assert (total.total, total.cache_hits) == (2, 1) and total.avg_response_ms > 0


def test_tfidf_weights_by_hand(spark):
    rows = [("1", "a a b"), ("2", "a c"), ("3", None), ("3", ""), (None, "b  b"), ("4", "rare")]
    got = {r.input_id: r.weights for r in Rt.tfidf_weights(spark.createDataFrame(rows, "input_id string, input string"), vocab=3).collect()}
    idf = {t: math.log(6 / (1 + df)) + 1 for t, df in (("a", 2), ("b", 2), ("c", 1))}  # 5 keys; c before rare
    one = {"a": 2 * idf["a"], "b": idf["b"]}
    norm = math.sqrt(sum(v * v for v in one.values()))
    assert got["1"] == pytest.approx({t: v / norm for t, v in one.items()})
    assert got["3"] == {} and got["4"] == {} and got[None] == pytest.approx({"b": 1.0})
    assert set(got["2"]) == {"a", "c"}
    assert Rt.tfidf_weights(spark.createDataFrame([], "input_id string, input string")).count() == 0


def test_segments_go_on_over_batches_and_hold_no_batch_of_words():
    import tracemalloc

    import pyarrow as pa

    def batch(begin, n, text):
        return pa.RecordBatch.from_pydict({"doc_id": list(range(begin, begin + n)), "source": ["s"] * n, "text": pa.array([text] * n, pa.string())})

    found = list(SG._segments(iter([batch(0, 5, "b a b"), batch(5, 5, None), batch(10, 5, "a")]), 8))
    assert [x.column("doc_ids")[0].as_py() for x in found] == [list(range(8)), list(range(8, 15))]
    assert [x.column("terms")[0].as_py() for x in found] == [["b", "a"], ["a"]]
    assert [x.column("dfs")[0].as_py() for x in found] == [[5, 5], [5]]
    assert found[0].column("tfs")[0].as_py() == [2] * 5 + [1] * 5
    large = batch(0, 4000, " ".join(f"word{i % 50}" for i in range(300)))
    tracemalloc.start()
    assert sum(len(x.column("doc_ids")[0]) for x in SG._segments(iter([large]), 512)) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 67 MB and more for the words of the batch


def test_a_segment_is_a_small_row():
    import pyarrow as pa

    texts = [" ".join(f"w{(37 * i + j) % 4000}" for j in range(300)) for i in range(600)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "source": ["s"] * 600, "text": texts})
    found = list(SG._segments(iter([rows]), SG.DOCS))
    assert [i for x in found for i in x.column("doc_ids")[0].as_py()] == list(range(600))
    assert max(x.nbytes for x in found) < 512 << 10  # 1.3 MB for 512 documents


def test_segments_and_vectors_are_read_a_few_at_a_time(spark, monkeypatch):
    import pandas as pd

    from tessera import session

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = session.materialize(spark.range(0, 40, 1, 1).mapInArrow(lambda it: (b for b in it), "id long").mapInPandas(lambda it: (pd.DataFrame({"n": [len(x)]}) for x in it), "n long"), "sizes", 7)
    assert max(r.n for r in sizes.collect()) <= 7
    assert spark.conf.get(key) == before
    held = {}

    def spy(df, name, batch=None, options=None):
        held[name] = batch
        return session.materialize(df, name, batch, options)

    for module in (SG, R, C):
        monkeypatch.setattr(module, "materialize", spy)
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a c", "s"), (3, "b", "s")], "doc_id long, text string, source string")
    dvecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, dvec array<float>")
    qvecs = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, qvec array<float>")
    q = spark.createDataFrame([(7, "a", None)], "query_id long, query string, kb_ids array<string>")
    # "a" is in most documents, so its weight is below 0 and document 3 is the best match
    assert [r.doc_id for r in R.search(q, docs, qvecs, dvecs, mode="hybrid").orderBy("rank").collect()] == [3, 1, 2]
    assert [r.doc_id for r in R.search(q, docs, qvecs, dvecs, mode="semantic").orderBy("rank").collect()] == [1, 2]
    pts = dvecs.selectExpr("0L key", "doc_id pid", "doc_id pos", "dvec vec")
    assert [r.cluster_id for r in C.dbscan(pts, eps=2.0, min_samples=2, small_group=0).collect()] == [0, 0]
    wanted = {"segments-text": SG.TEXTS, "segments": SG.SEGMENTS, "segments-raw": SG.SEGMENTS, "segments-fused": SG.SEGMENTS, "semantic_queries": R.VECTORS, "semantic_best": R.VECTORS,
              "cluster-cells": C.READ, "cluster-core": C.READ, "cluster-edges": C.READ, "cluster-borders": C.READ}
    assert {k: held.get(k) for k in wanted} == wanted


def test_best_carries_the_parts_of_a_score():
    import numpy as np

    best = SG.Best(2, 1, np.zeros(2))
    best.add(np.array([0, 1, 0]), np.array([5, 6, 7]), np.array([0.5, 0.7, 0.9]), np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0, 6.0]))
    best.add(np.array([1]), np.array([8]), np.array([0.8]), np.array([7.0]), np.array([8.0]))
    assert list(zip(best.query, best.doc, *best.parts)) == [(0, 7, 3.0, 6.0), (1, 8, 7.0, 8.0)]


def test_near_and_solve_hold_little():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(64, 64)), rng.normal(size=(2000, 64))
    a, b = (x / np.sqrt((x**2).sum(1))[:, None] for x in (a, b))
    a[:, 2:], b[:, 2:] = a[:, 2:] * 1e-3, b[:, 2:] * 1e-3
    a[:, :2], b[:, :2] = [0.0, 0.0], [1.0, 0.0]
    tracemalloc.start()
    near = C._near(a, b, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (near == (np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) <= 1.0)).all()
    assert peak < 50e6  # 131 MB and more for all pairs at once
    edges = [("x", 1, 2), ("x", 2, 3), ("y", 1, 4), ("y", 9, 9), ("x", 8, 7)]
    frames = [pd.DataFrame(edges[:2], columns=["key", "a", "b"]), pd.DataFrame(edges[2:], columns=["key", "a", "b"])]
    out = pd.concat(C._solve(iter(frames)))
    groups = out.groupby(["key", "to"])["at"].apply(lambda x: tuple(sorted(x)))
    assert sorted((k[0], v) for k, v in groups.items()) == [("x", (1, 2, 3)), ("x", (7, 8)), ("y", (1, 4)), ("y", (9,))]
    assert list(C._solve(iter([]))) == []


def test_segments_are_stored_as_bytes_and_counted_by_task(spark):
    import pyarrow as pa

    texts = ["b a b", "a \u00fc", None, "", "c a"]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "source": ["s"] * 5, "text": pa.array(texts, pa.string())})
    found = list(SG._segments(iter([rows]), 2))
    stored = list(SG._stored(iter(found)))
    for x, y in zip(found, stored, strict=True):
        assert SG._terms(y.column("terms")[0].as_py(), y.column("ends")[0].as_py()).to_pylist() == x.column("terms")[0].as_py()
    empty = {c: pa.array([None], t) for c, t in (("filled", pa.list_(pa.int32())), ("matrix", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()))}
    for x, y in zip(found, stored, strict=True):
        one, two = (next(SG._rows([pa.RecordBatch.from_arrays([*z.columns, *empty.values()], [*z.schema.names, *empty])], ["a", "b"], 1.0, SG.K1, SG.B)) for z in (x, y))
        assert (one.term.tolist(), one.place.tolist(), one.impact.tolist()) == (two.term.tolist(), two.place.tolist(), two.impact.tolist())
    counted = [r for b in SG._frequencies(iter(stored)) for r in zip(b.column("term").to_pylist(), b.column("df").to_pylist())]
    assert sorted(counted) == [("a", 3), ("b", 1), ("c", 1), ("\u00fc", 1)]  # a row a term of the task, not of the segment
    index = SG.build(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string"))
    kinds = dict(index.segments.dtypes)
    assert {c: kinds[c] for c in ("terms", "dfs", "places", "tfs")} == dict.fromkeys(("terms", "dfs", "places", "tfs"), "binary")
    assert (index.n_docs, index.n_tokens, {r.term: r.df for r in index.terms.collect()}) == (5, 7, dict(counted))


def test_rerank_features_sends_the_hits_to_the_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a")], "query_id long, query string")
    hits = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.25)], "query_id long, doc_id long, score double")
    feedback = spark.createDataFrame([(1, 5)], "doc_id long, score int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.rerank_features(hits, queries, docs, feedback)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1  # the texts stay where they are
        assert sorted((r.doc_id, r.score, r.overlap, r.feedback) for r in out.collect()) == [(1, 0.5, 1.0, 1.0), (2, 0.25, 0.0, 0.9), (2, 0.25, 1.0, 0.9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_materialized_tables_have_no_marker_file(spark):
    from urllib.parse import urlparse

    from tessera import session

    back = session.materialize(spark.range(10), "unmarked")
    assert back.count() == 10
    (folder,) = {os.path.dirname(urlparse(x).path) for x in back.inputFiles()}
    assert not [x for x in os.listdir(folder) if "_SUCCESS" in x]
