"""Batch retrieval: BM25, exact vector scoring, hybrid fusion, top-k, feedback.

All functions take tables of queries (never one query at a time) and return
DataFrames.  Shapes:

* docs:   ``doc_id bigint, text string, source string`` (+ anything else)
* queries: ``query_id bigint, query string, kb_ids array<string>`` (null/empty = all)
* qvecs:  ``query_id, qvec array<float>``;  dvecs: ``doc_id, dvec array<float>``

Scale notes
-----------
* BM25 and hybrid search run over the segments of ``segments.py``: bounds skip a segment
  for a query, a task emits its k best, and no (query, document) pair is written.
* Min-max normalisation needs the range of raw scores, an aggregate of the tasks' ranges.
  Documents a query never matched score 0 and take part in min/max (G2).
* Exact vector scoring streams the document vectors through ``mapInPandas``
  with a size-checked query block: a partition emits one row of stats and its k
  best documents a query, never the Q x N score matrix (``CELLS`` at a time).
* Per-query top-k uses ``row_number`` with a literal bound, which Spark plans
  as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.functions import text as T
from tessera.operators.segments import SegmentIndex, build, fused_best, ranges, raw_best
from tessera.plans.guards import bounded_broadcast, collect_bounded
from tessera.session import materialize

ALPHA = 0.6
TOP_K = 10
MODES = ("hybrid", "semantic", "bm25", "fulltext")


# G1
def corpus_stats(docs: DataFrame) -> DataFrame:
    """Per-term document frequency and idf, with corpus size and mean length."""
    index = build(docs)
    return index.terms.select("term", "df", "idf", F.lit(index.n_docs).cast("bigint").alias("n_docs"), F.lit(index.avgdl).alias("avgdl"))


def normalized(x: Column, mn: str = "mn", mx: str = "mx") -> Column:
    rng = F.col(mx) - F.col(mn)
    return F.when(rng == 0, F.lit(0.5)).otherwise((x - F.col(mn)) / rng)


# W7 / L1
def top_k(df: DataFrame, k: int, score: str = "score", part: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """``row_number`` per query by (score desc, tie asc) with a literal bound -> WindowGroupLimit."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k)).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- vectors

#: Cells of a (queries x documents) block held at a time; rows with a vector that a task reads at a time.
CELLS, VECTORS = 1 << 17, 1024


def _kb_lists(pq: pd.DataFrame) -> list:
    return [None if (x is None or len(x) == 0) else np.asarray(list(x), dtype=object) for x in pq["kb"]]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.map(lambda v: np.asarray(v, dtype=np.float64)).values) if len(vectors) else np.zeros((0, 0))


def _query_payload(pq: pd.DataFrame) -> dict:
    """Arrays of a block of queries in id order; ``mat`` holds the vectors of the queries (places ``has``) that have one."""
    pq = pq.sort_values("query_id")
    has = pq["qvec"].notna().to_numpy()
    stats = {c: pq[c].to_numpy(np.float64) for c in ("bmn", "bmx", "smn", "smx") if c in pq}
    return {"ids": pq["query_id"].to_numpy(np.int64), "kb": _kb_lists(pq), "has": np.flatnonzero(has), "mat": _matrix(pq["qvec"][has]), **stats}


def _cell_blocks(pdf: pd.DataFrame, n_queries: int):
    step = max(1, CELLS // max(1, n_queries))
    return (pdf.iloc[begin:begin + step] for begin in range(0, len(pdf), step))


def _allowed_mask(kb: list, pdf: pd.DataFrame) -> np.ndarray:
    src = pdf["source"].to_numpy(object)
    mask = np.ones((len(kb), len(pdf)), dtype=bool)
    for i, names in enumerate(kb):
        if names is not None:
            mask[i] = np.isin(src, names)
    return mask


def _hit_places(ids: np.ndarray, pdf: pd.DataFrame):
    """(query place, document place, place in the joined lists) of the matches in ``hit_q`` of this block's queries."""
    lists = [np.asarray(() if x is None else x, dtype=np.int64) for x in pdf["hit_q"]]
    cols, of = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.empty(0, np.int64), *lists])
    at = np.searchsorted(ids, of)
    own = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == of) if len(ids) else np.empty(0, np.int64)
    return at[own], cols[own], own


def _unit(x: np.ndarray, mn: np.ndarray, mx: np.ndarray) -> np.ndarray:
    """``normalized`` of a block, one row a query."""
    span = (mx - mn)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(span == 0, 0.5, (x - mn[:, None]) / span)


def _round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _fused_scores(p: dict, pdf: pd.DataFrame, alpha: float):
    """Rounded (score, bm25, semantic) of every document for every query; a score that a query may not see is NaN."""
    raw = np.zeros((len(p["ids"]), len(pdf)))
    at, cols, own = _hit_places(p["ids"], pdf)
    if len(own):
        raw[at, cols] = np.concatenate([np.asarray(() if x is None else x, dtype=np.float64) for x in pdf["hit_raw"]])[own]
    bm25, semantic = _unit(raw, p["bmn"], p["bmx"]), np.zeros(raw.shape)
    filled = np.flatnonzero(pdf["dvec"].notna().to_numpy())
    if len(filled) and len(p["has"]):
        inner = p["mat"] @ _matrix(pdf["dvec"].iloc[filled]).T
        semantic[np.ix_(p["has"], filled)] = _unit(inner, p["smn"][p["has"]], p["smx"][p["has"]])
    score = np.where(_allowed_mask(p["kb"], pdf), _round6(alpha * bm25 + (1 - alpha) * semantic), np.nan)
    return score, _round6(bm25), _round6(semantic)


def fused_hits(params: DataFrame, rows: DataFrame, alpha: float, k: int, max_queries: int = 50_000) -> DataFrame:
    """The k best of each partition's documents for each query: query_id, doc_id, score, bm25, semantic.

    ``params``: query_id, kb, qvec, bmn, bmx, smn, smx; ``rows``: doc_id, source, dvec, hit_q, hit_raw.
    Query sets above ``max_queries`` are processed in hash blocks, one bounded broadcast each.
    """
    return _union([_fused_block(b, rows, alpha, k, 2 * max_queries) for b in _query_blocks(params, max_queries)])


def _fused_block(params: DataFrame, rows: DataFrame, alpha: float, k: int, max_queries: int) -> DataFrame:
    bc = rows.sparkSession.sparkContext.broadcast(_query_payload(collect_bounded(params, max_queries, "queries")))

    def fn(it):
        p = bc.value
        n = len(p["ids"])
        floor = np.full(n, -np.inf)  # the k-th best score so far
        best = [np.empty(0, np.int64), np.empty(0, np.int64), *(np.empty(0) for _ in range(3))]
        for pdf in it:
            for part in _cell_blocks(pdf, n):
                scores = _fused_scores(p, part, alpha)
                qi, di = np.nonzero(scores[0] >= floor[:, None])
                new = [qi, part["doc_id"].to_numpy(np.int64)[di], *(x[qi, di] for x in scores)]
                best = [np.concatenate(x) for x in zip(best, new)]
                order = np.lexsort((best[1], -best[2], best[0]))
                of = best[0][order]
                place = np.arange(len(of)) - np.searchsorted(of, of)
                best = [x[order[place < k]] for x in best]
                last = place == k - 1
                floor[of[last]] = best[2][place[place < k] == k - 1]
        yield pd.DataFrame(dict(zip(("query_id", "doc_id", "score", "bm25", "semantic"), [p["ids"][best[0]], *best[1:]])))

    return rows.select("doc_id", "source", "dvec", "hit_q", "hit_raw").mapInPandas(fn, "query_id long, doc_id long, score double, bm25 double, semantic double")


def _query_blocks(qvecs: DataFrame, max_queries: int):
    """Split the query table into hash blocks of at most about ``max_queries`` rows (one broadcast each)."""
    n = qvecs.count()
    nb = max(1, -(-n // max_queries))
    if nb == 1:
        return [qvecs]
    return [qvecs.where(F.pmod(F.xxhash64("query_id"), F.lit(nb)) == b) for b in range(nb)]


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def semantic_stats(qvecs: DataFrame, dvecs: DataFrame, max_queries: int = 50_000) -> DataFrame:
    """Per query: min, max and count of the exact inner product over allowed docs (pass 1).

    Query sets above ``max_queries`` are processed in hash blocks, each block
    one bounded broadcast and one streaming pass over the document vectors.
    """
    return _union([_semantic_stats_block(b, dvecs, 2 * max_queries) for b in _query_blocks(qvecs, max_queries)])


def _semantic_stats_block(qvecs: DataFrame, dvecs: DataFrame, max_queries: int) -> DataFrame:
    spark = dvecs.sparkSession
    bc = spark.sparkContext.broadcast(_query_payload(collect_bounded(qvecs.select("query_id", "qvec", "kb").where("qvec is not null"), max_queries, "query vectors")))

    def fn(it):
        p = bc.value
        n = len(p["ids"])
        mn, mx, count = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for pdf in it:
            for part in _cell_blocks(pdf[pdf["dvec"].notna()], n):
                if n:
                    inner, mask = p["mat"] @ _matrix(part["dvec"]).T, _allowed_mask(p["kb"], part)
                    mn = np.minimum(mn, np.where(mask, inner, np.inf).min(axis=1))
                    mx = np.maximum(mx, np.where(mask, inner, -np.inf).max(axis=1))
                    count += mask.sum(axis=1)
        keep = count > 0
        yield pd.DataFrame({"query_id": p["ids"][keep], "mn": mn[keep], "mx": mx[keep], "n": count[keep]})

    part = dvecs.select("doc_id", "source", "dvec").mapInPandas(fn, "query_id long, mn double, mx double, n long")
    return part.groupBy("query_id").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- search

def _queries_norm(queries: DataFrame) -> DataFrame:
    cols = queries.columns
    kb = F.col("kb_ids") if "kb_ids" in cols else F.lit(None).cast("array<string>")
    return queries.select("query_id", "query", F.coalesce(kb, F.array().cast("array<string>")).alias("kb_ids"))


def bm25_search(queries: DataFrame, docs: DataFrame | None, k: int = TOP_K, index: SegmentIndex | None = None) -> DataFrame:
    """Full-text mode: normalised BM25, top-k per query (query_id, rank, doc_id, score).

    Documents without a match score as raw 0 does.  One pass over the segments gives the
    candidates and the range of the scores.
    """
    q = _queries_norm(queries).withColumnRenamed("kb_ids", "kb")
    found = raw_best(index or build(docs), q, k)
    scored = found.select("query_id", "doc_id", "raw").join(ranges(found), "query_id")
    return top_k(scored.select("query_id", "doc_id", round6(normalized(F.col("raw"), "bmn", "bmx")).alias("score")), k).select("query_id", "rank", "doc_id", "score")


def semantic_search(queries: DataFrame, qvecs: DataFrame, dvecs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Semantic mode: exact inner product, normalised per query, top-k of the documents that have a vector."""
    q = _queries_norm(queries)
    qv = q.select("query_id", F.col("kb_ids").alias("kb")).join(qvecs.select("query_id", "qvec").where("qvec is not null"), "query_id")
    vectors = dvecs.where("dvec is not null")
    stats = semantic_stats(qv, vectors).select("query_id", F.col("mn").alias("smn"), F.col("mx").alias("smx"))
    params = materialize(qv.join(stats, "query_id").withColumns({"bmn": F.lit(0.0), "bmx": F.lit(0.0)}), "semantic_queries", VECTORS)
    rows = vectors.withColumns({"hit_q": F.lit(None).cast("array<bigint>"), "hit_raw": F.lit(None).cast("array<double>")})
    found = materialize(fused_hits(params, rows, 0.0, k), "semantic_best", VECTORS)
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")


def hybrid_search(queries: DataFrame, docs: DataFrame | None, qvecs: DataFrame, dvecs: DataFrame | None, alpha: float = ALPHA, k: int = TOP_K,
                  index: SegmentIndex | None = None) -> DataFrame:
    """``alpha * bm25_norm + (1 - alpha) * semantic_norm`` over every document a query may see.

    A document without a BM25 match has the normalised value of raw 0.  A document or a
    query without a vector has no semantic score: it stays out of the semantic minimum
    and maximum, and its normalised semantic score is 0.  The first pass over the
    segments finds the ranges, the second the k best; both skip by their bounds.
    """
    q = _queries_norm(queries).withColumnRenamed("kb_ids", "kb")
    index = index or build(docs, dvecs)
    params = materialize(ranges(raw_best(index, q, 1, qvecs)), "hybrid_ranges")
    return top_k(fused_best(index, q, qvecs, params, alpha, k), k).select("query_id", "rank", "doc_id", "score", "bm25", "semantic")


def search(queries: DataFrame, docs: DataFrame, qvecs: DataFrame | None = None, dvecs: DataFrame | None = None,
           mode: str = "hybrid", alpha: float = ALPHA, k: int = TOP_K, index: SegmentIndex | None = None) -> DataFrame:
    """Mode dispatch (P7): ``hybrid`` | ``semantic`` | ``bm25`` / ``fulltext``; documents attached after top-k.

    An ``index`` made once by ``segments.build`` can be given to any number of searches.
    """
    if mode in ("bm25", "fulltext"):
        hits = bm25_search(queries, docs, k, index)
    elif mode == "semantic":
        hits = semantic_search(queries, qvecs, dvecs.join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id"), k)
    elif mode == "hybrid":
        hits = hybrid_search(queries, docs, qvecs, dvecs, alpha, k, index)
    else:
        raise ValueError(f"unknown search mode {mode!r}")
    return attach_documents(hits, docs)


def search_each(queries: DataFrame, index: SegmentIndex, qvecs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Searches whose ``mode`` and ``top_k`` are columns of their query, all over one index.

    ``queries``: query_id, query, kb_ids, mode, top_k.  Null or unknown modes and null or
    negative top_k give no hits.  query_id, mode, rank, doc_id, score.
    """
    most = queries.agg(F.max("top_k")).first()[0] or 0
    parts = []
    for mode in MODES:
        mine = queries.where(F.col("mode") == mode)
        q = _queries_norm(mine).withColumnRenamed("kb_ids", "kb")
        if mode in ("bm25", "fulltext"):
            hits = bm25_search(mine, None, most, index)
        elif mode == "hybrid":
            hits = hybrid_search(mine, None, qvecs, None, alpha, most, index)
        else:
            params = materialize(ranges(raw_best(index, q, 1, qvecs)), "semantic_ranges")
            hits = top_k(fused_best(index, q, qvecs, params, 0.0, most, only_vectors=True), most)
        parts.append(hits.select("query_id", F.lit(mode).alias("mode"), "rank", "doc_id", "score") if most > 0 else None)
    parts = [x for x in parts if x is not None]
    if not parts:
        return queries.sparkSession.createDataFrame([], "query_id long, mode string, rank long, doc_id long, score double")
    hits = parts[0]
    for x in parts[1:]:
        hits = hits.unionByName(x)
    return hits.join(queries.select("query_id", "mode", "top_k"), ["query_id", "mode"]).where(F.col("rank") <= F.col("top_k")).drop("top_k")


# J8
def attach_documents(hits: DataFrame, docs: DataFrame, cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """Late materialisation: join document columns to the k hits only."""
    return hits.join(docs.select("doc_id", *cols), "doc_id", "left")


# ---------------------------------------------------------------- feedback and analytics

# G10
def latest_feedback(fb: DataFrame) -> DataFrame:
    """Last write wins per document: ``max_by(score, (ts, event_id))``."""
    return fb.groupBy("doc_id").agg(
        F.max_by("score", F.struct("ts", "event_id")).alias("score"),
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("n_feedback"),
    )


# J9
def feedback_score(hits: DataFrame, fb: DataFrame, default: float = 0.9) -> DataFrame:
    """Mean feedback (1..5 scaled to 0..1) per document, default when none."""
    agg = fb.groupBy("doc_id").agg((F.avg("score") / 5.0).alias("fb"))
    return hits.join(agg, "doc_id", "left").withColumn("feedback", F.coalesce("fb", F.lit(default))).drop("fb")


# G9 / L5 / F22
def top_queries(log: DataFrame, time_range: str = "7d", as_of: Column | None = None, n: int = 10) -> DataFrame:
    """Most frequent queries in ``(as_of - range, as_of]``; ties by query text."""
    as_of = as_of if as_of is not None else log.select(F.max("ts")).scalar()
    lo = as_of - F.expr(T.parse_time_range(time_range))
    return (
        log.where((F.col("ts") > lo) & (F.col("ts") <= as_of))
        .groupBy("query")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("query").asc())
        .limit(n)
    )


#: Hits (a few numbers each) that are sent to the texts at most; of more, the texts are shuffled to them.
SENT_HITS = 300_000


# Reranker features
def rerank_features(hits: DataFrame, queries: DataFrame, docs: DataFrame, feedback: DataFrame,
                    created: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Five features per hit: score, length/1000, term overlap, freshness, feedback."""
    d = docs.select("doc_id", "text", *( [created] if created else []))
    x = d.join(bounded_broadcast(hits, SENT_HITS), "doc_id").join(queries.select("query_id", "query"), "query_id")
    age = (F.datediff(as_of, F.col(created)).cast("double") if created and as_of is not None else F.lit(None).cast("double"))
    x = x.select(
        "query_id", "doc_id", "score",
        T.length_feature("text").alias("length"),
        T.term_overlap(T.ws_tokens("query"), T.ws_tokens("text")).alias("overlap"),
        T.freshness(age).alias("freshness"),
    )
    return feedback_score(x, feedback)


# M2 / M4 / L2
RERANK_FEATURES = ["score", "length", "overlap", "freshness", "feedback"]


def fit_reranker(train: DataFrame, label: str = "label", trees: int = 100, seed: int = 42):
    """Random-forest regressor on the five rerank features; refit from feedback on a schedule (M4)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    return Pipeline(stages=[
        VectorAssembler(inputCols=RERANK_FEATURES, outputCol="features", handleInvalid="keep"),
        RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, seed=seed),
    ]).fit(train.withColumn(label, F.col(label).cast("double")))


def rerank(model, feats: DataFrame, k: int = TOP_K) -> DataFrame:
    """Predicted relevance per hit, re-ranked per query (ties by doc_id)."""
    out = model.transform(feats).withColumnRenamed("prediction", "predicted").drop("features")
    w = Window.partitionBy("query_id").orderBy(F.col("predicted").desc(), F.col("doc_id"))
    return out.withColumn("rerank", F.row_number().over(w).cast("bigint")).where(F.col("rerank") <= F.lit(k))
