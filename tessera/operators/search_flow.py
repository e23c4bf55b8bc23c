"""The whole search: retrieve, rerank, cluster, collapse, cut (L1: the cut comes last)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import clustering as C
from tessera.operators import retrieval as R


def collapsed_top_k(hits: DataFrame, dvecs: DataFrame, k: int, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Ranked hits (query_id, rank, doc_id, ...) with one hit of each cluster kept, ranked anew and cut to ``k``.

    Documents without a vector are noise (cluster_id -1) and all kept.
    """
    kept = C.collapse_clusters(C.cluster_results(hits, dvecs, eps, min_samples))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return kept.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= F.lit(k)).withColumn("rank", F.col("_place").cast("bigint")).drop("_place")


def search_pipeline(queries: DataFrame, docs: DataFrame, qvecs: DataFrame, dvecs: DataFrame, feedback: DataFrame,
                    predict: Callable[[DataFrame], DataFrame], candidates: int = 50, top_k: int = R.TOP_K, eps: float = 0.5,
                    min_samples: int = 2, index: R.SegmentIndex | None = None) -> DataFrame:
    """Hybrid ``candidates`` a query, reranked by ``predict``, clustered, collapsed, then cut to ``top_k``.

    ``predict`` adds a column ``predicted`` to the rerank features (a fitted forest's
    ``transform``, or any expression).  Ties of predictions go to the smaller doc_id.
    """
    hits = R.hybrid_search(queries, docs, qvecs, dvecs, k=candidates, index=index)
    feats = predict(R.rerank_features(hits.select("query_id", "doc_id", "score"), queries, docs, feedback))
    reranked = R.top_k(feats.select("query_id", "doc_id", "score", "predicted"), candidates, score="predicted")
    return collapsed_top_k(reranked, dvecs, top_k, eps, min_samples)
