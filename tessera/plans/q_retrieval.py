"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6

from tessera.operators import retrieval as R
from tessera.operators import search_flow as SF
from tessera.operators import segments as SG
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register


@register("bm25_search")
def bm25_search(spark, sf_dir):
    """Full-text search: whole benchmark texts against all documents, top 10 each."""
    docs = fx.documents(spark, sf_dir)
    hits = R.bm25_search(fx.search_queries(spark, sf_dir), docs, k=10)
    return R.attach_documents(hits, docs, ("source", "lang"))


@register("kb_search")
def kb_search(spark, sf_dir):
    """Full-text search restricted to each query's knowledge base (source)."""
    docs = fx.documents(spark, sf_dir)
    hits = R.bm25_search(fx.kb_queries(spark, sf_dir), docs, k=10)
    return R.attach_documents(hits, docs, ("source",))


@register("semantic_search")
def semantic_search(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return R.search(fx.search_queries(spark, sf_dir), docs, fx.query_vectors(spark, sf_dir), fx.doc_vectors(spark, sf_dir), mode="semantic", k=10)


@register("hybrid_search")
def hybrid_search(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return R.search(fx.search_queries(spark, sf_dir), docs, fx.query_vectors(spark, sf_dir), fx.doc_vectors(spark, sf_dir), mode="hybrid", k=10)


@register("mixed_search")
def mixed_search(spark, sf_dir):
    """Hybrid, semantic and text searches with a top_k each, all over one index."""
    index = SG.build(fx.documents(spark, sf_dir), fx.doc_vectors(spark, sf_dir))
    return R.search_each(fx.mixed_queries(spark, sf_dir), index, fx.query_vectors(spark, sf_dir))


@register("appended_index")
def appended_index(spark, sf_dir):
    """Corpus statistics of an index over the documents of even ids, appended with one over all others (G1)."""
    docs = fx.documents(spark, sf_dir)
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    index = SG.append(SG.build(docs.where(even)), SG.build(docs.where(~even)))
    return index.terms.select("term", "df", round6("idf").alias("idf"), F.lit(index.n_docs).cast("bigint").alias("n_docs"), round6(F.lit(index.avgdl)).alias("avgdl"))


@register("corpus_stats")
def corpus_stats(spark, sf_dir):
    s = R.corpus_stats(fx.documents(spark, sf_dir))
    return s.select("term", "df", round6("idf").alias("idf"), "n_docs", round6("avgdl").alias("avgdl"))


@register("latest_feedback")
def latest_feedback(spark, sf_dir):
    return R.latest_feedback(fx.feedback_events(spark, sf_dir))


@register("top_queries")
def top_queries(spark, sf_dir):
    return R.top_queries(fx.search_log(spark, sf_dir), "7d", n=10)


@register("rerank_features")
def rerank_features(spark, sf_dir):
    """Features of the hybrid top-10 hits: score, length, overlap, freshness, feedback."""
    docs = fx.documents(spark, sf_dir)
    q = fx.search_queries(spark, sf_dir)
    hits = R.hybrid_search(q, docs, fx.query_vectors(spark, sf_dir), fx.doc_vectors(spark, sf_dir), k=10)
    feats = R.rerank_features(hits.select("query_id", "doc_id", "score"), q, docs, fx.feedback_from_labels(spark, sf_dir))
    return feats.select("query_id", "doc_id", "score", round6("length").alias("length"), round6("overlap").alias("overlap"),
                        round6("freshness").alias("freshness"), round6("feedback").alias("feedback"))


@register("vector_clusters")
def vector_clusters(spark, sf_dir):
    """DBSCAN (eps 1.1, min_samples 2) over all embedding vectors as one result set in id order, by the distributed path."""
    from tessera.operators import clustering as C

    e = fx.table(spark, sf_dir, "embeddings")
    pts = e.select(F.lit(0).cast("bigint").alias("key"), F.col("vec_id").alias("pid"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return C.dbscan(pts, eps=1.1, min_samples=2, small_group=0).select(F.col("pid").alias("vec_id"), "cluster_id")


#: Hits of a query that are reranked or clustered before the cut.
CANDIDATES = 30


@register("collapsed_hits")
def collapsed_hits(spark, sf_dir):
    """Hybrid candidates per query, clustered on document vectors (eps 1.1), one hit per cluster, then the top 10."""
    docs, dv = fx.documents(spark, sf_dir), fx.doc_vectors(spark, sf_dir)
    hits = R.hybrid_search(fx.search_queries(spark, sf_dir), docs, fx.query_vectors(spark, sf_dir), dv, k=CANDIDATES)
    return SF.collapsed_top_k(hits, dv, 10, eps=1.1).select("query_id", "rank", "doc_id", "score", "cluster_id")


@register("search_flow")
def search_flow(spark, sf_dir):
    """The whole search with a fixed linear score in the forest's place: retrieve, rerank, cluster, collapse, cut to 10."""
    predicted = round6(0.5 * F.col("score") + 0.2 * F.col("overlap") + 0.1 * F.col("freshness") + 0.2 * F.col("feedback"))
    out = SF.search_pipeline(fx.search_queries(spark, sf_dir), fx.documents(spark, sf_dir), fx.query_vectors(spark, sf_dir), fx.doc_vectors(spark, sf_dir),
                             fx.feedback_from_labels(spark, sf_dir), lambda f: f.withColumn("predicted", predicted), CANDIDATES, 10, eps=1.1)
    return out.select("query_id", "rank", "doc_id", "score", "predicted", "cluster_id")


@register("reranked_hits")
def reranked_hits(spark, sf_dir):
    """Reranker trained on labelled documents' feedback (1..5), applied to the hybrid candidates, then cut to 10 (M2, M4, L2)."""
    docs = fx.documents(spark, sf_dir)
    q = fx.search_queries(spark, sf_dir)
    fb = fx.feedback_from_labels(spark, sf_dir)
    hits = R.hybrid_search(q, docs, fx.query_vectors(spark, sf_dir), fx.doc_vectors(spark, sf_dir), k=CANDIDATES)
    feats = R.rerank_features(hits.select("query_id", "doc_id", "score"), q, docs, fb)
    train = feats.join(fb.withColumnRenamed("score", "label"), "doc_id")
    model = R.fit_reranker(train, "label", trees=100, seed=42)
    return R.rerank(model, feats).select("query_id", "doc_id", "rerank", round6("predicted").alias("predicted"))
