"""Property tests (hypothesis): many generated documents per Spark job."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import documents as D

WORD = st.text(alphabet="abcdefghij", min_size=1, max_size=12)
SENTENCE = st.builds(lambda ws, end: " ".join(ws) + end, st.lists(WORD, min_size=1, max_size=40), st.sampled_from([".", "!", "?"]))
DOC = st.lists(SENTENCE, min_size=0, max_size=60).map(lambda ss: " ".join(ss))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOC, min_size=1, max_size=40), st.sampled_from([50, 200, 1000]))
def test_chunks_rejoin_to_sentences_and_respect_limit(spark, docs, limit):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    rows = D.chunk_documents(df, max_length=limit).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_no)):
        by_doc.setdefault(r.doc_id, []).append(r.chunk)
    for i, text in enumerate(docs):
        sents = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
        chunks = by_doc.get(i, [])
        assert " ".join(chunks) == " ".join(sents)
        for c in chunks:
            parts = [s for s in re.split(r"(?<=[.!?])\s+", c) if s]
            assert sum(len(p) for p in parts) <= limit or len(parts) == 1


TOKEN = st.sampled_from(list("abcdefgh"))
CORPUS = st.lists(st.lists(TOKEN, min_size=0, max_size=12).map(" ".join), min_size=2, max_size=25)
QUERIES = st.lists(st.lists(TOKEN, min_size=1, max_size=6).map(" ".join), min_size=1, max_size=5)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(CORPUS, QUERIES)
def test_bm25_equals_brute_force_and_scores_in_unit_range(spark, corpus, queries):
    import pytest
    from hypothesis import assume

    assume(any(corpus))  # an all-empty corpus has no average length (the brute force divides by it)
    from test_units import brute_bm25

    from tessera.operators import retrieval as R
    from tessera.operators import segments as SG

    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(j, t, []) for j, t in enumerate(queries)], "query_id long, query string, kb_ids array<string>")
    found = SG.raw_best(SG.build(docs), q.withColumnRenamed("kb_ids", "kb"), 1000)
    got = {(r.query_id, r.doc_id): r.raw for r in found.collect()}
    for j, text in enumerate(queries):
        want = brute_bm25(corpus, text)
        for d, s in enumerate(want):
            assert got.get((j, d), 0.0) == pytest.approx(s, abs=1e-9)
    hits = R.bm25_search(q, docs, k=5).collect()
    assert all(0.0 <= h.score <= 1.0 for h in hits)
    assert len(hits) == len(queries) * min(5, len(corpus))
