"""Search index of immutable segments, and exact top-k over it without pair tables.

A segment holds up to ``DOCS`` documents in one row: ids, sources, lengths, a dictionary
of terms with their postings, and the documents' vectors with a centre and a radius.
Terms and postings are stored as bytes, a few values a row to the JVM and not one an entry.
Document count, total length and document frequencies of segments add up, so an index
over new documents is appended to one over old ones (``append``) and statistics are
merged on read; no segment is ever rewritten.

A search sends its query terms (size-checked blocks of queries) to the segments.  In a
segment every query has an upper bound: for BM25 the sum of its terms' greatest impacts
there, for vectors ``q.c + |q| r`` around the centre.  Where the bound (for hybrid
search the fused one) is below the k-th best score that the task has seen, the segment
is skipped for that query; otherwise its postings are added up document by document, in
``CELLS`` at a time.  A task emits about k rows a query.  Pairs of queries and documents
are never written or shuffled, and a query's sources are filtered inside the segment.

BM25 alone takes one pass: a normalised score is rounded to 6 decimals, ties go to the
smaller id, and the range for normalising is known only at the end; so a task keeps all
scores within ``SLACK`` of the possible range below its k-th best, of equal ones the k
smallest ids.  A query is never skipped if a weight is negative, or if all documents may
hold one of its terms, as its least score is then not known to be 0.

Defined results: null and empty texts and queries have no terms (raw score 0); a null
source is the empty string; a document or query without a vector has semantic score 0
and stays out of the semantic range; of several vectors of an id the least counts; rows
that repeat a document id are documents of their own that share its vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.guards import collect_bounded
from tessera.session import LARGE_ROWS, materialize, small_batches

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and tokens of a segment at most (one longer document has its own), so that a row is no large object to the JVM; cells of queries x documents, and products of postings and queries, held at a time.
DOCS, TOKENS, CELLS, PRODUCTS = 64, 1 << 17, 1 << 17, 1 << 19
#: Documents, and segments (150 KB or so each), that a task reads at a time.
TEXTS, SEGMENTS = 128, 4
#: Share of the possible range within which scores may round to the same 6 decimals.
SLACK = 2e-6
#: Queries and query terms that a block sends to the tasks at most.
QUERIES, TERMS = 50_000, 2_000_000
#: Dictionary entries whose document frequencies a task sums at a time, and sums that it sends at a time.
COUNTED, SENT = 1 << 16, 1 << 13
SEGMENT = "seg string, doc_ids array<long>, sources array<string>, lens array<long>, terms array<string>, dfs array<int>, places array<int>, tfs array<int>"
#: The same as it is stored: the terms joined, and where each ends; numbers of 4 bytes.
STORED = "seg string, doc_ids array<long>, sources array<string>, lens array<long>, terms binary, ends binary, dfs binary, places binary, tfs binary"
VECTORS = "seg string, filled array<int>, matrix binary, centre binary, radius double"
INT, LONG, TEXT = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())


@dataclass
class SegmentIndex:
    """``segments`` as above; ``terms``: term, df, idf; numbers of documents and tokens."""

    segments: DataFrame
    terms: DataFrame
    n_docs: int
    n_tokens: int

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A row for every ``most`` documents or ``TOKENS`` tokens; texts are read one by one, and only term numbers are held."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    ids, sources, codes, words = [], [], [], {}

    def segment() -> pa.RecordBatch:
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        key, tf = np.unique(np.concatenate(codes).astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        dfs = np.bincount(key // len(sizes), minlength=len(words))
        values = pa.array(ids, pa.int64()), pa.array(sources, pa.string()), sizes, pa.array(list(words), pa.string()), dfs, key % len(sizes), tf
        columns = [pa.array([uuid.uuid4().hex])]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, k.value_type)) for v, k in zip(values, (LONG, TEXT, LONG, TEXT, INT, INT, INT))]
        for held in (ids, sources, codes, words):
            held.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    n_tokens = 0
    for batch in batches:
        for doc_id, source, text in zip(*(batch.column(c) for c in ("doc_id", "source", "text"))):
            tokens = (text.as_py() or "").split()
            if codes and (len(codes) == most or n_tokens + len(tokens) > TOKENS):
                yield segment()
                n_tokens = 0
            ids.append(doc_id.as_py())
            sources.append(source.as_py())
            codes.append(np.fromiter((words.setdefault(w, len(words)) for w in tokens), np.int32, len(tokens)))
            n_tokens += len(tokens)
    if codes:
        yield segment()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``SEGMENT`` -> ``STORED``."""
    for batch in batches:
        lists = {c: [batch.column(c)[i].values for i in range(batch.num_rows)] for c in ("terms", "dfs", "places", "tfs")}
        numbers = {c: [x.to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for x in lists[c]] for c in ("dfs", "places", "tfs")}
        ends = [np.cumsum(pc.binary_length(x).to_numpy(zero_copy_only=False)).astype(np.int32).tobytes() for x in lists["terms"]]
        terms = pc.binary_join(batch.column("terms"), "").cast(pa.binary())
        columns = [*(batch.column(c) for c in ("seg", "doc_ids", "sources", "lens")), terms, *(pa.array(x, pa.binary()) for x in (ends, *numbers.values()))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STORED.split(", ")])


def _terms(data: bytes, ends: bytes) -> pa.Array:
    """The terms of a stored segment."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.frombuffer(ends, np.int32)])
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(terms, ends, dfs) of stored segments -> term, df; summed over ``COUNTED`` entries or so of a task at a time."""
    held: list[pa.Table] = []

    def summed() -> list[pa.RecordBatch]:
        found = pa.concat_tables(held).group_by("term").aggregate([("df", "sum")])
        held.clear()
        return pa.table({"term": found["term"], "df": found["df_sum"]}).to_batches(max_chunksize=SENT)

    for batch in batches:
        for terms, ends, dfs in zip(*(batch.column(c).to_pylist() for c in ("terms", "ends", "dfs"))):
            held.append(pa.table({"term": _terms(terms, ends), "df": pa.array(np.frombuffer(dfs, np.int32), pa.int64())}))
            if sum(map(len, held)) >= COUNTED:
                yield from summed()
    if held:
        yield from summed()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, held) -> ``VECTORS``."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for held in batch.column("held"):
            held = sorted(held.as_py(), key=lambda x: x["place"])
            matrix = np.array([x["dvec"] for x in held], np.float64)
            centre = matrix.mean(0)
            radius = float(np.sqrt(((matrix - centre) ** 2).sum(1)).max())
            for column, value in zip(rows, ([x["place"] for x in held], matrix.tobytes(), centre.tobytes(), radius)):
                column.append(value)
        kinds = INT, pa.binary(), pa.binary(), pa.float64()
        yield pa.RecordBatch.from_arrays([batch.column("seg"), *map(pa.array, rows, kinds)], ["seg", "filled", "matrix", "centre", "radius"])


def build(docs: DataFrame, vectors: DataFrame | None = None, eps: float = EPSILON, most: int = DOCS) -> SegmentIndex:
    """Index of ``docs`` (doc_id, text, source) and their ``vectors`` (doc_id, dvec), in segments of up to ``most`` (``DOCS`` at most)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    segments = rows.mapInArrow(lambda batches: _stored(_segments(batches, min(most, DOCS))), STORED)
    if vectors is None:
        none = {"filled": "array<int>", "matrix": "binary", "centre": "binary", "radius": "double"}
        segments = segments.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    else:
        segments = materialize(segments, "segments-text", TEXTS, LARGE_ROWS)
        one = vectors.where("dvec is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("dvec").alias("dvec"))
        places = segments.select("seg", F.posexplode("doc_ids").alias("place", "doc_id")).join(one, "doc_id")
        held = places.groupBy("seg").agg(F.collect_list(F.struct("place", "dvec")).alias("held"))  # ``DOCS`` vectors at most
        segments = segments.join(held.mapInArrow(_packed, VECTORS), "seg", "left")
    return read(materialize(segments, "segments", TEXTS if vectors is None else SEGMENTS, LARGE_ROWS), eps)


def read(segments: DataFrame, eps: float = EPSILON) -> SegmentIndex:
    """Merged statistics of segments, however many builds they come from."""
    with small_batches(segments.sparkSession, SEGMENTS):
        n_docs, n_tokens = segments.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
        held = segments.select("terms", "ends", "dfs").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        raw = materialize(held.withColumn("idf_raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "segment-terms")
    mean = F.lit(raw.agg(F.avg("idf_raw")).first()[0]).cast("double")
    terms = raw.select("term", "df", F.when(F.col("idf_raw") < 0, F.lit(eps) * mean).otherwise(F.col("idf_raw")).alias("idf"))
    return SegmentIndex(segments, terms, n_docs, n_tokens)


def append(index: SegmentIndex, more: SegmentIndex, eps: float = EPSILON) -> SegmentIndex:
    """One index over the documents of both; the segments stay as they are."""
    return read(index.segments.unionByName(more.segments), eps)


# ---------------------------------------------------------------- queries


class Chunk:
    """Queries whose scores for one segment fit ``CELLS``, with their weights by term."""

    def __init__(self, ids, sources, vectors, terms, queries, weights, dfs, bounds, index_docs: int, n_terms: int):
        self.ids, self.sources = ids, sources
        order = np.argsort(terms, kind="stable")
        self.query, self.weight = queries[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        least = np.full(len(ids), 0.0)
        np.minimum.at(least, queries, weights)
        reach = np.bincount(queries, dfs, len(ids))
        #: All weights at least 0, and some document without a term: the least raw score is 0.
        self.skippable = (least >= 0) & (reach < index_docs) & np.array([s is None for s in sources], bool)
        self.slack = SLACK * (K1 + 1) * np.bincount(queries, np.abs(weights), len(ids))
        self.has = np.array([i for i, v in enumerate(vectors) if v is not None], np.int64)
        self.matrix = np.array([vectors[i] for i in self.has], np.float64) if len(self.has) else np.zeros((0, 0))
        self.norms = np.sqrt((self.matrix**2).sum(1))
        #: bmn, bmx, smn, smx of each query, once they are known.
        self.bounds = bounds


class Segment:
    """A row of the index with the impacts of the searched terms."""

    def __init__(self, row: dict, terms: pa.Array, avgdl: float, k1: float, b: float):
        self.ids = np.array(row["doc_ids"], np.int64)
        names = row["sources"].dictionary_encode()
        self.sources, self.source = names.dictionary.to_pylist(), names.indices.to_numpy()
        self.filled, self.row, self._matrix = row["filled"], row, None
        known = pc.index_in(row["terms"], value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(known, row["dfs"])
        held = np.flatnonzero(of >= 0)
        self.place, tf = row["places"][held], row["tfs"][held].astype(np.float64)
        self.term = of[held]
        self.impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * row["lens"][self.place] / avgdl)) if len(held) else tf
        starts = np.flatnonzero(np.diff(self.term, prepend=-1))
        self.terms, self.most = self.term[starts], np.maximum.reduceat(self.impact, starts) if len(starts) else self.impact

    @property
    def matrix(self) -> np.ndarray:
        if self._matrix is None:
            self._matrix = np.frombuffer(self.row["matrix"]).reshape(len(self.filled), -1)
        return self._matrix

    def allowed(self, chunk: Chunk) -> np.ndarray:
        """Which documents each query may see."""
        out = np.ones((len(chunk.ids), len(self.ids)), bool)
        for i, names in enumerate(chunk.sources):
            if names is not None:
                out[i] = np.array([s in names for s in self.sources], bool)[self.source]
        return out

    def products(self, chunk: Chunk, terms: np.ndarray, live: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``terms``, query, weight) of each query of each term, ``PRODUCTS`` at a time."""
        counts = chunk.starts[terms + 1] - chunk.starts[terms]
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(terms):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + PRODUCTS, "right")))
            n = counts[begin:end]
            at = np.repeat(np.arange(begin, end), n)
            pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(chunk.starts[terms[begin:end]], n)
            query = chunk.query[pair]
            if live is not None:
                at, pair, query = at[live[query]], pair[live[query]], query[live[query]]
            yield at, query, chunk.weight[pair]
            begin = end

    def bound(self, chunk: Chunk) -> np.ndarray:
        """No document has a greater raw score (of the terms with a weight of at least 0)."""
        out = np.zeros(len(chunk.ids))
        for at, query, weight in self.products(chunk, self.terms):
            out += np.bincount(query, np.maximum(weight, 0) * self.most[at], len(chunk.ids))
        return out

    def raw(self, chunk: Chunk, live: np.ndarray) -> np.ndarray:
        """Raw score of every document for the live queries, a row each."""
        width = len(self.ids)
        out = np.zeros(len(chunk.ids) * width)
        for at, query, weight in self.products(chunk, self.term, live):
            out += np.bincount(query * width + self.place[at], weight * self.impact[at], len(out))
        return out.reshape(-1, width)

    def semantic_bound(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that a query with a vector can have here."""
        centre = chunk.matrix @ np.frombuffer(self.row["centre"])
        reach = chunk.norms * self.row["radius"] * (1 + 1e-9) + 1e-9
        return centre - reach, centre + reach


class Best:
    """The k best of a task for each query of a chunk, and all within ``slack`` of the last of them."""

    def __init__(self, n: int, k: int, slack: np.ndarray):
        self.k, self.slack, self.last = k, slack, np.full(n, -np.inf)
        self.query, self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.parts: tuple[np.ndarray, ...] = ()

    @property
    def least(self) -> np.ndarray:
        return self.last - self.slack

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, *parts: np.ndarray) -> None:
        """``parts``: further values of these rows, the same number of them at each call."""
        parts = tuple(map(np.concatenate, zip(self.parts, parts))) if self.parts else parts
        query, doc, score = np.concatenate([self.query, query]), np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        at = np.arange(len(query))
        place = at - np.searchsorted(query, query)
        self.last[query[place == self.k - 1]] = score[place == self.k - 1]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1])
        among_equal = at - np.maximum.accumulate(np.where(new, at, 0))
        keep = (score >= self.least[query]) & (among_equal < self.k)
        self.query, self.doc, self.score = query[keep], doc[keep], score[keep]
        self.parts = tuple(x[order[keep]] for x in parts)


def _chunks(spark, index: SegmentIndex, queries: DataFrame, vectors: DataFrame | None, params: DataFrame | None) -> Iterator:
    """Broadcasts of (terms, chunks) of blocks of queries; ``queries``: query_id, query, kb."""
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))
    terms = queries.select("query_id", F.explode_outer(T.ws_tokens("query")).alias("term")).where(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weights = terms.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df")
    heads = queries.select("query_id", "kb")
    if vectors is not None:
        heads = heads.join(vectors.where("qvec is not null").groupBy("query_id").agg(F.min("qvec").alias("qvec")), "query_id", "left")
    if params is not None:
        heads = heads.join(params, "query_id", "left")
    for block in range(blocks):
        mine = lambda df: df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else df  # noqa: E731,B023
        head = collect_bounded(mine(heads), 2 * QUERIES, "queries").drop_duplicates("query_id").sort_values("query_id")
        held = collect_bounded(mine(weights), TERMS, "query terms")
        ids, names = head["query_id"].to_numpy(np.int64), sorted(set(held["term"]))
        of = {t: i for i, t in enumerate(names)}
        term = held["term"].map(of).to_numpy(np.int64) if len(held) else np.empty(0, np.int64)
        place = np.searchsorted(ids, held["query_id"].to_numpy(np.int64)) if len(held) else np.empty(0, np.int64)
        kbs = [frozenset(x) if x is not None and len(x) else None for x in head["kb"]]
        vecs = [None if v is None else np.asarray(v, np.float64) for v in head["qvec"]] if "qvec" in head else [None] * len(ids)
        bounds = {c: head[c].to_numpy(np.float64) for c in ("bmn", "bmx", "smn", "smx") if c in head}
        step, chunks = max(1, CELLS // DOCS), []
        for begin in range(0, len(ids), step):
            own = slice(begin, begin + step)
            here = (place >= begin) & (place < begin + step)
            weight, df = (held[c].to_numpy(np.float64)[here] for c in ("weight", "df"))
            chunks.append(Chunk(ids[own], kbs[own], vecs[own], term[here], place[here] - begin, weight, df, {c: v[own] for c, v in bounds.items()}, index.n_docs, len(names)))
        yield spark.sparkContext.broadcast((names, chunks))


def _union(frames) -> DataFrame:
    out, *rest = frames
    for f in rest:
        out = out.unionByName(f)
    return out


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], avgdl: float, k1: float, b: float) -> Iterator[Segment]:
    terms = pa.array(names, pa.string())
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in ("doc_ids", "sources", "filled", "matrix", "centre", "radius", "terms", "dfs", "places", "tfs", "lens")}
            row |= {c: row[c].as_py() for c in ("matrix", "centre", "radius", "filled")}
            row |= {c: row[c].values.to_numpy() if pa.types.is_list(row[c].type) else np.frombuffer(row[c].as_py(), np.int32) for c in ("doc_ids", "dfs", "places", "tfs", "lens")}
            row |= {"terms": row["terms"].values if pa.types.is_list(row["terms"].type) else _terms(row["terms"].as_py(), batch.column("ends")[i].as_py())}
            yield Segment(row | {"sources": row["sources"].values}, terms, avgdl, k1, b)


RAW = "query_id long, doc_id long, raw double, bmn double, bmx double, smn double, smx double"


def raw_best(index: SegmentIndex, queries: DataFrame, k: int, vectors: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """Every document that may be among the k best by BM25, and the range of raw (and semantic) scores that its task saw.

    ``queries``: query_id, query, kb (sources; null or empty: all).  The k best documents of
    all rows are those of the whole table; the ranges of all rows together are exact.
    """
    avgdl, with_vectors = index.avgdl, vectors is not None

    def scan(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chunks = sent.value
        state = [(Best(len(c.ids), k, c.slack), np.where(c.skippable, 0.0, np.inf), np.full(len(c.ids), -np.inf), np.full(len(c.ids), np.inf), np.full(len(c.ids), -np.inf)) for c in chunks]
        for segment in _rows(batches, names, avgdl, k1, b):
            for chunk, (best, bmn, bmx, smn, smx) in zip(chunks, state):
                live = ~chunk.skippable | (segment.bound(chunk) >= best.least)
                allowed = segment.allowed(chunk) if any(s is not None for s in chunk.sources) else np.ones((len(chunk.ids), len(segment.ids)), bool)
                if live.any():
                    raw = segment.raw(chunk, live)
                    seen = allowed & live[:, None]
                    np.minimum(bmn, np.where(seen, raw, np.inf).min(1), out=bmn)
                    np.maximum(bmx, np.where(seen, raw, -np.inf).max(1), out=bmx)
                    query, place = np.nonzero(seen & (raw >= best.least[:, None]))
                    best.add(query, segment.ids[place], raw[query, place])
                if with_vectors and segment.filled and len(chunk.has):
                    low, high = segment.semantic_bound(chunk)
                    open_ = np.flatnonzero((low < smn[chunk.has]) | (high > smx[chunk.has]))
                    inner = chunk.matrix[open_] @ segment.matrix.T
                    mask, own = allowed[np.ix_(chunk.has[open_], segment.filled)], chunk.has[open_]
                    smn[own] = np.minimum(smn[own], np.where(mask, inner, np.inf).min(1, initial=np.inf))
                    smx[own] = np.maximum(smx[own], np.where(mask, inner, -np.inf).max(1, initial=-np.inf))
        for chunk, (best, *ranges) in zip(chunks, state):
            values = [chunk.ids[best.query], best.doc, best.score, *(x[best.query] for x in ranges)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], [f.split()[0] for f in RAW.split(", ")])

    frames = [index.segments.mapInArrow(lambda batches, sent=sent: scan(sent, batches), RAW) for sent in _chunks(index.segments.sparkSession, index, queries, vectors, None)]
    return materialize(_union(frames), "segments-raw", SEGMENTS)


def ranges(found: DataFrame) -> DataFrame:
    """query_id, bmn, bmx, smn, smx of ``raw_best``; no semantic range (null) where no document with a vector was seen."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    return found.groupBy("query_id").agg(*[finite(f(c)).alias(c) for c, f in (("bmn", F.min), ("bmx", F.max), ("smn", F.min), ("smx", F.max))])


def _unit(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    span = (high - low).reshape(-1, *[1] * (x.ndim - 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(span == 0, 0.5, (x - low.reshape(span.shape)) / span)


def _round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def fused_best(index: SegmentIndex, queries: DataFrame, vectors: DataFrame, params: DataFrame, alpha: float, k: int, only_vectors: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """The k best of each task by ``alpha`` * BM25 + (1 - alpha) * semantic score: query_id, doc_id, score, bm25, semantic.

    ``params`` are the ranges of the queries.  ``only_vectors``: only documents and queries that have one.
    """
    avgdl = index.avgdl
    names_out = ["query_id", "doc_id", "score", "bm25", "semantic"]

    def scan(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chunks = sent.value
        state = [Best(len(c.ids), k, np.zeros(len(c.ids))) for c in chunks]
        for segment in _rows(batches, names, avgdl, k1, b):
            for chunk, best in zip(chunks, state):
                n, bounds = len(chunk.ids), chunk.bounds
                inner = np.zeros(n)
                meets = bool(segment.filled) and len(chunk.has) > 0
                if meets:
                    inner[chunk.has] = _unit(segment.semantic_bound(chunk)[1], bounds["smn"][chunk.has], bounds["smx"][chunk.has])
                text = _unit(segment.bound(chunk), bounds["bmn"], bounds["bmx"]) if alpha else np.zeros(n)
                top = alpha * np.maximum(text, 0.5 * (bounds["bmn"] == bounds["bmx"])) + (1 - alpha) * np.maximum(inner, 0)
                live = ~(top + 1e-6 < best.last)
                if only_vectors:
                    live &= np.isin(np.arange(n), chunk.has) & bool(meets)
                if not live.any():
                    continue
                allowed = segment.allowed(chunk) if any(s is not None for s in chunk.sources) else np.ones((n, len(segment.ids)), bool)
                bm25 = _unit(segment.raw(chunk, live), bounds["bmn"], bounds["bmx"]) if alpha else np.zeros((n, len(segment.ids)))
                semantic = np.zeros(bm25.shape)
                if meets:
                    own = chunk.has[live[chunk.has]]
                    products = chunk.matrix[live[chunk.has]] @ segment.matrix.T
                    semantic[np.ix_(own, segment.filled)] = _unit(products, bounds["smn"][own], bounds["smx"][own])
                score = _round6(alpha * bm25 + (1 - alpha) * semantic)
                seen = allowed & live[:, None]
                if only_vectors:
                    seen &= np.isin(np.arange(len(segment.ids)), segment.filled)
                query, place = np.nonzero(seen & (score >= best.last[:, None]))
                best.add(query, segment.ids[place], score[query, place], _round6(bm25[query, place]), _round6(semantic[query, place]))
        for chunk, best in zip(chunks, state):
            values = [chunk.ids[best.query], best.doc, best.score, *(best.parts or (np.empty(0), np.empty(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names_out)

    schema = "query_id long, doc_id long, score double, bm25 double, semantic double"
    frames = [index.segments.mapInArrow(lambda batches, sent=sent: scan(sent, batches), schema) for sent in _chunks(index.segments.sparkSession, index, queries, vectors, params)]
    return materialize(_union(frames), "segments-fused", SEGMENTS)
