"""Substring dedup by fixed-block anchors (operator 9).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Every document's words are cut into
non-overlapping reference blocks of ``BLOCK`` = 7 words; any window of 13 words that
repeats covers a whole reference block of the document it repeats, so some rolling
window of 7 words hits that block.

1. Batches of documents send the hashes of their rolling windows, each once and marked
   if it is a reference block, to parts of the hash space.  A hash that two batches have
   and one of them as a block is an anchor hit, and both learn of it.
2. Around its hits each batch extends to all 13-word windows that cover the hit, and
   sends their hashes with the smallest doc_id that has them.  Batches whose own
   smallest id is not the smallest of all learn of it.
3. With that, and with the repeats within it, a batch knows every window that starts in
   a document with a smaller id; overlapping windows join to maximal repeats.

A text that a third of the documents hold counts once in a batch, never as pairs.  The
texts are dealt into batches once, as a bucketed table, and not shuffled again.

Defined results: null, empty and word-less texts have no words and keep the empty text;
a null id comes after all others; rows that repeat an id are one document, and don't
remove each other's words; the result has doc_id, n_words, n_removed, repeats and kept only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packed import BATCH_BYTES, pack, pack_plain, part_bits, part_cuts, shuffle_partitions, text_bytes, unpack, unpack_plain
from tessera.llm.words import as_bytes, windows, word_hashes
from tessera.session import materialize

WINDOW, BLOCK = 13, 7
LAST = (1 << 63) - 1  # stands for a null id
PACKED = "part int, batch long, hashes binary, more binary"
KINDS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, repeats array<struct<begin:bigint,end:bigint>>, kept string"


def deal(docs: DataFrame, text: str = "text") -> DataFrame:
    """(batch, doc_id, text), bucketed by batch: a batch is about ``BATCH_BYTES`` of whole texts, chosen by hash."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    batches, buckets = max(1, size // BATCH_BYTES), max(shuffle_partitions(spark), size // (32 << 20))
    name = f"substrings_{uuid.uuid4().hex}"
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(batches)).alias("batch"), "doc_id", F.col(text).alias("text"))
    rows.repartition(buckets, "batch").write.format("parquet").option("compression", "zstd").bucketBy(buckets, "batch").saveAsTable(name)
    return spark.table(name)


def _hashes(rows: pa.Table) -> list[np.ndarray]:
    return [word_hashes(x.split()) for x in as_bytes(rows.column("text"))]


def _ids(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()


def _batch(rows: pa.Table) -> int:
    return rows.column("batch")[0].as_py()


def _send(batch: int, keys: np.ndarray, more, bits: int, width: int) -> pa.Table:
    """A packed row for each part; ``more(begin, end)`` gives what goes along."""
    cuts, low = part_cuts(keys, bits, width), np.uint64((1 << width) - 1)
    kind = np.uint32 if width == 32 else np.uint64
    packed = [pack((keys[b:e] & low).astype(kind)) for _, b, e in cuts]
    return pa.table([[p for p, _, _ in cuts], [batch] * len(cuts), packed, [more(b, e) for _, b, e in cuts]], KINDS)


def _answer(part: int, batches: np.ndarray, keys: np.ndarray, width: int) -> pa.Table:
    """To each batch its keys, in full."""
    order = np.lexsort((keys, batches))
    batches, keys = batches[order], keys[order].astype(np.uint64) | np.uint64(part << width)
    begins = np.flatnonzero(np.diff(batches, prepend=-1))
    ends = [*begins[1:].tolist(), len(batches)]
    return pa.table([[part] * len(begins), batches[begins], [pack(keys[b:e]) for b, e in zip(begins.tolist(), ends)], [b""] * len(begins)], KINDS)


def _told(answers: pa.Table) -> np.ndarray:
    parts = [unpack(x, np.uint64) for x in answers.column("hashes").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def anchors(dealt: DataFrame, bits: int) -> DataFrame:
    """Hits between batches: (part, batch, hashes), the top ``bits + 32`` bits of hashes of 7-word windows.

    The shorter hashes can only add hits, which the longer windows then refute.
    """

    def probe(rows: pa.Table) -> pa.Table:
        found = [windows(h, BLOCK) for h in _hashes(rows) if len(h) >= WINDOW]
        if not found:
            return KINDS.empty_table()
        shift = np.uint64(32 - bits)
        blocks = np.unique(np.concatenate([x[::BLOCK] for x in found]) >> shift)
        keys = np.unique(np.concatenate(found) >> shift)
        marked = _member(keys, blocks)
        return _send(_batch(rows), keys, lambda b, e: np.packbits(marked[b:e]).tobytes(), bits, 32)

    def meet(rows: pa.Table) -> pa.Table:
        keys = [unpack(x, np.uint32) for x in rows.column("hashes").to_pylist()]
        marked = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for h, x in zip(keys, rows.column("more").to_pylist())])
        batches = np.repeat(rows.column("batch").to_numpy(), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, marked, batches = keys[order], marked[order], batches[order]
        begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        sizes = np.diff(np.append(begins, len(keys)))
        hit = np.repeat((sizes > 1) & (np.maximum.reduceat(marked, begins) > 0), sizes)
        return _answer(rows.column("part")[0].as_py(), batches[hit], keys[hit], 32)

    sent = dealt.groupBy("batch").applyInArrow(probe, PACKED)
    return sent.groupBy("part").applyInArrow(meet, PACKED)


def extend(dealt: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
    """13-word windows around hits that start in a document of another batch with a smaller id than any of the batch's own: (part, batch, hashes)."""

    def windows_of(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return KINDS.empty_table()
        told, found, owners = _told(answers), [], []
        for own, h in zip(_ids(rows).tolist(), _hashes(rows)):
            if len(h) < WINDOW:
                continue
            hit = np.flatnonzero(_member(windows(h, BLOCK) >> np.uint64(32 - bits), told))
            if not len(hit):
                continue
            n = len(h) - WINDOW + 1  # a hit at p is covered by the windows that start at p - 6 .. p
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.clip(hit - (WINDOW - BLOCK), 0, n), 1)
            np.add.at(edge, np.minimum(hit + 1, n), -1)
            found.append(windows(h, WINDOW)[np.cumsum(edge[:-1]) > 0])
            owners.append(np.full(len(found[-1]), own))
        if not found:
            return KINDS.empty_table()
        found, owners = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((owners, found))
        found, owners = found[order], owners[order]
        first = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        found, owners = found[first], owners[first]
        return _send(_batch(rows), found, lambda b, e: pack_plain(owners[b:e]), bits, 64 - bits)

    def smallest(rows: pa.Table) -> pa.Table:
        hashes = [unpack(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        batches = np.repeat(rows.column("batch").to_numpy(), [len(x) for x in hashes])
        owners = np.concatenate([unpack_plain(x, np.int64) for x in rows.column("more").to_pylist()])
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        batches, hashes, owners = batches[order], hashes[order], owners[order]
        begins = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        least = np.repeat(np.minimum.reduceat(owners, begins), np.diff(np.append(begins, len(hashes))))
        late = owners > least
        return _answer(rows.column("part")[0].as_py(), batches[late], hashes[late], 64 - bits)

    sent = dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(windows_of, PACKED)
    return sent.groupBy("part").applyInArrow(smallest, PACKED)


def remove(dealt: DataFrame, late: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (maximal, as word ranges) and kept (the other words, joined by a space)."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        told, ids = _told(answers), _ids(rows)
        words = [x.split() for x in as_bytes(rows.column("text"))]
        own = [windows(word_hashes(x), WINDOW) for x in words]
        hashes, owners = np.concatenate([*own, np.empty(0, np.uint64)]), np.repeat(ids, [len(x) for x in own])
        again = _member(hashes, told)
        order = np.lexsort((owners, hashes))
        ordered = hashes[order]
        begins = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        least = np.repeat(owners[order][begins], np.diff(np.append(begins, len(ordered))))
        again[order] |= owners[order] > least
        at, removed, repeats, kept = 0, [], [], []
        for x, h in zip(words, own):
            starts = np.flatnonzero(again[at : at + len(h)])
            at += len(h)
            if not len(starts):
                removed.append(0), repeats.append([]), kept.append(b" ".join(x).decode())
                continue
            gaps = np.flatnonzero(np.diff(starts) > WINDOW)
            first, last = starts[np.append(0, gaps + 1)], starts[np.append(gaps, len(starts) - 1)] + WINDOW
            spans, stay, done = list(zip(first.tolist(), last.tolist())), [], 0
            for begin, end in spans:
                stay += x[done:begin]
                done = end
            kept.append(b" ".join(stay + x[done:]).decode())
            removed.append(sum(e - b for b, e in spans))
            repeats.append([{"begin": b, "end": e} for b, e in spans])
        columns = [rows.column("doc_id").combine_chunks().cast(pa.int64()), pa.array([len(x) for x in words], pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, kind), pa.array(kept, pa.string())]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "repeats", "kept"])

    return dealt.groupBy("batch").cogroup(late.groupBy("batch")).applyInArrow(cut, RESULT)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    dealt = deal(docs, text)
    bits = part_bits(text_bytes(dealt) // 6)
    hits = materialize(anchors(dealt, bits), "substring-hits")
    late = materialize(extend(dealt, hits, bits), "substring-late")
    return remove(dealt, late)
