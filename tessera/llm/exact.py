"""Exact dedup against a minimal perfect hash of historical digests (operator 6).

``build`` makes the index: the distinct digests of the history, dealt into shards by
hash, each shard with a minimal perfect hash (displacements by bucket) whose slots hold
full digests, the winner's id and the number of copies.  ``dedup`` looks up the distinct
digests of the incoming rows; a lookup counts only if all bytes of the slot's digest
agree.  Members update the winner and the size of their slot, the others are grouped
among themselves.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
largest doc_id stays.  Defined results: null counts as the empty text; repeated rows
with one id count as copies and share the decision; a null id never stays unless all
ids of its group are null (then keep_id is null and kept is false); other columns are
not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import as_bytes, mix, slices
from tessera.session import materialize

#: Keys of one shard, on average; a shard is built and looked up in one task (about 1 MB).
SHARD_KEYS = 16_000
#: Keys of one bucket, on average, and displacements tried at a time.
BUCKET_KEYS, TRIED = 4, 64
#: Texts that a task reads at a time.
TEXTS = 1024


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each whole text, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [hashlib.sha256(x.lower()).digest() for x in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary")


def groups(rows: DataFrame) -> DataFrame:
    """digest, winner (largest doc_id), copies."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashes of each digest (rows of 32 bytes; the shard is told from the last eight)."""
    words = keys.reshape(-1, 32)[:, :24].copy().view("<u8")
    return words[:, 0], words[:, 1], words[:, 2]


def slot(second: np.ndarray, third: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """Where displacements send keys."""
    return (mix(second + moves * (third | np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slot of each key: all of 0 .. n-1, each once.

    Large buckets come first, each with the least displacement that finds free slots for
    all its keys; buckets of one key are given a free slot s as -s-1.
    """
    first, second, third = _parts(keys)
    n = len(first)
    buckets = max(1, n // BUCKET_KEYS)
    home = (first % np.uint64(buckets)).astype(np.int64)
    sizes = np.bincount(home, minlength=buckets)
    order, begins = np.argsort(home, kind="stable"), np.concatenate([[0], np.cumsum(sizes)])
    taken, moves, slots = np.zeros(n, bool), np.zeros(buckets, np.int64), np.empty(n, np.int64)
    for bucket in np.argsort(-sizes, kind="stable"):
        own = order[begins[bucket] : begins[bucket + 1]]
        if len(own) < 2:
            break
        tried, good = 0, ()
        while not len(good):
            at = slot(second[own][:, None], third[own][:, None], np.arange(tried, tried + TRIED, dtype=np.uint64), n)
            ordered = np.sort(at, axis=0)
            good = np.flatnonzero(~taken[at].any(0) & (ordered[1:] != ordered[:-1]).all(0))
            tried += TRIED
        tried -= TRIED
        moves[bucket], slots[own] = tried + good[0], at[:, good[0]]
        taken[slots[own]] = True
    free = iter(np.flatnonzero(~taken).tolist())
    for bucket in np.flatnonzero(sizes == 1):
        key = order[begins[bucket]]
        slots[key] = next(free)
        moves[bucket] = -slots[key] - 1
    return moves, slots


def locate(moves: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The only slot where each key can be."""
    first, second, third = _parts(keys)
    d = moves[(first % np.uint64(len(moves))).astype(np.int64)]
    return np.where(d < 0, -d - 1, slot(second, third, np.maximum(d, 0).astype(np.uint64), n))


def _sharded(frame: DataFrame, shards: int) -> DataFrame:
    return frame.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


INDEX = "shard int, moves binary, slots binary, winners binary, copies binary"


def build(history: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """Index (a row for each shard) over the groups of a history, and the number of shards.

    Shards are even, as every digest is in them once; none holds a hot text's copies.
    """
    shards = shards or max(1, -(-history.count() // SHARD_KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches):
            keys = _keys(rows.column("digest"))
            moves, slots = perfect_hash(keys)
            inverse = np.argsort(slots)
            arrays = [moves, keys[inverse], *(rows.column(c).fill_null(0).to_numpy()[inverse] for c in ("winner", "copies"))]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["shard", "moves", "slots", "winners", "copies"])

    known = _sharded(history.where("winner is not null"), shards).repartition(shards, "shard").sortWithinPartitions("shard")
    return known.select("shard", "digest", "winner", "copies").mapInArrow(run, INDEX), shards


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard, from batches sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards, begin = batch.column("shard").to_numpy(), 0
        for end in [*(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]:
            part = batch.slice(begin, end - begin)
            if part.num_rows and held and held[0].column("shard")[0] != part.column("shard")[0]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            if part.num_rows:
                held.append(part)
            begin = end
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def lookup(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of incoming rows with ``member``: whether the index has the digest; members get the slot's winner and copies on top."""
    columns = ["shard", "probe", "digest", "winner", "copies", "moves", "slots", "winners", "held"]
    null = {c: F.lit(None).cast("binary").alias(c) for c in ("digest", "moves", "slots", "winners", "held")}
    none = F.lit(None).cast("long")
    left = index.select("shard", F.lit(0).alias("probe"), null["digest"], none.alias("winner"), none.alias("copies"), "moves", "slots", "winners", F.col("copies").alias("held"))
    right = _sharded(incoming, shards).select("shard", F.lit(1).alias("probe"), "digest", "winner", "copies", *(null[c] for c in columns[5:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, moves, slots, winners, held = -1, None, None, None, None
        for batch in batches:
            of, probe, begin = batch.column("shard").to_numpy(), batch.column("probe").to_numpy(), 0
            for end in [*(np.flatnonzero(np.diff(of * 2 + probe)) + 1).tolist(), batch.num_rows]:
                part, begin = batch.slice(begin, end - begin), end
                if not part.num_rows:
                    continue
                if part.column("probe")[0].as_py() == 0:
                    shard = part.column("shard")[0].as_py()
                    moves, slots, winners, held = (np.frombuffer(part.column(c)[0].as_py(), t) for c, t in (("moves", np.int64), ("slots", np.uint8), ("winners", np.int64), ("held", np.int64)))
                    slots = slots.reshape(-1, 32)
                    continue
                keys = _keys(part.column("digest"))
                winner, copies = part.column("winner"), part.column("copies").to_numpy()
                member = np.zeros(len(keys), bool)
                if part.column("shard")[0].as_py() == shard and len(slots):
                    at = locate(moves, len(slots), keys)
                    member = (slots[at] == keys).all(1)
                    best = np.maximum(winner.fill_null(-(1 << 62)).to_numpy(), winners[at])
                    winner = pa.array(np.where(member, best, winner.fill_null(0).to_numpy()), pa.int64(), mask=~member & np.asarray(winner.is_null()))
                    copies = copies + np.where(member, held[at], 0)
                yield pa.RecordBatch.from_arrays([part.column("digest"), winner, pa.array(copies, pa.int64()), pa.array(member)], ["digest", "winner", "copies", "member"])

    both = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "probe")
    return both.mapInArrow(run, "digest binary, winner long, copies long, member boolean")


def dedup(incoming: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """A row for each row of history and incoming: doc_id, digest, keep_id, group_size, kept."""
    new = materialize(digests(incoming), "exact-new", TEXTS)
    rows = new
    merged = groups(new)
    if history is not None:
        old = materialize(digests(history), "exact-old", TEXTS)
        rows = old.unionByName(new)
        known = materialize(groups(old), "exact-known")
        index, shards = build(known)
        found = materialize(lookup(merged, index, shards), "exact-found")
        # slots that got new copies count with these; the others stay; nonmembers are groups of their own
        untouched = known.join(found.where("member").select("digest"), "digest", "left_anti")
        merged = untouched.select("digest", "winner", "copies").union(found.select("digest", "winner", "copies"))
    out = rows.join(merged, "digest")
    return out.select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("winner"), F.lit(False)).alias("kept"))
