"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

A test item is found in a document that holds at least 80 % of the item's distinct
5-word shingles (A-Z lower-cased; with fewer words the whole sequence is the only
shingle).  Items are partitioned by size.  The sketch of an item is its ``k`` smallest
MinHash values, with k = size - ceil(0.8 * size) + 1: a document that lacks all of them
lacks too many shingles to qualify, so unlike banded signatures, which miss short items
in long documents, no match is lost.  A document probes the sketches of those partitions
whose items it is large enough for, and each item hit is verified by the exact count.

The items are the stated query set: they are broadcast, in blocks of a checked size; the
documents are read once a block and never shuffled.

Defined results: null and empty texts or items match nothing; repeated rows of either
table match each; a null id is carried as null; other columns pass through; empty tables
match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import as_bytes, give_back, shingles, slices
from tessera.session import materialize

SIZE, NUM, DEN = 5, 4, 5
#: Bytes of item shingles in one broadcast block.
BLOCK_BYTES = 32 << 20
MATCH = "array<struct<item_id:bigint,n_shingles:bigint,n_common:bigint>>"


def needed(n: np.ndarray | int):
    """Fewest shingles of an item of n that make a match: ceil(0.8 n)."""
    return (n * NUM + DEN - 1) // DEN


class Sketches:
    """The items of one block: sketches by size partition, and the shingles to verify."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]) -> None:
        self.items = [(i, s) for i, s in items if len(s)]
        self.sizes = np.array([len(s) for _, s in self.items], np.int64)
        self.partitions = []  # least shingles that a document needs, sketch values in order, item of each
        for power in sorted({int(n).bit_length() for n in self.sizes}):
            own = [i for i, n in enumerate(self.sizes.tolist()) if n.bit_length() == power]
            values = np.concatenate([self.items[i][1][: len(self.items[i][1]) - needed(len(self.items[i][1])) + 1] for i in own])
            of = np.repeat(own, [int(self.sizes[i] - needed(self.sizes[i]) + 1) for i in own])
            order = np.argsort(values, kind="stable")
            self.partitions.append((int(min(needed(self.sizes[i]) for i in own)), values[order], of[order]))

    def matches(self, held: np.ndarray) -> list[dict]:
        """Items found in a document with these sorted distinct shingles."""
        found: set[int] = set()
        for least, values, of in self.partitions:
            if len(held) >= least:
                at = np.searchsorted(held, values)
                hit = held[np.minimum(at, len(held) - 1)] == values
                if hit.any():
                    found.update(of[hit].tolist())
        out = []
        for i in sorted(found):
            item, own = self.items[i]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            common = int((held[at] == own).sum())
            if common >= needed(len(own)):
                out.append({"item_id": item, "n_shingles": len(own), "n_common": common})
        return out


def item_blocks(items: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Sketches]:
    """The items' shingles, a block of bounded size at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [shingles(x, SIZE).tobytes() for x in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(rows, pa.binary())], ["item_id", "shingles"])
        give_back()

    sets = materialize(items.select("item_id", text).mapInArrow(run, "item_id long, shingles binary"), "items")
    total = sets.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).collect() if blocks > 1 else sets.collect()
        yield Sketches([(r.item_id, np.frombuffer(r.shingles, np.uint64)) for r in rows])


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", matches: str = "matches", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the items found in each: array of (item_id, n_shingles, n_common)."""
    kept = docs.drop(matches).withColumn(matches, F.array().cast(MATCH))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_common", pa.int64())]))
    for block in item_blocks(items, block_bytes=block_bytes):
        kept = _annotate(kept, docs.sparkSession.sparkContext.broadcast(block), text, matches, kind)
    return kept


def _annotate(docs: DataFrame, block, text: str, matches: str, kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = block.value
        for batch in slices(batches, text):
            old = batch.column(matches).to_pylist()
            new = [before + sketches.matches(shingles(x, SIZE)) for x, before in zip(as_bytes(batch.column(text)), old)]
            columns = [pa.array(new, kind) if name == matches else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def search(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_common, containment of every match."""
    found = annotate(docs.select("doc_id", text), items, text).where(F.size("matches") > 0)
    rows = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    return rows.withColumn("containment", F.col("n_common") / F.col("n_shingles"))
