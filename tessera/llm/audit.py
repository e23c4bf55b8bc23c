"""Filter interaction audit by truth-table survival words (operator 11).

Five filters judge each document; bit j of its ``fails`` says that filter j rejects it.
Its survival word has 32 bits, one for each subset of the filters: bit S is set if no
filter of S rejects the document.  Tasks add the words of a part and a label up by
position with carry-save adders (three words become a sum and a carry of twice the
weight), so a task sends 32 counts a part and label, however many rows a part has.  The
counts of all subsets give every order of the filters without another pass: after the
prefix P of an order ``n[P]`` documents are left.

The copy filter needs the whole table: the smallest id of each text comes from an
aggregate over text digests (SHA-256), which combines before its shuffle, and a document
finds out whether it is that one by a join on digest *and* id, a key that no two
documents of different ids share, so a text that a third of the rows hold is no hot key.

Defined results: a null text is empty; a null part is the empty string; a null id has no
label, is no copy and makes none; rows that repeat an id count each, are no copies of one
another and share its labels; of several label rows of an id any 1 counts; further
columns are not read; without documents there are no parts and no rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import as_bytes, slices
from tessera.session import materialize

#: Letters of the filters, in the order of the bits of ``fails``; E is the copy filter.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bits of ``tags``.
GOOD, TOXIC = 1, 2
#: Survival word of each value of ``fails``.
SURVIVAL = np.array([sum(1 << s for s in range(ALL + 1) if not s & fails) for fails in range(ALL + 1)], np.uint32)
#: (part, tags) pairs that a task holds counts of before it sends them.
HELD = 20_000


def text_failures(text: bytes, n_chars: int) -> int:
    """Bits of the filters that look at the text alone."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * n_chars) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def screen(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, fails (without the copy filter) and the digest of the text, a row for each row."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("part string, fails int, digest binary").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column("text")
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            texts = as_bytes(column)
            fails = pa.array([int(text_failures(t, n)) for t, n in zip(texts, sizes)], pa.int32())
            digests = pa.array([sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), fails, digests], ["doc_id", "part", "fails", "digest"])

    return rows.mapInArrow(judge, schema)


def with_copies(screened: DataFrame) -> DataFrame:
    """``screened`` with the copy filter's bit: some smaller id has the same text."""
    known = screened.where("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    bit = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    judged = known.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(bit).alias("fails"))
    return judged.union(screened.where("doc_id IS NULL").select("doc_id", "part", "fails"))


def with_tags(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails and tags (bits ``GOOD`` and ``TOXIC``) of every row."""
    of = lambda name, bit: F.max(F.when(F.col(name) == 1, bit).otherwise(0))
    marked = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg((of("quality", GOOD) + of("toxic", TOXIC)).alias("tags"))
    known = rows.where("doc_id IS NOT NULL").join(marked, "doc_id", "left")
    known = known.select("part", "fails", F.coalesce("tags", F.lit(0)).alias("tags"))
    return known.union(rows.where("doc_id IS NULL").select("part", "fails", F.lit(0).alias("tags")))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set: carry-save adders, then at most two words a weight."""
    counts, layer, weight = np.zeros(32, np.int64), words, 1
    while len(layer):
        carries = []
        while len(layer) > 2:
            third = len(layer) // 3
            a, b, c = layer[:third], layer[third : 2 * third], layer[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            layer = np.concatenate([half ^ c, layer[3 * third :]])
        for word in layer:
            counts += weight * ((int(word) >> np.arange(32)) & 1)
        layer, weight = np.concatenate(carries or [layer[:0]]), 2 * weight
    return counts


def popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, fails, tags) rows -> (part, tags, survivors) with the counts of a task."""
    held: dict[tuple[str, int], np.ndarray] = defaultdict(lambda: np.zeros(32, np.int64))

    def sent() -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([list(v) for v in held.values()], pa.list_(pa.int64()))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "tags", "survivors"])

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch.column("tags").to_numpy()
        order = np.argsort(key, kind="stable")
        words, key = SURVIVAL[batch.column("fails").to_numpy()][order], key[order]
        names = parts.dictionary.to_pylist()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(key)]):
            if end > begin:
                held[names[key[begin] // 4], int(key[begin] % 4)] += positional_popcount(words[begin:end])
        if len(held) > HELD:
            yield sent()
    if held:
        yield sent()


def subset_survivors(rows: DataFrame) -> DataFrame:
    """part and, for every subset of the filters, how many rows survive it: all, those tagged good, those tagged toxic."""
    counts = rows.select("part", "fails", "tags").mapInArrow(popcounts, "part string, tags int, survivors array<long>")

    def summed(tag: int) -> Column:
        return F.expr("array(" + ", ".join(f"sum(IF(tags & {tag} = {tag}, survivors[{s}], 0))" for s in range(ALL + 1)) + ")")

    return counts.groupBy("part").agg(summed(0).alias("n"), summed(GOOD).alias("n_good"), summed(TOXIC).alias("n_toxic"))


def shapley(n: str, bit: int) -> str:
    """SQL for the rows that a filter removes, summed over all orders: after S it stands in |S|! (4 - |S|)! of them."""
    share = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
    return " + ".join(f"{share(s)} * ({n}[{s}] - {n}[{s | bit}])" for s in range(ALL + 1) if not s & bit)


def steps() -> list[dict]:
    """All steps of all orders, with the filters before and after the step as bits."""
    out = []
    for letters in permutations(FILTERS):
        was = 0
        for step, letter in enumerate(letters, 1):
            now = was | 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(letters), "step": step, "own": FILTERS.index(letter), "was": was, "now": now})
            was = now
    return out


def orders(survivors: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,own:int,was:int,now:int>>")
    each = survivors.withColumn("sums", F.expr("array(" + ", ".join(shapley("n", 1 << j) for j in range(len(FILTERS))) + ")")).withColumn("at", F.explode(table))
    alone = F.col("at.now") - F.col("at.was")
    lost = lambda n: F.get(n, F.col("at.was")) - F.get(n, F.col("at.now"))
    return each.select(
        "part",
        "at.filter_order",
        "at.step",
        F.get("n", F.col("at.now")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", alone) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(ALL) - alone) - F.get("n", F.lit(ALL))).alias("unique_fails"),
        lost("n_good").alias("good_lost"),
        lost("n_toxic").alias("toxic_lost"),
        F.get("sums", F.col("at.own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole report for ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic)."""
    screened = materialize(screen(docs), "audit-screened")
    return orders(subset_survivors(with_tags(with_copies(screened), labels)))
