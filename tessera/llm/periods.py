"""Periodic runs of words by a dictionary of basic factors (operator 13).

For each power of two m every factor of m words of a document gets a name; the names of
length 2 m come from pairs of names of length m.  Where a factor's next occurrence is at
most 2 m words on, the distance d proposes the period d; neighbouring positions with the
same distance are one arithmetic progression, whose ends bound a stretch of period d.
Stretches that are long enough are extended word by word as far as the period holds and
then made distinct.  A run of period q is found at the length q <= m < 2 q at the latest:
its root is primitive, so inside the run such a factor comes again after q words and
not before.  A factor that occurs once in its document has no longer factor that occurs
twice, so its position leaves the dictionary, and in ordinary prose few positions are
left after the first lengths.

Names are those of word sequences, not of hashes, so nothing needs a further comparison.
All documents of a slice of text share the arrays; names carry the document's number, so
no factor is found in another one.

Defined results: a null text has no words; texts of any length are taken whole; rows
that repeat an id are judged each; other columns pass through (columns called like the
results are replaced); without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import as_bytes, give_back, slices

#: A run has this many words and this many times its period at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Documents that a task reads, and text bytes that it holds as words, at a time (a single longer text is held whole).
READ, SLICE = 1024, 1 << 20
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def long_enough(length, period):
    return (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)


def proposals(codes: np.ndarray, owners: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of progressions that are long enough; ``codes`` of words, ``owners`` their documents."""
    at = np.arange(len(codes))
    key = owners * (int(codes.max(initial=0)) + 1) + codes
    names, m = np.full(len(codes), -1, np.int64), 1
    while len(at) > 1:
        order = np.argsort(key, kind="stable")
        place, sorted_key = at[order], key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = place[1:] - place[:-1]
        near = np.flatnonzero(same & (gap <= 2 * m))
        by_place = near[np.argsort(place[near])]
        start, step = place[by_place], gap[by_place]
        if len(start):
            cuts = np.flatnonzero((start[1:] != start[:-1] + 1) | (step[1:] != step[:-1])) + 1
            first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(start)]]) - 1
            ends = start[last] + m + step[first]
            good = long_enough(ends - start[first], step[first])
            yield from zip(start[first][good].tolist(), ends[good].tolist(), step[first][good].tolist())
        if 4 * m >= longest:  # a longer factor lies within no run
            return
        again = np.zeros(len(place), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.concatenate([[0], np.cumsum(~same)])
        names[place[again]] = name[again]
        left = np.sort(place[again])
        left = left[left + m < len(codes)]
        pairs = left[names[left + m] >= 0]
        key = names[pairs] * (int(name[-1]) + 1) + names[pairs + m]
        names[place] = -1
        at, m = pairs, 2 * m


def extended(words: list, low: int, high: int, start: int, end: int, period: int) -> tuple[int, int, int]:
    """The longest stretch of that period around [start, end) within [low, high)."""
    while start > low and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < high and words[end] == words[end - period]:
        end += 1
    return start, end - start, period


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """[(start, length, period)] of every document, by start, then period."""
    sizes = np.array([len(w) for w in documents], np.int64)
    ends = np.cumsum(sizes)
    begins, words = ends - sizes, [w for doc in documents for w in doc]
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    owners = np.repeat(np.arange(len(documents)), sizes)
    found: list[set] = [set() for _ in documents]
    for start, end, period in proposals(codes, owners, int(sizes.max(initial=0))):
        doc = int(owners[start])
        low = int(begins[doc])
        at, length, q = extended(words, low, int(ends[doc]), start, end, period)
        found[doc].add((at - low, length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and the collapsed text."""
    added = T._parse_datatype_string(RESULT)
    names = added.fieldNames()
    keep = [c for c in docs.columns if c not in names or c == text]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    passed = [c for c in keep if c not in names]
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            words = [t.split() for t in as_bytes(batch.column(text))]
            runs = runs_of(words)
            kept = [collapse(w, r).decode() for w, r in zip(words, runs)]
            dicts = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            new = [pa.array([len(w) for w in words], pa.int64()), pa.array(dicts, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *new], [*passed, *names])
        give_back()

    return rows.mapInArrow(scan, T.StructType([*[rows.schema[c] for c in passed], *added.fields]))


def best(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of those by start, then period."""
    higher = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda top, r: F.when(higher(r, top), r).otherwise(top))


def written(runs: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
