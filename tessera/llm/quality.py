"""Quality by supervised subword embeddings (operator 4).

A document is the average of learned vectors of its words, of pairs of consecutive
words and of the character 3- and 4-grams of its words, all hashed into one table; a
softmax layer of two classes reads the average and its squares (vectors start at
random, so the average of a text that has few of them over and over is a long one).
Vectors and layer are trained in numpy by stochastic gradient descent on at most
``MAX_ROWS`` labelled rows of each class.  Rows that training has not seen set the cut
between the classes, which the score puts at ``CUT``.

Defined results: null, empty and word-less texts get the score of an average of
nothing (the layer's offset alone); repeated rows get equal scores; labels of documents
that don't exist are ignored, of several labels of a document the largest counts;
without labelled rows of both kinds every score is the share of label 1 (0 without
labels); other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.toxicity import labelled, split
from tessera.llm.words import CACHED_WORDS, as_bytes, slices

#: Labelled rows of each class used to fit, chosen by a hash of the id (a documented bound).
MAX_ROWS = 2000
#: Rows of the table (a power of two), width of a vector, character n-grams, passes, first rate.
BUCKETS, DIM, GRAMS, EPOCHS, RATE, SEED = 1 << 17, 8, (3, 4), 8, 0.5, 11
#: Deviation of the vectors at the start, how much faster the layer learns than they do, and the most a vector moves at once.
START, LAYER, MOST = 3.0, 30, 0.5
#: Share of the chosen rows that sets the cut, and the score at the cut.
HELD, CUT = 0.25, 0.7
#: Words longer than this are hashed each time they occur; vectors are summed so many at a time.
LONGEST, STRETCH = 64, 1 << 14
#: Zero vectors that each average takes in, so that a few odd words don't decide on a short text.
SMOOTH = 200
PAIR = np.uint64(0x9E3779B97F4A7C15)


def subwords(word: bytes) -> list[int]:
    """Hashes of a word and of its character n-grams (of bytes, with ends marked); their low bits are rows."""
    marked = b"<" + word + b">"
    found = [crc32(word, 1)]
    for n in GRAMS:
        found += [crc32(marked[i : i + n], n) for i in range(len(marked) - n + 1)]
    return found


def pairs(words: list[bytes]) -> np.ndarray:
    """Rows of the pairs of consecutive words."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    return ((h[:-1] * PAIR + h[1:]) * PAIR >> np.uint64(40)).astype(np.int64) & BUCKETS - 1


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a text, each once, and how often it has each."""
    words = text.split()
    rows: list[int] = []
    for word in words:
        rows += subwords(word)
    return np.unique(np.concatenate([np.array(rows, np.int64) & BUCKETS - 1, pairs(words)]), return_counts=True)


class Model:
    """The table of vectors and the softmax layer, with the cut and the spread of the logits around it."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, START, (BUCKETS, DIM)).astype(np.float32)
        self.layer, self.offset = rng.normal(0, 0.1, (2 * DIM, 2)), np.zeros(2)
        self.cut, self.spread = 0.0, 1.0

    def logit(self, total: np.ndarray, n: float) -> float:
        """Of a text whose ``n`` vectors have this sum."""
        hidden = total / (SMOOTH + n)
        z = np.concatenate([hidden, hidden * hidden]) @ self.layer + self.offset
        return float(z[1] - z[0])

    def step(self, rows: np.ndarray, counts: np.ndarray, label: int, weight: float, rate: float) -> None:
        share = counts / (SMOOTH + counts.sum())
        hidden = share @ self.table[rows]
        read = np.concatenate([hidden, hidden * hidden])
        z = read @ self.layer + self.offset
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        p *= weight
        back = self.layer @ p
        back = back[:DIM] + 2 * hidden * back[DIM:]
        self.layer -= LAYER * rate * np.outer(read, p)
        self.offset -= rate * p
        # of the frequent rows the whole step, of the others in proportion; the sum stays that of the average
        self.table[rows] -= np.clip(np.outer(share * (rate * min(len(rows), 50)), back), -MOST, MOST).astype(np.float32)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(docs))
    held = max(1, int(len(docs) * HELD))
    learn, rest = order[held:], order[:held]
    model = Model(rng)
    weight = [0.5 / (labels[learn] == y).mean() if (labels[learn] == y).any() else 0 for y in (0, 1)]
    for epoch in range(epochs):
        for i in rng.permutation(learn):
            model.step(*docs[i], labels[i], weight[labels[i]], RATE * (1 - epoch / epochs))
    logits = np.array([model.logit(counts @ model.table[rows], counts.sum()) for rows, counts in (docs[i] for i in rest)])
    model.cut, model.spread = split(logits, labels[rest]), float(np.std(logits)) or 1.0
    return model


def summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    parts = (table[rows[i : i + STRETCH]].sum(0, dtype=np.float64) for i in range(0, len(rows), STRETCH))
    return sum(parts, np.zeros(table.shape[1]))


class Added(dict):
    """word -> where ``sums`` has the sum of its vectors, and how many they are."""

    def __init__(self, model: Model) -> None:
        self.model, self.sums, self.used = model, np.zeros((CACHED_WORDS + STRETCH, DIM + 1)), 0

    def places(self, words: list[bytes]) -> np.ndarray:
        if self.used > CACHED_WORDS:
            self.clear()
            self.used = 0
        new = [x for x in dict.fromkeys(words) if x not in self]
        flat: list[int] = []
        starts, long = [], []
        for at, word in enumerate(new, self.used):
            self[word] = at
            starts.append(len(flat))
            if len(word) <= LONGEST:
                flat += subwords(word)
            else:
                flat.append(0)
                long.append((at, word))
        if new:
            end = self.used + len(new)
            np.add.reduceat(self.model.table[np.array(flat, np.int64) & BUCKETS - 1], starts, axis=0, dtype=np.float64, out=self.sums[self.used : end, :DIM])
            self.sums[self.used : end, DIM] = np.diff(starts, append=len(flat))
            self.used = end
        for at, word in long:
            rows = np.array(subwords(word), np.int64) & BUCKETS - 1
            self.sums[at, :DIM], self.sums[at, DIM] = summed(self.model.table, rows), len(rows)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for _, word in long:
            del self[word]
        return found

    def logit(self, words: list[bytes]) -> float:
        total = np.zeros(DIM + 1)
        for i in range(0, len(words), STRETCH):
            total += self.sums[self.places(words[i : i + STRETCH])].sum(0)
            total[:DIM] += summed(self.model.table, pairs(words[i : i + STRETCH + 1]))
        return self.model.logit(total[:DIM], total[DIM] + max(0, len(words) - 1))


def chosen(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` rows (text, y) of each class whose document may be learned from, by a hash of doc_id."""
    one = labelled(labels, label, learn)
    ids = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        ids = part if ids is None else ids.union(part)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")  # 2 * max_rows ids


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS):
    """Broadcast of (fitted or None, share of label 1); the chosen rows come to the driver as hashed features."""
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [features(x) for x in as_bytes(batch.column("text"))]
            columns = [pa.array([x.astype(np.int32).tobytes() for x in part], pa.binary()) for part in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("y")], ["doc_id", "rows", "counts", "y"])

    got = chosen(docs, labels, "quality", learn, max_rows).mapInArrow(hashed, "doc_id long, rows binary, counts binary, y int").toPandas().sort_values("doc_id")
    y = got["y"].to_numpy(np.int64)
    if len(y) < 8 or y.min() == y.max():
        return spark.sparkContext.broadcast((None, float(y.mean()) if len(y) else 0.0))
    found = [(np.frombuffer(r, np.int32), np.frombuffer(c, np.int32)) for r, c in zip(got["rows"], got["counts"])]
    return spark.sparkContext.broadcast((fit(found, y), float(y.mean())))


def score(docs: DataFrame, model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; ``CUT`` or more: good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, prior = model.value
        if fitted is not None:
            added, at_cut = Added(fitted), np.log(CUT / (1 - CUT))
        for batch in slices(batches, text):
            if fitted is None:
                values = np.full(batch.num_rows, prior)
            else:
                z = np.array([added.logit(x.split()) for x in as_bytes(batch.column(text))])
                values = 1 / (1 + np.exp(-np.clip(4 * (z - fitted.cut) / fitted.spread + at_cut, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    kept = docs.drop(score)
    return kept.mapInArrow(run, kept.withColumn(score, F.lit(None).cast("double")).schema)
