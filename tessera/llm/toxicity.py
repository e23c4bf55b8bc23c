"""Toxicity by a convolutional text classifier (operator 2).

Words are hashed into two small embedding tables (their halves are put side by side,
so that two words seldom share both).  Filters one, two and three words wide run over
the whole text, each keeps its maximum, and a logistic layer reads the maxima.  All of
it is trained in numpy on all labelled rows.  They are dealt into shards by a hash of
the id; in a pass each task learns from a shard beginning with the same model, and every
number becomes the mean over the shards that moved it (with one shard this is plain
stochastic gradient descent).  The threshold of each language, told from the text by
common function words, is set on the logits that all labelled rows have from models of
the other ``FOLDS`` - 1 parts; the score moves it to 0.5.  The driver holds the models,
and of each labelled row a logit, a label and a language (6 bytes).

Defined results: null, empty and word-less texts are scored as one padding word;
repeated rows get equal scores; labels of documents that don't exist are ignored, of
several labels of a document the largest counts; without labelled rows of both kinds
every score is the share of toxic labels (0 without labels); other columns, whatever
their names, pass through.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.words import CACHED_WORDS, as_bytes, give_back, slices
from tessera.session import materialize, small_batches

#: Labelled rows, and bytes of their texts, of a shard or so (all are used); ids that are broadcast (more are joined by a shuffle); parts of a table that are added up apart; rows that a task reads at a time.
SHARD_ROWS, SHARD_BYTES, IDS, PARTS, READ = 5000, 16 << 20, 1_000_000, 16, 1024
#: Rows of each embedding table (a power of two), its width, filter widths (words) and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 4, (1, 2, 3), 6
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.02, 7
#: Parts of the labelled rows, each judged for the thresholds by a model that hasn't seen it, and the fewest rows of each class for a language of its own.
FOLDS, FEWEST = 4, 15
#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and is that with was for are from this",
    "de": "und der die das ist nicht ein zu mit sich auf den",
    "fr": "les et une dans est pour pas sur au qui ne",
    "es": "que el los las y por con para una su lo",
}
LANGUAGES = [*FUNCTION_WORDS]
#: Lower-cases A-Z and turns ASCII punctuation and control characters into spaces.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


class Codes(dict):
    """word -> hash whose low three bits are the language it speaks for (0: none)."""

    def __init__(self) -> None:
        self.votes = {w.encode(): i + 1 for i, x in enumerate(LANGUAGES) for w in FUNCTION_WORDS[x].split()}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = code = xxh3_64_intdigest(word) & ~7 | self.votes.get(word, 0)
        return code


CODES = Codes()


def codes(text: bytes) -> np.ndarray:
    words = text.translate(PLAIN).split()
    return np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))


def language(found: np.ndarray) -> int:
    """Index into LANGUAGES (the first at ties and without any vote)."""
    votes = np.bincount((found & np.uint64(7)).astype(np.int64), minlength=len(LANGUAGES) + 1)[1:]
    return int(votes.argmax())


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two tables for all texts, with padding (row 0) after each, and where each begins."""
    gap = max(WIDTHS)
    sizes = np.array([len(x) + gap for x in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = np.zeros(int(sizes.sum()) + gap, np.uint64)
    for start, x in zip(starts.tolist(), texts):
        hashes[start : start + len(x)] = x | np.uint64(1 << 40)
    mask = np.uint64(BUCKETS - 1)
    first, second = (hashes >> np.uint64(3)) & mask, (hashes >> np.uint64(42)) & mask
    real = hashes != 0
    return np.where(real, np.maximum(first, 1), 0).astype(np.int64), np.where(real, np.maximum(second, 1), 0).astype(np.int64), starts


class Model:
    """Two tables, a kernel for each width, and the output layer."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.tables = [rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32) for _ in range(2)]
        self.kernels = [rng.normal(0, 0.1, (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.offset = np.float32(-1)
        for table in self.tables:
            table[0] = 0

    def maps(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedded words, and what the filters of each width give at each word (filters x words)."""
        x = np.concatenate([self.tables[0][first], self.tables[1][second]], axis=1)
        n, flat = len(x) - max(WIDTHS), np.concatenate([k for kernel in self.kernels for k in kernel], axis=1)
        y, out, at = flat.T @ x.T, [], 0
        for kernel, bias in zip(self.kernels, self.biases):
            z = y[at : at + FILTERS, :n] + bias[:, None]
            for j in range(1, len(kernel)):
                z += y[at + j * FILTERS : at + (j + 1) * FILTERS, j : n + j]
            at += len(kernel) * FILTERS
            out.append(z)
        return x, out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """A window counts for the text in which it begins; those that begin in padding don't count, but for the one of a text without words."""
        first, second, starts = padded(texts)
        _, maps = self.maps(first, second)
        ends = starts + np.array([max(1, len(x)) for x in texts])
        spans = np.stack([starts, ends], axis=1).ravel()  # every other one is padding
        most = np.concatenate([np.maximum.reduceat(z, spans, axis=1)[:, ::2] for z in maps])
        return np.maximum(most, 0).T @ self.out + self.offset

    def step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float, moments: dict) -> None:
        first, second, starts = padded(texts)
        x, maps = self.maps(first, second)
        ends = starts + np.array([max(1, len(t)) for t in texts])
        at = [np.stack([s + z[:, s:e].argmax(1) for s, e in zip(starts, ends)]) for z in maps]  # documents x filters
        most = np.concatenate([np.take_along_axis(z.T, p, 0) for z, p in zip(maps, at)], axis=1)
        active = np.maximum(most, 0)
        error = (1 / (1 + np.exp(-np.clip(active @ self.out + self.offset, -30, 30))) - labels) / len(texts)
        down = error[:, None] * self.out * (most > 0)
        grown: dict[int, list] = {0: [], 1: []}
        moves = [("out", active.T @ error), ("offset", error.sum())]
        for i, w in enumerate(WIDTHS):
            d, p = down[:, i * FILTERS : (i + 1) * FILTERS], at[i]
            moves.append((("biases", i), d.sum(0)))
            kernel = np.zeros_like(self.kernels[i])
            for j in range(w):
                kernel[j] = np.einsum("nfd,nf->df", x[p + j], d)
                back = d[:, :, None] * self.kernels[i][j].T[None]
                for half, rows in enumerate((first, second)):
                    grown[half].append((rows[p + j].ravel(), back[:, :, half * DIM : (half + 1) * DIM].reshape(-1, DIM)))
            moves.append((("kernels", i), kernel))
        for name, gradient in moves:
            old = moments.get(name, 0)
            moments[name] = seen = 0.9 * old + 0.1 * np.square(gradient)
            delta = rate * gradient / (np.sqrt(seen) + 1e-6)
            if isinstance(name, tuple):
                getattr(self, name[0])[name[1]] -= delta.astype(np.float32)
            else:
                setattr(self, name, (getattr(self, name) - delta).astype(np.float32))
        for half, parts in grown.items():
            rows, gradient = np.concatenate([r for r, _ in parts]), np.concatenate([g for _, g in parts])
            real = rows > 0
            np.add.at(self.tables[half], rows[real], (-rate * gradient[real]).astype(np.float32))


def odds(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How much more often toxic documents have a word, shrunk for rare words; ``seen`` and ``rows`` count the documents of each class."""
    seen, share = seen.astype(np.float32), np.maximum(rows, 1).astype(np.float32)[:, None]
    ratio, total = np.log((seen[1] + 0.5) / share[1]) - np.log((seen[0] + 0.5) / share[0]), seen.sum(0)
    return np.where(total > 0, ratio * total / (total + 20), 0) / 4


def fresh(seen: np.ndarray, rows: np.ndarray) -> Model:
    """The model before the first pass; its tables begin with the odds of the words, ``seen`` (table x class x row)."""
    model = Model(np.random.default_rng(SEED))
    for table, found in zip(model.tables, seen):
        table[:, 0] = odds(found, rows)
        table[0] = 0
    for kernel in model.kernels:
        kernel[0, [0, DIM]] = np.abs(kernel[0, [0, DIM]]) + 0.5
        kernel[1:] *= 0.3
    return model


def thresholds(logits: np.ndarray, labels: np.ndarray, spoken: np.ndarray) -> dict[int, float]:
    """The threshold (a logit) of each language; -1 has that of all languages."""
    found = {-1: split(logits, labels)}
    for lang in range(len(LANGUAGES)):
        own = spoken == lang
        if min((labels[own] == y).sum() for y in (0, 1)) >= FEWEST:
            found[lang] = split(logits[own], labels[own])
    return found


def split(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the highest mean of the two classes' hit rates; of equal ones the middle."""
    if labels.min() == labels.max():
        return 0.0
    cuts = np.sort(logits)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    toxic, clean = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    rate = (1 - np.searchsorted(toxic, cuts) / len(toxic)) + np.searchsorted(clean, cuts) / len(clean)
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y) of all documents that may be learned from."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).alias("y"))


SHARD = ["shard", "sizes", "distinct", "words", "labels"]


class Shard:
    """Labelled rows that a task learns from at a time: word hashes and label of each, in order of doc_id."""

    schema = "shard int, sizes binary, distinct binary, words binary, labels binary"

    def __init__(self, number: int, sizes: bytes, distinct: bytes, words: bytes, labels: bytes) -> None:
        self.number, self.labels = number, np.frombuffer(labels, np.int8).astype(np.int64)
        hashes = np.frombuffer(distinct, np.uint64)
        hashes = hashes[np.frombuffer(words, np.min_scalar_type(len(hashes)))]
        self.texts = np.split(hashes, np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
        self.fold = np.random.default_rng([SEED, number]).permutation(len(self.labels)) % FOLDS

    @staticmethod
    def packed(table: pa.Table) -> pa.Table:
        """The row of a shard from its documents (shard, doc_id, words, y); words are numbered, as the JVM holds such a row whole."""
        table = table.sort_by("doc_id")
        words = table.column("words").to_pylist()
        sizes, labels = np.array([len(x) // 8 for x in words], np.int64), table.column("y").to_numpy().astype(np.int8)
        distinct, words = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
        blobs = (sizes, distinct, words.astype(np.min_scalar_type(len(distinct))), labels)
        return pa.table([table.column("shard")[:1].combine_chunks(), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], SHARD)

    def seen(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each fold both tables: rows, and in how many documents of each class (rows x class) they are; row 0 counts all documents."""
        for fold in range(FOLDS):
            for half, shift in ((0, 3), (1, 42)):
                seen = np.zeros((2, BUCKETS), np.float32)
                for i in np.flatnonzero(self.fold == fold):
                    rows = (self.texts[i] | np.uint64(1 << 40)) >> np.uint64(shift) & np.uint64(BUCKETS - 1)
                    seen[self.labels[i], np.unique(np.append(0, np.maximum(rows, 1).astype(np.int64)))] += 1
                rows = np.flatnonzero(seen.any(0))
                yield 2 * fold + half, rows, seen[:, rows].T

    def learned(self, states: list[tuple[Model, dict]], epoch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each model what a pass over the shard makes of it, but for the fold that it must not see: rows of both tables, and all other numbers as a third one."""
        for which, (model, moments) in enumerate(states):
            shuffled = np.random.default_rng([SEED, self.number, epoch]).permutation(np.flatnonzero(self.fold != which))
            if not len(shuffled):
                continue
            now, moments = copy.deepcopy(model), dict(moments)
            for i in range(0, len(shuffled), BATCH):
                rows = shuffled[i : i + BATCH]
                now.step([self.texts[k] for k in rows], self.labels[rows].astype(np.float32), RATE / (1 + epoch), moments)
            for half in (0, 1):
                rows = np.flatnonzero((now.tables[half] != model.tables[half]).any(1))
                yield 3 * which + half, rows, now.tables[half][rows]
            rest = flat(now, moments)
            yield 3 * which + 2, np.arange(len(rest)), rest[:, None]

    def judged(self, models: list[Model]) -> tuple[bytes, bytes, bytes]:
        """Logits, labels and languages of all rows, each by the model that has not seen its fold."""
        logits = np.zeros(len(self.texts), np.float32)
        for fold in range(FOLDS):
            own = np.flatnonzero(self.fold == fold)
            for i in range(0, len(own), 64):
                logits[own[i : i + 64]] = models[fold].logits([self.texts[k] for k in own[i : i + 64]])
        spoken = np.array([language(x) for x in self.texts], np.int8)
        return logits.tobytes(), self.labels.astype(np.int8).tobytes(), spoken.tobytes()


#: What a model has besides its tables.
OTHERS = ["out", "offset", *((name, i) for i in range(len(WIDTHS)) for name in ("biases", "kernels"))]


def flat(model: Model, moments: dict) -> np.ndarray:
    values = [getattr(model, x) if isinstance(x, str) else getattr(model, x[0])[x[1]] for x in OTHERS]
    return np.concatenate([np.ravel(x) for x in values + [moments[x] for x in OTHERS]])


def restore(model: Model, moments: dict, values: np.ndarray) -> None:
    """The inverse of ``flat``."""
    at = 0
    for into in (None, moments):
        for x in OTHERS:
            old = getattr(model, x) if isinstance(x, str) else getattr(model, x[0])[x[1]]
            new = values[at : at + np.size(old)].reshape(np.shape(old))[()]
            at += np.size(old)
            if into is not None:
                into[x] = new
            elif isinstance(x, str):
                setattr(model, x, new)
            else:
                getattr(model, x[0])[x[1]] = new


def shards(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """All labelled documents in shards (``Shard.schema``), dealt by a hash of doc_id."""
    ids = materialize(labelled(labels, "toxic", learn), "toxicity-labels")
    n = ids.count()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= IDS else ids, "doc_id")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [codes(x).tobytes() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("y")], ["doc_id", "words", "y"])
        give_back()

    rows = texts.mapInArrow(hashed, "doc_id long, words binary, y int").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int"))
    one = rows.repartition(many, "shard").groupBy("shard", "doc_id").agg(F.max("words").alias("words"), F.max("y").alias("y"))
    return materialize(one.groupBy("shard").applyInArrow(Shard.packed, Shard.schema), "toxicity-shards", READ)


def added(found: DataFrame, mean: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, rows and the sum (or mean) over the shards that give one, from ``found`` (place, part, shard, rows, cells)."""

    kind = np.float32 if mean else np.float64

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        rows = [np.frombuffer(x, np.int32) for x in table.column("rows").to_pylist()]
        cells = [np.frombuffer(x, np.float32).reshape(len(r), -1) for x, r in zip(table.column("cells").to_pylist(), rows)]
        distinct = np.unique(np.concatenate(rows))
        total, n = np.zeros((len(distinct), cells[0].shape[1])), np.zeros((len(distinct), 1))
        for r, x in zip(rows, cells):  # in order of the shards, so that sums of floats don't vary
            at = np.searchsorted(distinct, r)
            total[at] += x
            n[at] += 1
        out = [table.column("place")[0].as_py(), distinct.tobytes(), (total / n if mean else total).astype(kind).tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary()))], ["place", "rows", "cells"])

    with small_batches(found.sparkSession, 1):
        got = found.groupBy("place", "part").applyInArrow(run, "place int, rows binary, cells binary").collect()
    for r in got:
        rows = np.frombuffer(r.rows, np.int32)
        yield r.place, rows, np.frombuffer(r.cells, kind).reshape(len(rows), -1)


def of_shards(data: DataFrame, fn: Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """What ``fn`` gives for each shard (a place, rows there and their cells), the rows dealt into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            for place, rows, cells in fn(x):
                part = rows // (BUCKETS // PARTS)
                out = [(place, int(p), x.number, rows[part == p].astype(np.int32).tobytes(), cells[part == p].astype(np.float32).tobytes()) for p in np.unique(part)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 3 + [pa.binary()] * 2)], ["place", "part", "shard", "rows", "cells"])
        give_back()

    return data.mapInArrow(run, "place int, part int, shard int, rows binary, cells binary")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in SHARD)):
            yield Shard(*(x.as_py() for x in row))


def train(docs: DataFrame, labels: DataFrame, learn: Column):
    """Broadcast of (model, thresholds, prior), learned from all labelled rows; the rows stay on the executors."""
    spark = docs.sparkSession
    data = shards(docs, labels, learn)
    seen = np.zeros((FOLDS, 2, 2, BUCKETS))
    for place, rows, cells in added(of_shards(data, Shard.seen), False):
        seen[place // 2, place % 2][:, rows] = cells.T
    in_fold = seen[:, 0, :, 0].copy()
    clean, toxic = in_fold.sum(0)
    if clean + toxic < 8 or not clean or not toxic:
        return spark.sparkContext.broadcast((None, {}, float(toxic / (clean + toxic)) if clean + toxic else 0.0))
    left_out = [0 * seen[0], *seen]  # the last model sees all rows
    states = [(fresh(seen.sum(0) - x, in_fold.sum(0) - x[0, :, 0]), {}) for x in left_out[1:] + left_out[:1]]
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast(states)
        for place, rows, cells in added(of_shards(data, lambda x, state=state, epoch=epoch: x.learned(state.value, epoch)), True):
            model, moments = states[place // 3]
            if place % 3 == 2:
                restore(model, moments, cells[:, 0])
            else:
                model.tables[place % 3][rows] = cells
        state.unpersist()
    state = spark.sparkContext.broadcast([model for model, _ in states[:FOLDS]])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            columns = [pa.array([x.number], pa.int32()), *(pa.array([y], pa.binary()) for y in x.judged(state.value))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "logits", "labels", "spoken"])
        give_back()

    with small_batches(spark, 1):
        got = data.mapInArrow(judged, "shard int, logits binary, labels binary, spoken binary").toPandas().sort_values("shard")
    state.unpersist()
    columns = [np.frombuffer(b"".join(got[c]), t) for c, t in (("logits", np.float32), ("labels", np.int8), ("spoken", np.int8))]
    return spark.sparkContext.broadcast((states[FOLDS][0], thresholds(*columns), float(toxic / (clean + toxic))))


def score(docs: DataFrame, model, text: str = "text", score: str = "score", lang: str = "text_lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, toxic from 0.5 on) and ``lang``, the language told from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, thresholds, prior = model.value
        for batch in slices(batches, text, 1 << 20):
            texts = [codes(x) for x in as_bytes(batch.column(text))]
            spoken = [language(x) for x in texts]
            if net is None:
                values = np.full(len(texts), prior)
            else:
                cut = np.array([thresholds.get(x, thresholds[-1]) for x in spoken])
                values = 1 / (1 + np.exp(-np.clip(net.logits(texts).astype(np.float64) - cut, -30, 30)))
            new = [pa.array(values, pa.float64()), pa.array([LANGUAGES[x] for x in spoken], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, score, lang])
        give_back()

    kept = docs.drop(score, lang)
    schema = kept.withColumns({score: F.lit(None).cast("double")}).withColumn(lang, F.lit(None).cast("string")).schema
    return kept.mapInArrow(run, schema)
