"""N-gram Jaccard join by R-trees over count vectors (operator 3).

A document's set holds its distinct 5-word shingles (A-Z lower-cased).  Shingles are
hashed into ``GROUPS`` groups, and the counts by group are the document's point (nodes
of trees sum them to ``COARSE``).  Two
sets share at most the sum of the smaller of their counts in each group, and a Jaccard
similarity of 0.8 needs an overlap of 4/9 of their sizes' sum.

1. Documents with equal sets form a class; its smallest doc_id speaks for it.
2. Classes that share a minimum of one of ``STARS`` hash orders are compared with the
   smallest of them: a first, linear pass that joins groups of near copies.
3. A forest of R-trees finds what is left.  Two sets that similar share a shingle among
   the first n - ceil(0.8 n) + 1 of each, in any common order, the rarest first; so every
   such shingle has a tree of the classes that hold it.  Only shingles that classes of
   different components hold get one, only such classes send their points, and of
   shingles that the same classes hold one is taken.  Trees of few classes share a task, up
   to ``MEMBERS`` classes or so.  A tree of more is dealt into blocks of similar sizes (sets
   that link differ by a quarter at most), and each pair of blocks within that reach is
   a task, where one block's tree is searched for the points of the other.  A tree is
   packed by size; its nodes hold the largest count of each group, the smallest size,
   and whether all below them are in one component already.  A search leaves out nodes
   whose summed minima can't reach the bound, and nodes of its own component.
4. Surviving pairs are verified on the whole texts; components join all verified links.

The order of shingles comes from how often they are in a random sample of documents.
Any order gives the same result; the sample only keeps frequent shingles out of the trees.

Defined results: null, empty and word-less texts have an empty set and are linked with
nothing; with fewer than five words the whole sequence is one shingle; rows that repeat
an id are one document; a null id is linked with nothing (its component_id is null);
other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm.graph import components
from tessera.llm.packed import pack, pack_plain, part_bits, part_cuts, unpack, unpack_plain
from tessera.llm.words import MIX_2, as_bytes, give_back, mix, shingles, slices
from tessera.plans.guards import bounded_broadcast
from tessera.session import materialize, small_batches

SIZE, STARS = 5, 4
#: Groups of a point, and groups that nodes of a tree tell apart (each the sum of several).
GROUPS, COARSE = 512, 64
#: Pairs whose points are compared at a time; points of a search; nodes or points they are compared with at a time.
COMPARED, ASKED, BLOCK = 4096, 64, 512
#: Share of the documents sampled to order shingles and the most that are; the fewest of them that make a shingle frequent; the most that are listed.
SHARE, SAMPLE, OFTEN, LISTED = 0.1, 100_000, 3, 400_000
#: Points of a leaf and children of a node; texts compared with one hub in a task; rows that say which texts to compare that are broadcast at most.
LEAF, FANOUT, PER_HUB, BROADCAST = 32, 16, 2000, 300_000
#: Classes whose points a task of the forest holds, about; sizes of sets of a block differ by this factor at most (above 1 / 0.8); pairs that a task sends at a time.
MEMBERS, REACH, SENT = 20_000, 1.26, 100_000
#: Documents or points that a task reads at a time; prefix shingles that it sends at a time, and those of a part of the hash space, about.
READ, DEALT, PART = 1024, 1 << 19, 500_000
SKETCH = "doc_id long, n long, key binary, stars array<long>, counts binary, prefix array<long>"


def frequent(docs: DataFrame, text: str = "text"):
    """Broadcast of (hashes, how often) of the shingles that are frequent in a sample, by hash (at most ``LISTED``)."""
    spark, rows = docs.sparkSession, docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingles(x, SIZE) for x in as_bytes(batch.column(text))]
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["h", "seen"])
        give_back()

    sample = docs.select(text).sample(min(SHARE, SAMPLE / max(1, rows)), seed=3)
    counted = sample.mapInArrow(run, "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= OFTEN)
    with small_batches(spark, READ):
        listed = counted.orderBy(F.desc("seen"), "h").limit(LISTED).toPandas()
    hashes, seen = listed["h"].to_numpy(np.int64).view(np.uint64), listed["seen"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return spark.sparkContext.broadcast((hashes[order], seen[order]))


def prefix(held: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of a sorted set, in the order (frequency, hash)."""
    n = len(held)
    length = n - (4 * n + 4) // 5 + 1
    hashes, seen = listed
    if not len(hashes):
        return held[:length]
    at = np.minimum(np.searchsorted(hashes, held), len(hashes) - 1)
    often = hashes[at] == held
    rare = held[~often]
    if len(rare) < length:
        rare = np.concatenate([rare, held[often][np.lexsort((held[often], seen[at[often]]))]])
    return rare[:length]


def sketch(docs: DataFrame, listed, text: str = "text") -> DataFrame:
    """Set size, digest, minima, point and prefix of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [mix(np.array([i + 1], np.uint64)) for i in range(STARS)]
        for batch in slices(batches, text):
            rows: list[list] = [[], [], [], [], []]
            for x in as_bytes(batch.column(text)):
                held = shingles(x, SIZE)
                rows[0].append(len(held))
                rows[1].append(xxh3_128_digest(held.tobytes()))
                rows[2].append([int(mix(held ^ s).min().view(np.int64)) for s in salts] if len(held) else [])
                rows[3].append(pack_plain(point(held)))
                rows[4].append(prefix(held, listed.value).view(np.int64) if len(held) else [])
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, rows, kinds)], ["doc_id", "n", "key", "stars", "counts", "prefix"])
        give_back()

    return docs.select("doc_id", text).mapInArrow(run, SKETCH)


def point(held: np.ndarray) -> np.ndarray:
    """How many shingles each group has."""
    return np.bincount((held * MIX_2 % np.uint64((1 << 61) - 1) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def coarse(points: np.ndarray) -> np.ndarray:
    return points.reshape(len(points), COARSE, -1).sum(2, dtype=np.int32)


def near_pairs(points: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``near`` for the pairs (i, j) of places."""
    out = np.empty(len(i), bool)
    for begin in range(0, len(i), COMPARED):
        a, b = i[begin : begin + COMPARED], j[begin : begin + COMPARED]
        out[begin : begin + COMPARED] = near(points[a], points[b], sizes[a], sizes[b])
    return out


def near(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """Whether the summed minima of points allow a Jaccard similarity of 0.8."""
    return 9 * np.minimum(first, second).sum(-1, dtype=np.int64) >= 4 * (n_first + n_second)


def near_table(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, tops: np.ndarray, least: np.ndarray, only: np.ndarray) -> np.ndarray:
    """``near`` and another label, of each of some points (rows) with each node or point (columns)."""
    out = np.empty((len(points), len(tops)), bool)
    for begin in range(0, len(tops), BLOCK):
        part = slice(begin, begin + BLOCK)
        out[:, part] = near(points[:, None], tops[None, part], sizes[:, None], least[None, part]) & (labels[:, None] != only[None, part])
    return out


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class b and the smallest class a that shares one of its minima, if their points allow a link."""
    minima = classes.select("rep", F.posexplode("stars").alias("i", "value"))
    hubs = minima.groupBy("i", "value").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last").select("i", "value", "a")
    pairs = minima.join(hubs, ["i", "value"]).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            for begin in range(0, batch.num_rows, COMPARED):
                part = batch.slice(begin, COMPARED)
                a, b = (np.array([unpack_plain(x, np.uint32) for x in part.column(f"counts_{s}").to_pylist()]) for s in "ab")
                fit = near(a, b, n_a[begin : begin + COMPARED], n_b[begin : begin + COMPARED])
                yield part.select(["a", "b"]).filter(pa.array(fit))
        give_back()

    return pairs.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more, by their whole texts.

    Each b travels to its a.  A hub with many partners is copied to several tasks, each
    with ``PER_HUB`` partners or so.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("int").alias("salts"))
    spread = pairs.join(hubs, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("partner"))
    copies = hubs.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("partner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in slices(batches, text):
            out: tuple[list, list] = ([], [])
            columns = (batch.column(c).to_pylist() for c in ("hub", "salt", "partner", "doc_id"))
            for hub, salt, partner, doc, x in zip(*columns, as_bytes(batch.column(text))):
                own = shingles(x, SIZE)
                if not partner:
                    if at != (hub, salt):
                        at, held = (hub, salt), []
                    held.append(own)
                elif at == (hub, salt):
                    for other in held:
                        common = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
                        if 100 * common >= 80 * (len(other) + len(own) - common):
                            out[0].append(hub), out[1].append(doc)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
        give_back()

    roles = spread.union(copies)  # a few numbers a pair; beyond the bound the texts are shuffled to them instead
    texts = docs.select("doc_id", text).join(bounded_broadcast(roles, BROADCAST), "doc_id")
    return texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "partner").mapInArrow(run, "a long, b long")


class Tree:
    """A packed R-tree over points; ``search`` finds what may link with some of them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        self.order = np.lexsort((points.argmax(1), sizes))
        self.fine, self.sizes, self.labels = points[self.order], sizes[self.order], labels[self.order]
        self.points = coarse(self.fine)
        #: Of each level from the leaves up: largest counts, least size, and the only label (-1: several).
        self.levels = []
        tops, least, low, high, width = self.points, self.sizes, self.labels, self.labels, LEAF
        while len(tops) > 1 or not self.levels:
            begins = np.arange(0, len(tops), width)
            tops, least = np.maximum.reduceat(tops, begins), np.minimum.reduceat(least, begins)
            low, high = np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)
            self.levels.append((tops, least, np.where(low == high, low, -1)))
            width = FANOUT

    def met(self, fine: np.ndarray, sizes: np.ndarray, labels: np.ndarray, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Which of some points may link with which of the tree's (places in its order, beyond ``after``)."""
        asked = coarse(fine), sizes, labels
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in reversed(range(len(self.levels))):
            open_ = near_table(*asked, *(x[nodes] for x in self.levels[depth])).any(0)
            width, count = (FANOUT, len(self.levels[depth - 1][0])) if depth else (LEAF, len(self.points))
            nodes = (nodes[open_][:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < count]
        nodes = nodes[nodes > after]
        i, j = np.nonzero(near_table(*asked, self.points[nodes], self.sizes[nodes], self.labels[nodes]))
        fit = np.empty(len(i), bool)
        for begin in range(0, len(i), COMPARED):
            part = slice(begin, begin + COMPARED)
            own, other = i[part], nodes[j[part]]
            fit[part] = near(fine[own], self.fine[other], sizes[own], self.sizes[other])
        return i[fit], nodes[j[fit]]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points of different labels whose summed minima allow a link, as places in what the tree was made from."""
        for begin in range(0, len(self.points), ASKED):
            query = slice(begin, begin + ASKED)
            i, j = self.met(self.fine[query], self.sizes[query], self.labels[query], begin)
            i, j = begin + i[j > begin + i], j[j > begin + i]  # each pair once
            yield self.order[i], self.order[j]

    def search(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for other points: places in those, and in what the tree was made from."""
        order = np.argsort(sizes, kind="stable")
        for begin in range(0, len(order), ASKED):
            query = order[begin : begin + ASKED]
            i, j = self.met(points[query], sizes[query], labels[query])
            yield query[i], self.order[j]


def shared_shingles(classes: DataFrame, bits: int) -> DataFrame:
    """h of the prefix shingles that classes of different labels hold.

    A task sends the least and greatest label of each of its shingles, packed by part of
    the hash space, so a shingle of very many classes is one entry of ``DEALT`` or so.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            hashes, labels = (np.concatenate(x) for x in zip(*held))
            held.clear()
            hashes, low, high = spans(hashes, labels, labels)
            rows: list[list] = [[], [], [], []]
            for part, begin, end in part_cuts(hashes, bits, 64 - bits):
                least = low[begin:end]
                for column, value in zip(rows, (part, pack(hashes[begin:end]), pack_plain(least), pack_plain(high[begin:end] - least))):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["part", "hashes", "low", "more"])

        for batch in batches:
            lists = batch.column("prefix")
            labels = np.repeat(batch.column("label").to_numpy(), lists.value_lengths().to_numpy())
            if len(labels):
                held.append((lists.flatten().to_numpy().view(np.uint64), labels))
            if sum(len(x) for x, _ in held) >= DEALT:
                yield sent()
        if held:
            yield sent()
        give_back()

    def mixed(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([unpack(x, np.uint64) for x in rows.column("hashes").to_pylist()])
        low, high = (np.concatenate([unpack_plain(x, np.int64) for x in rows.column(c).to_pylist()]) for c in ("low", "more"))
        high += low
        hashes, low, high = spans(hashes, low, high)
        found = pa.array(hashes[low != high].view(np.int64))
        del hashes, low, high
        give_back()
        return pa.table({"h": found})

    return classes.select("label", "prefix").mapInArrow(deal, "part int, hashes binary, low binary, more binary").groupBy("part").applyInArrow(mixed, "h long")


def spans(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the least of ``low`` and the greatest of ``high`` of each."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begins = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    return hashes[begins], np.minimum.reduceat(low[order], begins), np.maximum.reduceat(high[order], begins)


def forest(classes: DataFrame, bits: int) -> DataFrame:
    """task, side, h, rep, n, label: the classes of each tree, by the task that builds it; side 1 is searched for side 0 where there are both."""
    shared = materialize(shared_shingles(classes, bits), "jaccard-shared", READ)
    held = materialize(classes.select("rep", F.explode("prefix").alias("h")).join(shared, "h"), "jaccard-held")
    held = held.join(classes.select("rep", "n", "label"), "rep")
    # shingles that the same classes hold need one tree
    same = held.groupBy("h").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("members"))
    trees = materialize(same.groupBy("x", "y", "members").agg(F.min("h").alias("h")).select("h", "members"), "jaccard-trees")
    few, many = trees.where(F.col("members") <= MEMBERS), trees.where(F.col("members") > MEMBERS)
    tasks = -(-few.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0] // MEMBERS)
    together = held.join(few, "h").select(F.pmod(F.xxhash64("h"), F.lit(max(1, tasks))).cast("string").alias("task"), F.lit(0).alias("side"), "h", "rep", "n", "label")
    return together.union(blocks(held.join(many, "h")))


def blocks(held: DataFrame) -> DataFrame:
    """The rows of ``forest`` for trees of many classes: a task for each two blocks whose sizes allow a link."""
    sized = held.withColumn("size", F.floor(F.log("n") / F.log(F.lit(REACH))).cast("int"))
    counts = materialize(sized.groupBy("h", "size").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")), "jaccard-blocks")
    for name, step in (("salts", 0), ("above", 1), ("below", -1)):
        of = bounded_broadcast(counts.select("h", (F.col("size") - step).alias("size"), F.col("salts").alias(name)), BROADCAST)
        sized = sized.join(of, ["h", "size"], "left")
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    task = lambda size, first, other, second: F.concat_ws("/", "h", size, first, other, second)
    role = lambda name, side: F.struct(name.alias("task"), F.lit(side).alias("side"))
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array())
    size, salt = F.col("size"), F.col("salt")
    own = each("salts", lambda t: F.when(t >= salt, role(task(size, salt, size, t), 0)).otherwise(role(task(size, t, size, salt), 1)))
    up = each("above", lambda t: role(task(size, salt, size + 1, t), 0))
    down = each("below", lambda t: role(task(size - 1, t, size, salt), 1))
    dealt = sized.select("h", "rep", "n", "label", F.explode(F.concat(own, up, down)).alias("role"))
    return dealt.select("role.task", "role.side", "h", "rep", "n", "label")


def forest_pairs(classes: DataFrame, bits: int) -> DataFrame:
    """(a, b) of classes of different labels that share a shingle of both prefixes, if their points allow a link."""

    def found(sides: np.ndarray, sizes: np.ndarray, labels: np.ndarray, points: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(hashes, kind="stable")
        hashes, own = hashes[order], own[order]
        begins = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        ends = np.append(begins[1:], len(hashes))
        twos = begins[(ends - begins == 2)]
        if len(twos):
            pair = np.unique(np.sort(np.stack([own[twos], own[twos + 1]], axis=1), axis=1), axis=0)
            pair = pair[labels[pair[:, 0]] != labels[pair[:, 1]]]
            fit = near_pairs(points, sizes, pair[:, 0], pair[:, 1])
            yield pair[fit, 0], pair[fit, 1]
        for begin, end in zip(begins.tolist(), ends.tolist()):
            if end - begin > 2:
                members = own[begin:end]
                first, second = members[sides[members] == 0], members[sides[members] == 1]
                if len(second):
                    tree = Tree(points[second], sizes[second], labels[second])
                    yield from ((first[i], second[j]) for i, j in tree.search(points[first], sizes[first], labels[first]))
                else:
                    yield from ((first[i], first[j]) for i, j in Tree(points[first], sizes[first], labels[first]).pairs())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], [], []]
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            lists = batch.column("hashes")
            # no count exceeds its set's size
            points = np.empty((batch.num_rows, GROUPS), np.uint16 if sizes.max(initial=0) < 1 << 16 else np.uint32)
            for i, counts in enumerate(batch.column("counts")):
                points[i] = unpack_plain(counts.as_py(), np.uint32)
            own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()) + sum(map(len, columns[1]))
            new = batch.column("side").to_numpy(), batch.column("rep").to_numpy(), sizes, batch.column("label").to_numpy(), points, np.stack([lists.flatten().to_numpy(), own])
            for column, values in zip(columns, new):
                column.append(values)
        sides, reps, sizes, labels, points = (np.concatenate(x) for x in columns[:5])
        hashes, own = np.concatenate(columns[5], axis=1)
        columns.clear()
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            both = np.unique(np.sort(np.concatenate(held, axis=1), axis=0), axis=1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for i, j in found(sides, sizes, labels, points, hashes.view(np.uint64), own):
            held.append(np.stack([reps[i], reps[j]]))
            if sum(x.shape[1] for x in held) >= SENT:
                yield sent()
        if held:
            yield sent()
        del sides, reps, sizes, labels, points, hashes, own
        give_back()

    members = forest(classes, bits).groupBy("task", "side", "rep").agg(F.collect_list("h").alias("hashes"), F.first("n").alias("n"), F.first("label").alias("label"))
    with_points = members.join(classes.select("rep", "counts"), "rep")
    return with_points.select("task", "side", "rep", "n", "label", "hashes", "counts").groupBy("task").applyInArrow(search, "a long, b long").distinct()


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sketches = materialize(sketch(docs, frequent(docs, text), text), "jaccard-sketches", READ)
    filled = sketches.where("n > 0 and doc_id is not null")
    smallest = F.min(F.struct("doc_id", "n", "stars", "counts", "prefix")).alias("r")
    classes = materialize(filled.groupBy("key").agg(smallest).select("key", F.col("r.doc_id").alias("rep"), "r.n", "r.stars", "r.counts", "r.prefix"), "jaccard-classes")
    first = materialize(components(materialize(verify(star_pairs(classes), docs, text), "jaccard-stars", READ)), "jaccard-first")
    labelled = classes.join(first, classes.rep == first.node, "left").withColumn("label", F.coalesce("component", "rep"))
    labelled = materialize(labelled.select("key", "rep", "n", "label", "counts", "prefix"), "jaccard-labelled")
    bits = part_bits(classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0], PART, 4)
    pairs = materialize(forest_pairs(labelled, bits), "jaccard-pairs", READ)
    links = materialize(verify(pairs, docs, text), "jaccard-links", READ)
    of = labelled.select("key", F.col("rep"), "label")
    for side in ("a", "b"):  # links between the components of the first pass
        links = links.join(first.select(F.col("node").alias(side), F.col("component").alias(f"to_{side}")), side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
    second = components(links)
    known = of.join(second, of.label == second.node, "left").select("key", F.coalesce("component", "label").alias("component_id"))
    out = sketches.select("doc_id", "n", "key").join(known, "key", "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
