"""Density clustering of result vectors (DBSCAN semantics) and redundancy collapse.

Shapes: ``points(key, pid, pos, vec)`` where ``key`` groups independent
result sets (e.g. one query), ``pos`` is the result position (order of
first appearance) and ``vec`` an ``array<float>``.

* epsilon-neighbours (J11): exact copies of a vector become one weighted point.  Points
  go to the cell of the nearest of ``PIVOTS`` pivots; a cell of many points is dealt into
  blocks of ``CELL`` or so.  Each block alone, with ``SHARED`` points that all have, finds
  most core points and joins them.  Only what that leaves open meets others: points
  without enough neighbours so far, then core points outside the largest component, then
  the others that have a neighbour.  These are put in blocks; points are guests of those
  blocks where the distances to the pivots allow a neighbour (``d <= d_home + 2 eps`` and
  ``d <= radius + eps``).  A task holds one block at a time and streams its guests; it
  sends counts, links of a spanning forest or labels, never pairs, and no point passes
  through the driver but the pivots and the shared ones.
* core points: weight of the neighbours including self >= ``min_samples``.
* clusters (G15): connected components of core points over the spanning forests,
  contracted by joins until one task can hold the rest.
* groups proven small by a size check (one query's top-k) run in one task
  per group with the same rules; large groups use the distributed path.
* border points take the earliest cluster among their core neighbours;
  cluster ids are dense in order of each cluster's first core point, numbered in
  ranges with an offset each; noise is -1.  This is the labelling sequential DBSCAN produces.

Defined results on both paths: null keys are one group; a point with a null vector is
noise and nobody's neighbour.  ``pid`` and ``pos`` are unique within a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


#: Vectors that all points are measured against, and points that every block has besides its own (both pass through the driver); points of a block; rows of a distance matrix; points that a task reads at a time; pairs whose distance is taken exactly at a time.
PIVOTS, SHARED, CELL, ROWS, READ, EXACT = 64, 1024, 4000, 256, 1024, 1 << 14


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within ``eps``: by products (in single precision, if that tells most), and exactly where those are too close to tell."""
    aa, bb = (a**2).sum(1), (b**2).sum(1)
    most = aa[np.isfinite(aa)].max(initial=0) + bb[np.isfinite(bb)].max(initial=0)
    slack = 2.0**-22 * (a.shape[1] + 8) * most + 1e-6 * eps**2
    kind = np.float32
    if not (slack <= 0.05 * eps**2 and most < 1e30 and eps > 1e-12):
        kind, slack = np.float64, 0.02 * eps**2 + 1e-9 * (1 + most)
    d2 = (-2 * a).astype(kind) @ b.T.astype(kind)
    d2 += aa.astype(kind)[:, None]
    d2 += bb.astype(kind)[None, :]
    near = d2 <= kind(eps**2 + slack)
    i, j = np.nonzero(near)
    unsure = d2[i, j] >= eps**2 - slack
    i, j = i[unsure], j[unsure]
    for begin in range(0, len(i), EXACT):
        p, q = i[begin : begin + EXACT], j[begin : begin + EXACT]
        near[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(axis=1)) <= eps
    return near


def _pairs(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(_near(a, b, eps))


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the least member's place for each group) with the groups of each ``i`` and ``j`` made one."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.map(lambda v: np.asarray(v, dtype=np.float64)).values)


def _local(home: pd.DataFrame, shared: pd.DataFrame, eps: float, min_samples: int) -> pd.DataFrame:
    """pid, n, b: weight of the neighbours among the points of a block and ``shared``, and for the sure core points one of their component."""
    shared = shared[(shared["kk"] == home["kk"].iloc[0]) & ~shared["pid"].isin(home["pid"])]
    pid = np.concatenate([home["pid"], shared["pid"]]).astype(np.int64)
    weight = np.concatenate([home["weight"], shared["weight"]]).astype(np.int64)
    mat = np.concatenate([_vectors(home["vec"]), *([_vectors(shared["vec"])] if len(shared) else [])])
    n = np.where(np.isfinite(mat).all(axis=1), weight, 0)  # others aren't near themselves
    for begin in range(0, len(mat), ROWS):
        i, j = _pairs(mat[begin : begin + ROWS], mat[begin:], eps)
        i, j = i[i < j] + begin, j[i < j] + begin
        n += np.bincount(i, weight[j], len(n)).astype(np.int64) + np.bincount(j, weight[i], len(n)).astype(np.int64)
    root, core = np.arange(len(mat)), n >= min_samples
    for begin in range(0, len(mat), ROWS):
        i, j = _pairs(mat[begin : begin + ROWS], mat[begin:], eps)
        i, j = i + begin, j + begin
        both = core[i] & core[j] & (i < j)
        root = _joined(root, i[both], j[both])
    own = np.arange(len(mat)) < len(home)
    keep = own | core
    return pd.DataFrame({"pid": pid[keep], "n": np.where(own, n, 0)[keep], "b": pd.array(pid[root][keep], "Int64").copy()}).assign(b=lambda x: x["b"].mask(~core[keep]), kk=home["kk"].iloc[0])


class Degrees:
    """Weight of the guests that each point of a block has for neighbours."""

    columns, schema = ["weight"], "n long"

    def __init__(self, home: pd.DataFrame, eps: float):
        self.home, self.mat, self.eps = home, _vectors(home["vec"]), eps
        self.n = np.zeros(len(home), np.int64)

    def guests(self, guests: pd.DataFrame) -> None:
        i, j = _pairs(_vectors(guests["vec"]), self.mat, self.eps)
        self.n += np.bincount(j, guests["weight"].to_numpy(np.int64)[i], len(self.n)).astype(np.int64)

    def end(self) -> pd.DataFrame:
        return pd.DataFrame({"pid": self.home["pid"].to_numpy(), "n": self.n})


class Forest:
    """Links between the components of a block's points and of its guests: one for each time that two become one; those known to be one aren't compared."""

    columns, schema = ["label"], "b long"

    def __init__(self, home: pd.DataFrame, eps: float):
        self.mat, self.eps = _vectors(home["vec"]), eps
        self.label = home["label"].to_numpy(np.int64)
        self.to: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while x in self.to:
            x = self.to[x]
        return x

    def found(self, labels: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(labels, return_inverse=True)
        return np.array([self.find(x) for x in distinct.tolist()], np.int64)[at]

    def guests(self, guests: pd.DataFrame) -> None:
        labels, mat = self.found(guests["label"].to_numpy(np.int64)), _vectors(guests["vec"])
        distinct, n = np.unique(labels, return_counts=True)
        common = distinct[n.argmax()]
        for some, mine in ((labels == common, np.flatnonzero(self.label != common)), (labels != common, np.arange(len(self.mat)))):
            if not some.any() or not len(mine):
                continue
            i, j = _pairs(mat[some], self.mat[mine], self.eps)
            for a, b in {(a, b) for a, b in zip(labels[some][i].tolist(), self.label[mine][j].tolist()) if a != b}:
                x, y = sorted((self.find(a), self.find(b)))
                if x != y:
                    self.to[y] = x
                    self.edges.append((x, y))
            self.label = self.found(self.label)

    def end(self) -> pd.DataFrame:
        return pd.DataFrame(self.edges, columns=["pid", "b"], dtype=np.int64)


class Borders:
    """Least cluster among the guests that each point of a block has for neighbours."""

    columns, schema = ["cluster"], "cluster_id long"

    def __init__(self, home: pd.DataFrame, eps: float):
        self.home, self.mat, self.eps = home, _vectors(home["vec"]), eps
        self.best = np.full(len(home), np.iinfo(np.int64).max)

    def guests(self, guests: pd.DataFrame) -> None:
        i, j = _pairs(_vectors(guests["vec"]), self.mat, self.eps)
        np.minimum.at(self.best, j, guests["cluster"].to_numpy(np.int64)[i])

    def end(self) -> pd.DataFrame:
        found = self.best < np.iinfo(np.int64).max
        return pd.DataFrame({"pid": self.home["pid"].to_numpy()[found], "cluster_id": self.best[found]})


def _in_blocks(placed: DataFrame, kernel: type, eps: float) -> DataFrame:
    """kk, pid and the kernel's column, for every block of ``placed`` with its guests streamed past it."""

    def run(it):
        at, home, state = None, [], None
        for pdf in it:
            out = []
            marks = pdf[["kk", "cell", "salt", "role"]]
            cuts = np.flatnonzero((marks != marks.shift()).any(axis=1).to_numpy())
            for begin, end in zip(cuts, [*cuts[1:], len(pdf)]):
                part = pdf.iloc[begin:end]
                block = tuple(part[["kk", "cell", "salt"]].iloc[0])
                if block != at:
                    if state is not None:
                        out.append(state.end().assign(kk=at[0]))
                    at, state, home = block, None, []
                if part["role"].iloc[0] == 0:
                    home.append(part)
                    continue
                if state is None and home:
                    state, home = kernel(pd.concat(home, ignore_index=True), eps), []
                if state is not None:
                    for i in range(0, len(part), ROWS):
                        state.guests(part.iloc[i : i + ROWS])
            if out:
                yield pd.concat(out, ignore_index=True)
        if state is not None:
            yield state.end().assign(kk=at[0])

    rows = placed.select("kk", "cell", "salt", "role", "pid", "vec", *kernel.columns)
    block = ["kk", "cell", "salt"]
    return rows.repartition(*block).sortWithinPartitions(*block, "role").mapInPandas(run, f"pid long, {kernel.schema}, kk string")


def _cells(points: DataFrame, eps: float) -> DataFrame:
    """``points`` with their cell (``home``), the distance to its pivot (``away``) and the cells where they may have neighbours (``near``)."""
    pivots = points.select("pid", "kk", "vec").orderBy(F.xxhash64("kk", "pid"), "kk", "pid").limit(PIVOTS).toPandas()
    mat = _vectors(pivots["vec"]) if len(pivots) else np.zeros((0, 0))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column("vec").to_pylist(), dtype=np.float64)
            d = np.stack([np.sqrt(((own - p) ** 2).sum(axis=1)) for p in mat], axis=1)
            home = d.argmin(axis=1)
            away = d[np.arange(len(d)), home]
            row, other = np.nonzero(d <= (away + 2 * eps * (1 + 1e-9) + 1e-9)[:, None])
            met = pa.StructArray.from_arrays([pa.array(other, pa.int32()), pa.array(d[row, other])], ["other", "d"])
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(d) + 1)), pa.int32()), met)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(away), near], [*batch.schema.names, "home", "away", "near"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return materialize(points.mapInArrow(assign, f"{fields}, home int, away double, near array<struct<other:int,d:double>>"), "cluster-cells", READ)


def _shared_blocks(cells: pd.DataFrame) -> pd.DataFrame:
    """The cells (other, radius, n, to) of a key with the block that each is in (cell) and in how many parts that comes (salts)."""
    at = {c: k for k, c in enumerate(sorted(cells["other"]))}
    cells = cells.sort_values("other", ignore_index=True)
    links = [(k, at[c]) for k, to in enumerate(cells["to"]) for c in to if c in at]
    root = _joined(np.arange(len(cells)), *np.array(links, np.int64).reshape(-1, 2).T)
    before = cells.groupby(root)["n"].cumsum() - cells["n"]
    block = pd.DataFrame({"root": root, "k": before // CELL, "n": cells["n"]}).groupby(["root", "k"])["n"]
    return cells[["kk", "other", "radius"]].assign(cell=block.ngroup(), salts=-(-block.transform("sum") // CELL))


def _met(homes: DataFrame, guests: DataFrame, eps: float) -> DataFrame:
    """Blocks (kk, cell, salt) of ``homes`` (role 0, each in one), and the ``guests`` that may be near some of a block (role 1); both as of ``_cells``, with the same columns.

    Cells of few points that may have neighbours in one another share a block, so that the guests are sent to few.
    """
    sizes = homes.groupBy("kk", F.col("home").alias("other")).agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    links = homes.select("kk", F.col("home").alias("other"), F.explode("near.other").alias("to")).groupBy("kk", "other").agg(F.collect_set("to").alias("to"))
    sizes = sizes.join(links, ["kk", "other"]).groupBy("kk").applyInPandas(_shared_blocks, "kk string, other int, radius double, cell int, salts int")
    sizes = materialize(sizes, "cluster-sizes")
    rest = [c for c in homes.columns if c not in ("home", "away", "near")]
    salt = F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int").alias("salt")
    own = homes.withColumnRenamed("home", "other").join(sizes, ["kk", "other"]).select("cell", salt, F.lit(0).alias("role"), *rest)
    reach = guests.select("kk", "pid", F.explode("near").alias("n")).select("kk", "pid", F.col("n.other").alias("other"), F.col("n.d").alias("d")).join(sizes, ["kk", "other"])
    reach = reach.where(F.col("d") <= F.col("radius") + eps * (1 + 1e-9) + 1e-9).groupBy("kk", "pid").agg(F.collect_set(F.struct("cell", "salts")).alias("cells"))
    sent = guests.select(*rest).join(reach, ["kk", "pid"]).withColumn("c", F.explode("cells")).withColumn("cell", F.col("c.cell"))
    sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("c.salts") - 1))).select("cell", "salt", F.lit(1).alias("role"), *rest)
    return own.unionByName(sent)


def _placed(points: DataFrame, eps: float) -> DataFrame:
    """The block that each point is in (role 0) and those where it is a guest (role 1)."""
    cells = _cells(points, eps)
    return _met(cells, cells, eps)


#: Links that one task may hold; more are contracted by joins first.  Rows that it returns at a time.
SOLVED, SLICE = 500_000, 50_000


def connected_min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(key, pid, label)``, undirected ``edges(key, a, b)`` (both ways) -> the smallest label of each node's component.

    While there are more than ``SOLVED`` edges, each round joins every node to the least of
    itself and its neighbours in an order by hash (stars vanish in one round, chains
    shrink by a share of their length) and keeps the edges between what was joined.  The
    rest, of a proven size, is solved in one task.
    """
    left = edges.select("key", "a", "b").where("a <> b")
    owner = nodes.select("key", "pid", "label", F.col("pid").alias("at"))
    rank = lambda c: F.struct(F.xxhash64("key", c).alias("h"), F.col(c).alias("v"))
    while left.count() > SOLVED:
        joined = left.groupBy("key", "a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("r"))
        joined = materialize(joined.select("key", F.col("a").alias("at"), F.col("r.v").alias("to")), "cluster-joined")
        owner = owner.join(joined, ["key", "at"], "left").select("key", "pid", "label", F.coalesce("to", "at").alias("at"))
        to = lambda side: joined.select("key", F.col("at").alias(side), F.col("to").alias(f"to_{side}"))  # noqa: E731,B023
        left = left.join(to("a"), ["key", "a"]).join(to("b"), ["key", "b"]).where("to_a <> to_b")
        left = materialize(left.select("key", F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "cluster-links")
    solved = left.repartition(1).mapInPandas(_solve, f"key {left.schema['key'].dataType.simpleString()}, at long, to long")
    owner = owner.join(solved, ["key", "at"], "left").select("key", "pid", "label", F.coalesce("to", "at").alias("at"))
    owner = materialize(owner, "cluster-owners")
    least = owner.groupBy("key", "at").agg(F.min("label").alias("least"))
    return owner.join(least, ["key", "at"]).select("key", "pid", F.col("least").alias("label"))


def _solve(it):
    """Component of each node of at most ``SOLVED`` edges: (key, at, to), ``to`` being one of its nodes."""
    keys: dict = {}
    parts = [(np.array([keys.setdefault(k, len(keys)) for k in pdf["key"]], np.int64), pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)) for pdf in it]
    if not sum(len(p[0]) for p in parts):
        return
    key, a, b = map(np.concatenate, zip(*parts))
    n, key, pids = len(key), np.concatenate([key, key]), np.concatenate([a, b])
    order = np.lexsort((pids, key))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(pids[order]) != 0))
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    key, pids, a, b = key[order[new]], pids[order[new]], codes[:n], codes[n:]
    root = np.arange(len(pids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    names = np.array([*keys, None], dtype=object)
    for begin in range(0, len(pids), SLICE):
        own = slice(begin, begin + SLICE)
        yield pd.DataFrame({"key": names[key[own]], "at": pids[own], "to": pids[root[own]]})


def _dbscan_group(pos: np.ndarray, mat: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels for one small group, same rules as the distributed path (input in any order)."""
    n = len(pos)
    adj = np.stack([np.sqrt(((mat - row) ** 2).sum(axis=1)) <= eps for row in mat]) if n else np.zeros((0, 0), bool)
    core = adj.sum(axis=1) >= min_samples
    comp = np.full(n, -1)
    order = np.argsort(pos, kind="stable")
    for start in order:
        if not core[start] or comp[start] >= 0:
            continue
        comp[start] = start
        stack = [start]
        while stack:
            i = stack.pop()
            for j in np.nonzero(adj[i] & core)[0]:
                if comp[j] < 0:
                    comp[j] = start
                    stack.append(j)
    labels = np.full(n, -1, dtype=np.int64)
    roots = sorted({c for c in comp if c >= 0}, key=lambda c: pos[c])
    rid = {c: k for k, c in enumerate(roots)}
    for i in range(n):
        if comp[i] >= 0:
            labels[i] = rid[comp[i]]
    for i in np.nonzero(~core)[0]:
        nbr = [labels[j] for j in np.nonzero(adj[i] & core)[0]]
        if nbr:
            labels[i] = min(nbr)
    return labels


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 2, small_group: int = 2000) -> DataFrame:
    """``key, pid, cluster_id`` (-1 = noise) for every point.

    Groups proven small (largest group <= ``small_group`` points, e.g. one
    query's top-k hits) are clustered inside one task per group; otherwise the
    distributed epsilon-join + connected-components path runs.
    """
    filled = points.select("key", "pid", "pos", "vec").where("vec is not null")
    none = points.where("vec is null").select("key", "pid", F.lit(-1).cast("bigint").alias("cluster_id"))
    largest = filled.groupBy("key").count().select(F.max("count")).collect()[0][0] or 0
    if largest <= small_group:
        key_type = points.schema["key"].dataType

        def per_group(table: pa.Table) -> pa.Table:
            mat = np.array(table.column("vec").to_pylist(), dtype=np.float64)
            lab = _dbscan_group(table.column("pos").to_numpy(), mat, eps, min_samples)
            return pa.table({"key": table.column("key"), "pid": table.column("pid").cast(pa.int64()), "cluster_id": pa.array(lab, pa.int64())})

        small = filled.groupBy("key").applyInArrow(per_group, f"key {key_type.simpleString()}, pid long, cluster_id long")
        return small.unionByName(none)
    return _dbscan_cells(filled, eps, min_samples).unionByName(none)


def _dbscan_cells(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    kk = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("null"))
    pts = materialize(points.withColumn("kk", kk), "cluster-points")
    # one point for all exact copies of a vector
    one = pts.groupBy("kk", "vec").agg(F.min(F.struct("pos", "pid")).alias("r"), F.count(F.lit(1)).alias("weight"))
    one = materialize(one.select("kk", "vec", "weight", "r.pos", F.col("r.pid").cast("long").alias("pid")), "cluster-distinct")
    cells = _cells(one.select("kk", "pid", "weight", "vec"), eps)
    shared = cells.select("kk", "pid", "weight", "vec").orderBy(F.xxhash64("kk", "pid", F.lit(1)), "kk", "pid").limit(SHARED).toPandas()

    sizes = cells.groupBy("kk", "home").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("salts"))
    blocks = cells.select("kk", "pid", "weight", "vec", "home").join(sizes, ["kk", "home"]).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int"))
    seen = blocks.groupBy("kk", "home", "salt").applyInPandas(lambda home: _local(home, shared, eps, min_samples), "pid long, n long, b long, kk string")
    seen = materialize(seen, "cluster-local", READ).groupBy("kk", "pid").agg(F.max("n").alias("n"), F.collect_set("b").alias("bs"))
    seen = materialize(seen, "cluster-seen", READ)
    # points without enough neighbours so far meet all that may be near
    left = seen.where(F.size("bs") == 0).select("kk", "pid")
    weighed = _in_blocks(_met(cells.join(left, ["kk", "pid"]), cells, eps), Degrees, eps).groupBy("kk", "pid").agg(F.sum("n").alias("n"))
    weighed = materialize(weighed, "cluster-degrees", READ)
    core = seen.where(F.size("bs") > 0).select("kk", "pid").unionByName(weighed.where(F.col("n") >= min_samples).select("kk", "pid"))
    core = materialize(one.join(core, ["kk", "pid"]).select("kk", "pid", "pos"), "cluster-core", READ)
    both = lambda df: df.unionByName(df.select("key", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inner = both(seen.select(F.col("kk").alias("key"), F.col("pid").alias("a"), F.explode("bs").alias("b")).where("a <> b"))
    so_far = connected_min_label(core.select(F.col("kk").alias("key"), "pid", F.col("pid").alias("label")), materialize(inner, "cluster-inner"))
    so_far = materialize(so_far.withColumnRenamed("key", "kk"), "cluster-so-far")
    # all but the largest component so far of each key meet all that may be near
    largest = so_far.groupBy("kk", "label").count().groupBy("kk").agg(F.max(F.struct("count", "label")).alias("m")).select("kk", F.col("m.label").alias("label"))
    known = cells.join(so_far, ["kk", "pid"])
    few = known.join(largest, ["kk", "label"], "left_anti").select(*known.columns)
    edges = _in_blocks(_met(few, known, eps), Forest, eps).select(F.col("kk").alias("key"), F.col("pid").alias("a"), "b")
    tree = so_far.select(F.col("kk").alias("key"), F.col("pid").alias("a"), F.col("label").alias("b")).where("a <> b")
    edges = materialize(both(edges.unionByName(tree)), "cluster-edges", READ)
    labels = connected_min_label(core.select(F.col("kk").alias("key"), "pid", F.col("pos").alias("label")), edges).withColumnRenamed("key", "kk")
    labels = materialize(labels, "cluster-labels")
    owned = labels.join(_numbered(labels.select("kk", "label").distinct()), ["kk", "label"]).select("kk", "pid", F.col("cluster_id").alias("cluster"))
    # a point whose only neighbour is itself is no border point
    lone = weighed.where(F.col("n") < min_samples).join(one.select("kk", "pid", "weight"), ["kk", "pid"]).where("n > weight").select("kk", "pid")
    edge = cells.join(lone, ["kk", "pid"]).withColumn("cluster", F.lit(None).cast("bigint"))
    border = _in_blocks(_met(edge, cells.join(owned, ["kk", "pid"]), eps), Borders, eps).groupBy("kk", "pid").agg(F.min("cluster_id").alias("cluster"))
    border = materialize(border, "cluster-borders", READ)
    found = one.select("kk", "pid", "vec").join(owned.unionByName(border.select("kk", "pid", "cluster")), ["kk", "pid"])
    out = pts.join(found.select("kk", "vec", "cluster"), ["kk", "vec"], "left")
    return out.select("key", F.col("pid").cast("long").alias("pid"), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster_id"))


def _numbered(labels: DataFrame) -> DataFrame:
    """``labels`` (kk, label) with ``cluster_id``: 0, 1, ... by label within kk, in ranges whose offsets are added up."""
    ranged = labels.repartitionByRange("kk", "label").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "cluster-ranges")
    before = Window.partitionBy("kk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("kk", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("kk", "part").orderBy("label"))
    return ranged.withColumn("place", place).join(offsets, ["kk", "part"]).select("kk", "label", (F.col("place") - 1 + F.col("offset")).cast("bigint").alias("cluster_id"))


def cluster_results(hits: DataFrame, vecs: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Cluster each query's hits on their document vectors; adds ``cluster_id`` (G15), -1 for noise and documents without a vector."""
    pts = hits.select(F.col("query_id").alias("key"), F.col("doc_id").alias("pid"), F.col("rank").alias("pos")).join(
        vecs.select(F.col("doc_id").alias("pid"), F.col("dvec").alias("vec")), "pid")
    lab = dbscan(pts, eps, min_samples)
    found = hits.join(lab.select(F.col("key").alias("query_id"), F.col("pid").alias("doc_id"), "cluster_id"), ["query_id", "doc_id"], "left")
    return found.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")))


def collapse_clusters(hits: DataFrame) -> DataFrame:
    """Keep the best-ranked hit of every cluster; noise hits are all kept."""
    w = Window.partitionBy("query_id", "cluster_id").orderBy("rank")
    r = hits.withColumn("_r", F.row_number().over(w))
    return r.where((F.col("cluster_id") < 0) | (F.col("_r") == 1)).drop("_r")
