"""Ordered per-key scans that stay parallel when one key holds much of the data.

Pattern (a parallel prefix scan, the same scheme ``zipWithIndex`` uses):

1. ``ordered_partitions``: range-partition by (key, order) and sort within
   partitions, then checkpoint into ``spark.checkpoint.dir`` so partition
   bounds are fixed and the job survives executor loss.  A hot key spreads
   over many partitions.
2. Summary pass (``mapInPandas``): each partition reports only its first and
   last key segment: at most two small rows per partition.
3. The summaries (bounded by the partition count, not the data) are composed
   in partition order into one carry per partition: the state entering that
   partition's first key segment.
4. Apply pass (``mapInPandas``) scans every partition from its carry.

Kernels: affine recurrence ``r <- a*r + b`` (W1), running count/sum, TTL
cache replay (W3), and budget admission (W4) as a few rounds of exclusive
prefix sums.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, materialize

SUMMARY_SCHEMA = "pid int, first_key string, last_key string, payload string"


ROWS_PER_RANGE = 500_000


def ordered_partitions(df: DataFrame, key: str, order: list[str], n_parts: int | None = None,
                       rows_per_partition: int = ROWS_PER_RANGE) -> DataFrame:
    """Range-partitioned, sorted, checkpointed copy with the columns ``_pid`` and ``_border``.

    Without ``n_parts`` the range count follows the data (one count job) and the cluster:
    at least one range per core, and about ``rows_per_partition`` rows in a range at most,
    so partitions stay bounded at any scale and a hot key spans as many ranges as its size needs.
    ``_border`` is the key as text, by which neighbouring ranges tell whether a key goes
    on; null keys are one key of their own.
    """
    if not n_parts:
        n_parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_partition))
    s = df.repartitionByRange(n_parts, key, *order).sortWithinPartitions(key, *order)
    border = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    return cut_lineage(s.withColumns({"_pid": F.spark_partition_id(), "_border": border}))


def _frames(it) -> pd.DataFrame | None:
    parts = [p for p in it if len(p)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _segments(keys: np.ndarray):
    """(start, end, key) of runs of equal keys in a sorted partition."""
    n = len(keys)
    if n == 0:
        return []
    change = np.nonzero(keys[1:] != keys[:-1])[0] + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [n]])
    return [(int(s), int(e), keys[s]) for s, e in zip(starts, ends)]


def run_scan(s: DataFrame, key: str, kernel, out_schema: str) -> DataFrame:
    """Summary pass -> carry composition -> apply pass, over ``ordered_partitions`` output."""
    cols = list(dict.fromkeys([key, "_pid", "_border", *kernel.columns]))

    def summarize(it):
        pdf = _frames(it)
        if pdf is None:
            return
        segs = _segments(pdf["_border"].to_numpy())
        first, last = segs[0], segs[-1]
        payload = {"first": kernel.transfer(pdf.iloc[first[0]:first[1]])}
        if len(segs) > 1:
            payload["last"] = kernel.fresh_out(pdf.iloc[last[0]:last[1]])
        yield pd.DataFrame({"pid": [int(pdf["_pid"].iloc[0])], "first_key": [str(first[2])], "last_key": [str(last[2])],
                            "payload": [json.dumps(payload)]})

    summaries = s.select(*cols).mapInPandas(summarize, SUMMARY_SCHEMA).collect()  # <= one row per partition
    carries: dict[int, object] = {}
    cur_key, cur_state = None, None
    for row in sorted(summaries, key=lambda r: r.pid):
        p = json.loads(row.payload)
        incoming = cur_state if row.first_key == cur_key else None
        carries[row.pid] = incoming
        if "last" in p:
            cur_state = p["last"]
        else:
            cur_state = kernel.compose(p["first"], incoming)
        cur_key = row.last_key
    return apply_scan(s, kernel, carries, out_schema)


def apply_scan(s: DataFrame, kernel, carries: dict[int, object], out_schema: str) -> DataFrame:
    """Apply pass: every range from the state that enters it."""
    bc = s.sparkSession.sparkContext.broadcast(carries)

    def apply(it):
        pdf = _frames(it)
        if pdf is None:
            return
        carry = bc.value.get(int(pdf["_pid"].iloc[0]))
        outs = []
        for i, (a, b, _) in enumerate(_segments(pdf["_border"].to_numpy())):
            outs.append(kernel.apply(pdf.iloc[a:b].reset_index(drop=True), carry if i == 0 else None))
        yield pd.concat(outs, ignore_index=True)

    return s.mapInPandas(apply, out_schema)


# ---------------------------------------------------------------- kernels

class AffineKernel:
    """``r_i = a_i * r_{i-1} + b_i`` from ``init``; also the 1-based index within the key."""

    def __init__(self, a: str, b: str, init: float, keep: list[str]):
        self.a, self.b, self.init, self.keep = a, b, init, keep
        self.columns = [a, b, *keep]

    def transfer(self, seg):
        return {"A": float(np.prod(seg[self.a].to_numpy(np.float64))), "B": self._fold(seg, 0.0), "n": len(seg)}

    def _fold(self, seg, r):
        for ai, bi in zip(seg[self.a].to_numpy(np.float64), seg[self.b].to_numpy(np.float64)):
            r = ai * r + bi
        return r

    def fresh_out(self, seg):
        return {"r": self._fold(seg, self.init), "n": len(seg)}

    def compose(self, t, incoming):
        r0 = self.init if incoming is None else incoming["r"]
        n0 = 0 if incoming is None else incoming["n"]
        return {"r": t["A"] * r0 + t["B"], "n": n0 + t["n"]}

    def apply(self, seg, carry):
        r = self.init if carry is None else carry["r"]
        n0 = 0 if carry is None else carry["n"]
        a, b = seg[self.a].to_numpy(np.float64), seg[self.b].to_numpy(np.float64)
        out = np.empty(len(seg))
        for i in range(len(seg)):
            r = a[i] * r + b[i]
            out[i] = r
        res = seg[self.keep].copy()
        res["value"] = out
        res["idx"] = np.arange(n0 + 1, n0 + len(seg) + 1, dtype=np.int64)
        return res


class RunningMeanKernel(AffineKernel):
    """``r <- (r*(n-1) + x)/n`` on rows where ``ok``; unchanged otherwise (``n`` = global 1-based index).

    Same carry algebra as the affine kernel (``a=(n-1)/n, b=x/n`` columns) but
    each row is evaluated exactly as the recurrence is written.
    """

    def __init__(self, a: str, b: str, n: str, x: str, ok: str, keep: list[str]):
        super().__init__(a, b, 0.0, keep)
        self.n_col, self.x_col, self.ok_col = n, x, ok
        self.columns = list(dict.fromkeys([a, b, n, x, ok, *keep]))

    def apply(self, seg, carry):
        r = self.init if carry is None else carry["r"]
        n0 = 0 if carry is None else carry["n"]
        n = seg[self.n_col].to_numpy(np.float64)
        x = seg[self.x_col].to_numpy(np.float64)
        ok = seg[self.ok_col].to_numpy(bool)
        out = np.empty(len(seg))
        for i in range(len(seg)):
            if ok[i]:
                r = (r * (n[i] - 1) + x[i]) / n[i]
            out[i] = r
        res = seg[self.keep].copy()
        res["value"] = out
        res["idx"] = np.arange(n0 + 1, n0 + len(seg) + 1, dtype=np.int64)
        return res


class TTLKernel:
    """Cache replay: a miss stores for ``ttl``; hits inside it do not extend it; hit iff ``t < expiry``.

    State = (expiry, id of the request that stored the entry).  ``ttl_carries`` finds the
    state that enters each range.
    """

    def __init__(self, t: str, rid: str, ttl: int, keep: list[str]):
        self.t, self.rid, self.ttl, self.keep = t, rid, ttl, keep
        self.columns = [t, rid, *keep]

    def _next(self, t: np.ndarray) -> np.ndarray:
        """Of each request the first one that misses if it does; beyond the last: the length."""
        return np.append(np.maximum(np.searchsorted(t, t + self.ttl, side="left"), np.arange(1, len(t) + 1)), len(t))

    def ends(self, seg) -> tuple[np.ndarray, np.ndarray]:
        """Expiry and id left at the end of the segment if a request misses, for each, by pointer doubling."""
        t, ids = seg[self.t].to_numpy(np.int64), seg[self.rid].to_numpy(np.int64)
        jump = self._next(t)
        last = np.where(jump[:-1] < len(t), jump[:-1], np.arange(len(t)))
        while True:
            further = last[last]
            if (further == last).all():
                return t[last] + self.ttl, ids[last]
            last = further

    def bounds(self, seg) -> dict:
        """Constant-size summary of a segment: first and last time, and what it leaves if its first request misses."""
        t = seg[self.t].to_numpy(np.int64)
        expiry, ids = self.ends(seg)
        return {"t0": int(t[0]), "t1": int(t[-1]), "fresh": [int(expiry[0]), int(ids[0])]}

    def heads(self, seg) -> pd.DataFrame:
        """upto, expiry, sid: what the segment leaves for each expiry that may enter it.

        An entering expiry is at most ``t0 + ttl``; one of at most ``upto`` (and above the row
        before) leaves (``expiry``, ``sid``), one beyond all rows passes unchanged.
        """
        t = seg[self.t].to_numpy(np.int64)
        n = min(int(np.searchsorted(t, t[0] + self.ttl, side="left")) + 1, len(t))
        expiry, ids = (x[:n] for x in self.ends(seg))
        change = np.append((expiry[1:] != expiry[:-1]) | (ids[1:] != ids[:-1]), True)
        return pd.DataFrame({"upto": t[:n][change], "expiry": expiry[change], "sid": ids[change]}).drop_duplicates("upto", keep="first")

    def apply(self, seg, carry):
        t, ids = seg[self.t].to_numpy(np.int64), seg[self.rid].to_numpy(np.int64)
        n, jump = len(t), self._next(t)
        first = 0 if carry is None else int(np.searchsorted(t, carry[0], side="left"))
        found = new = np.arange(first, min(first + 1, n))
        while len(new):  # each pass doubles the misses found
            new = jump[found]
            new = new[new < n]
            found, jump = np.concatenate([found, new]), jump[jump]
        miss = np.zeros(n, dtype=bool)
        miss[found] = True
        stored = np.maximum.accumulate(np.where(miss, np.arange(n), -1))
        res = seg[self.keep].copy()
        res["hit"] = ~miss
        res["served_by"] = np.where(stored < 0, 0 if carry is None else carry[1], ids[stored])
        return res


def ttl_carries(s: DataFrame, key: str, kernel: TTLKernel) -> dict[int, object]:
    """The state (expiry, id) that enters each range of ``ordered_partitions``, for ``TTLKernel``.

    The driver gets one row of constant size a range.  They tell all but the ranges that
    one key fills from an earlier range to a later one.  What those leave for each expiry
    is a table (``TTLKernel.heads``) whose rows point to each other: the expiry that a row
    leaves meets one row of one later range of the chain.  Pointer doubling marks the rows
    on the way from the start of each chain, at most one a range.
    """
    spark = s.sparkSession
    cols = list(dict.fromkeys([key, "_pid", "_border", *kernel.columns]))

    def summarize(it):
        pdf = _frames(it)
        if pdf is None:
            return
        segs = _segments(pdf["_border"].to_numpy())
        last = kernel.bounds(pdf.iloc[segs[-1][0]:segs[-1][1]])
        yield pd.DataFrame({"pid": [int(pdf["_pid"].iloc[0])], "first_key": [str(segs[0][2])], "last_key": [str(segs[-1][2])],
                            "payload": [json.dumps(last | {"one": len(segs) == 1})]})

    rows = sorted(s.select(*cols).mapInPandas(summarize, SUMMARY_SCHEMA).collect(), key=lambda r: r.pid)
    carries: dict[int, object] = {}
    chains: list[tuple[list[int], list]] = []  # ranges that one key enters from the range before, and the state that enters the first
    of = {r.pid: json.loads(r.payload) for r in rows}
    before = None
    for row in rows:
        if before is None or before.last_key != row.first_key:
            carries[row.pid] = None
        elif chains and chains[-1][0][-1] == before.pid and of[before.pid]["one"]:
            chains[-1][0].append(row.pid)
        else:
            carries[row.pid] = of[before.pid]["fresh"]
            chains.append(([row.pid], carries[row.pid]))
        before = row
    chains = [c for c in chains if len(c[0]) > 1]
    if not chains:
        return carries

    through = {pid: c for c, (pids, _) in enumerate(chains) for pid in pids[:-1]}  # ranges whose outcome is wanted
    tops = [np.array([of[p]["t1"] for p in pids[:-1]], dtype=np.int64) for pids, _ in chains]

    def target(chain: int, after: int, expiry: np.ndarray) -> np.ndarray:
        """Range of the chain behind place ``after`` that an expiry falls into (-1: none)."""
        pids = np.array([*chains[chain][0][:-1], -1])
        return pids[np.maximum(np.searchsorted(tops[chain], expiry, side="left"), min(after + 1, len(pids) - 1))]

    def write(it):
        pdf = _frames(it)
        if pdf is None or int(pdf["_pid"].iloc[0]) not in through:
            return
        pid = int(pdf["_pid"].iloc[0])
        out = kernel.heads(pdf)
        chain = through[pid]
        yield out.assign(pid=pid, to=target(chain, chains[chain][0].index(pid), out["expiry"].to_numpy()))

    heads = materialize(s.select(*cols).mapInPandas(write, "pid int, upto long, expiry long, sid long, to int"), "ttl-heads")
    starts = [(int(target(c, -1, np.array([state[0]]))[0]), int(state[0])) for c, (_, state) in enumerate(chains)]
    asked = heads.where("to >= 0").select("to", F.col("expiry").alias("ask")).distinct()
    asked = asked.union(spark.createDataFrame(starts, "to int, ask long").where("to >= 0")).distinct()

    def meet(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        upto = np.sort(there["upto"].to_numpy(np.int64))
        ask = asks["ask"].to_numpy(np.int64)
        return pd.DataFrame({"to": asks["to"], "ask": ask, "to_upto": upto[np.searchsorted(upto, ask, side="left")]})

    met = materialize(asked.groupBy("to").cogroup(heads.select(F.col("pid").alias("to"), "upto").groupBy("to")).applyInPandas(meet, "to int, ask long, to_upto long"), "ttl-met")
    jump = heads.join(met.withColumnRenamed("ask", "expiry"), ["to", "expiry"]).select("pid", "upto", "to", "to_upto")
    on_way = spark.createDataFrame(starts, "to int, ask long").join(met, ["to", "ask"]).select(F.col("to").alias("pid"), F.col("to_upto").alias("upto")).distinct()
    for _ in range(max(len(pids) for pids, _ in chains).bit_length()):
        jump = materialize(jump, "ttl-jump")
        on_way = materialize(on_way.union(on_way.join(jump, ["pid", "upto"]).select("to", "to_upto")).distinct(), "ttl-way")
        further = jump.select(F.col("pid").alias("to"), F.col("upto").alias("to_upto"), F.col("to").alias("far"), F.col("to_upto").alias("far_upto"))
        jump = jump.join(further, ["to", "to_upto"]).select("pid", "upto", F.col("far").alias("to"), F.col("far_upto").alias("to_upto"))
    left = {r.pid: [r.expiry, r.sid] for r in heads.join(on_way, ["pid", "upto"]).select("pid", "expiry", "sid").collect()}  # at most one a range
    for pids, state in chains:
        for pid, after in zip(pids, pids[1:]):
            state = carries[after] = left.get(pid, state)
    return carries


class SessionKernel:
    """Inactivity sessions: a gap ``>= gap`` since the key's previous event starts a session.

    State = (last event time, current session start), both in micros.
    """

    def __init__(self, t: str, gap: int, keep: list[str]):
        self.t, self.gap, self.keep = t, gap, keep
        self.columns = [t, *keep]

    def _starts(self, t: np.ndarray, carry):
        new = np.empty(len(t), dtype=bool)
        new[1:] = (t[1:] - t[:-1]) >= self.gap
        new[0] = carry is None or (t[0] - carry[0]) >= self.gap
        marks = np.where(new, t, np.iinfo(np.int64).min)
        start = np.maximum.accumulate(marks)
        if not new[0]:
            start = np.where(start == np.iinfo(np.int64).min, carry[1], start)
        return start

    def transfer(self, seg):
        t = seg[self.t].to_numpy(np.int64)
        inner = np.nonzero((t[1:] - t[:-1]) >= self.gap)[0]
        last_inner = int(t[inner[-1] + 1]) if len(inner) else None
        return {"t0": int(t[0]), "last_t": int(t[-1]), "last_inner": last_inner}

    def fresh_out(self, seg):
        t = seg[self.t].to_numpy(np.int64)
        return [int(t[-1]), int(self._starts(t, None)[-1])]

    def compose(self, tr, incoming):
        cont = incoming is not None and tr["t0"] - incoming[0] < self.gap
        first_start = incoming[1] if cont else tr["t0"]
        return [tr["last_t"], tr["last_inner"] if tr["last_inner"] is not None else first_start]

    def apply(self, seg, carry):
        res = seg[self.keep].copy()
        res["session_start_us"] = self._starts(seg[self.t].to_numpy(np.int64), carry)
        return res


class LagKernel:
    """Previous value of a column within the key (``default`` for the first row); carry = last value."""

    def __init__(self, col: str, out: str, default, keep: list[str]):
        self.col, self.out, self.default, self.keep = col, out, default, keep
        self.columns = list(dict.fromkeys([col, *keep]))

    def transfer(self, seg):
        return {"last": self.fresh_out(seg)}

    def fresh_out(self, seg):
        value = seg[self.col].iloc[-1]
        return value.item() if hasattr(value, "item") else value

    def compose(self, tr, incoming):
        return tr["last"]

    def apply(self, seg, carry):
        res = seg[self.keep].copy()
        res[self.out] = pd.Series([self.default if carry is None else carry, *seg[self.col].tolist()[:-1]], index=res.index, dtype=object)
        return res


class PrefixSumKernel:
    """Exclusive prefix sum (int64 units) of ``contrib`` over rows not removed by per-key rules.

    A rule ``(t, id, c)`` removes every later-or-equal row ``(t_i, id_i) >= (t, id)`` with ``cost >= c``.
    Emits each row's exclusive sum, whether it is a candidate, and whether it overflows ``budget``.
    """

    def __init__(self, key_col: str, t: str, rid: str, cost: str, contrib: str, budget: int, rules: dict, keep: list[str]):
        self.key_col, self.t, self.rid, self.cost, self.contrib = key_col, t, rid, cost, contrib
        self.budget, self.rules, self.keep = budget, rules, keep
        self.columns = [t, rid, cost, contrib, *keep]

    def _cand(self, seg, key):
        cand = np.ones(len(seg), dtype=bool)
        t = seg[self.t].to_numpy(np.int64)
        rid = seg[self.rid].to_numpy(np.int64)
        cost = seg[self.cost].to_numpy(np.int64)
        for (rt, rr, rc) in self.rules.get(str(key), []):
            after = (t > rt) | ((t == rt) & (rid >= rr))
            cand &= ~(after & (cost >= rc))
        return cand

    def transfer(self, seg):
        c = self._cand(seg, seg[self.key_col].iloc[0])
        return int(seg[self.contrib].to_numpy(np.int64)[c].sum())

    def fresh_out(self, seg):
        return self.transfer(seg)

    def compose(self, total, incoming):
        return (incoming or 0) + total

    def apply(self, seg, carry):
        c = self._cand(seg, seg[self.key_col].iloc[0])
        contrib = np.where(c, seg[self.contrib].to_numpy(np.int64), 0)
        excl = (carry or 0) + np.concatenate([[0], np.cumsum(contrib)[:-1]]) if len(seg) else np.zeros(0, dtype=np.int64)
        res = seg[list(dict.fromkeys([self.t, self.rid, self.cost, *self.keep]))].copy()
        res["cand"] = c
        res["spent_before"] = excl.astype(np.int64)
        res["overflow"] = c & (excl + seg[self.cost].to_numpy(np.int64) > self.budget)
        return res


# ---------------------------------------------------------------- operators

def affine_scan(df: DataFrame, key: str, order: list[str], a: str, b: str, init: float, keep: list[str], n_parts: int | None = None,
                mean_of: tuple[str, str, str] | None = None) -> DataFrame:
    """Per-key ordered ``r <- a*r + b``; adds ``value`` and 1-based ``idx``.

    ``mean_of=(n, x, ok)`` evaluates the running-mean form ``(r*(n-1)+x)/n`` literally.
    """
    extra = list(mean_of) if mean_of else []
    s = ordered_partitions(df.select(*dict.fromkeys([key, *order, a, b, *extra, *keep])), key, order, n_parts)
    kernel = RunningMeanKernel(a, b, *mean_of, keep) if mean_of else AffineKernel(a, b, init, keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*keep).schema.fields)
    return run_scan(s, key, kernel, f"{schema}, value double, idx long")


def ttl_cache_replay(req: DataFrame, key: str, ttl_seconds: int, ts: str = "ts", rid: str = "req_id", n_parts: int | None = None) -> DataFrame:
    """``hit`` and ``served_by`` (the request whose result was stored) per request.

    A request without a time takes no part in the cache: it is a miss that serves itself.
    """
    x = req.select(key, rid, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    untimed = x.where(F.col("_t").isNull()).select(key, rid, ts, F.lit(False).alias("hit"), F.col(rid).cast("long").alias("served_by"))
    s = ordered_partitions(x.where(F.col("_t").isNotNull()), key, ["_t", rid], n_parts)
    keep = [key, rid, ts]
    kernel = TTLKernel("_t", rid, ttl_seconds * 1_000_000, keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*keep).schema.fields)
    return apply_scan(s, kernel, ttl_carries(s, key, kernel), f"{schema}, hit boolean, served_by long").union(untimed)


def admit_by_budget(req: DataFrame, budget: str, key: str = "day", ts: str = "ts", rid: str = "req_id",
                    cost: str = "cost", spends: str | None = None, scale: int = 1_000_000_000, n_parts: int | None = None) -> DataFrame:
    """Admit iff ``spent + cost <= budget``; spent grows only on admitted rows (by ``spends`` if given).

    Rounds of exclusive prefix sums: what is left of the budget at a key's first overflow
    only shrinks, so that row and every later row that costs more than it are rejected.
    Every round rejects at least one further cost of each key that overflows, so the
    rounds end; money is handled in exact integer units of 1 / ``scale`` (the nine decimals
    of costs and budget).
    """
    spark = req.sparkSession
    units = lambda c: F.round(F.col(c).cast("decimal(38,9)") * scale).cast("long")
    contrib = units(cost) if spends is None else F.when(F.col(spends), units(cost)).otherwise(F.lit(0).cast("long"))
    x = req.select(F.col(key).cast("string").alias("_key"), key, rid, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
                   units(cost).alias("_cost"), contrib.alias("_contrib"))
    s = ordered_partitions(x, "_key", ["_t", rid], n_parts)
    bud = int(round(float(budget) * scale))
    rules: dict[str, list] = {}
    keep = ["_key", key, ts]
    schema = (f"_t long, {rid} long, _cost long, _key string, {key} {s.schema[key].dataType.simpleString()}, "
              f"{ts} {s.schema[ts].dataType.simpleString()}, cand boolean, spent_before long, overflow boolean")
    while True:
        kernel = PrefixSumKernel("_key", "_t", rid, "_cost", "_contrib", bud, rules, keep)
        out = run_scan(s, "_key", kernel, schema)
        first = (
            out.where("overflow").groupBy("_key")
            .agg(F.min(F.struct("_t", rid, "spent_before")).alias("f"))
            .select("_key", "f._t", f"f.{rid}", "f.spent_before")
            .collect()  # at most one row per key (e.g. per day)
        )
        if not first:
            return out.select(key, rid, ts, (F.col("_cost") / F.lit(scale)).cast("decimal(28,9)").alias(cost),
                              F.col("cand").alias("admitted"), (F.col("spent_before") / F.lit(scale)).cast("decimal(28,9)").alias("spent_before"))
        for r in first:
            rules.setdefault(r["_key"], []).append((int(r["_t"]), int(r[rid]), bud - int(r["spent_before"]) + 1))


def session_starts(events: DataFrame, key: str, gap_seconds: int, ts: str = "ts", rid: str = "event_id",
                   n_parts: int | None = None) -> DataFrame:
    """Every event with ``session_start_us`` (micros) of its inactivity session, as an ordered scan.

    Events without a time take no part in the scan: their session start is null.
    """
    x = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    untimed = events.where(F.col(ts).isNull()).withColumn("session_start_us", F.lit(None).cast("long"))
    s = ordered_partitions(x.where(F.col("_t").isNotNull()), key, ["_t", rid], n_parts)
    keep = [c for c in x.columns]
    kernel = SessionKernel("_t", gap_seconds * 1_000_000, keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*keep).schema.fields)
    return run_scan(s, key, kernel, f"{schema}, session_start_us long").drop("_t").unionByName(untimed)


def lag_scan(df: DataFrame, key: str, order: list[str], col: str, out: str = "prev", default=None,
             n_parts: int | None = None) -> DataFrame:
    """``lag(col)`` per key in ``order`` as an ordered scan: a key with a huge share of rows is split."""
    s = ordered_partitions(df, key, order, n_parts)
    keep = list(df.columns)
    kernel = LagKernel(col, out, default, keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*keep).schema.fields)
    return run_scan(s, key, kernel, f"{schema}, {out} {s.schema[col].dataType.simpleString()}")
