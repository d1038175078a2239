"""Robust local regression of samples that are too long for one task.

A sample's points are ranked and cut into chunks, one row with arrays each; points are
shuffled for that once. Anchors (places where the line is fitted, about ``1 / delta`` of
them) come from an ordered scan of the times. From then on chunks stay where they are:
each pass joins them with their sample's state (anchors, windows, last fit and scale),
adds what a chunk contributes to each anchor's weighted sums, and makes the next state
of these sums. Robustness weights are not stored but follow from the last fit and scale.
The scale, a median of residuals, is found by counting in ever finer bins.

Agrees with ``kernels.lowess`` but for rounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from .kernels import bisquare, tricube
from .ordering import numbered

CHUNK, BINS, FEW = 1 << 14, 512, 2000
_SUMS = "sample {kind}, anchor int, w double, wu double, wy double, wuu double, wuy double"


def window_size(n: int, frac: float) -> int:
    return min(n, max(2, int(frac * n + 1e-10)))


def _chunks(points: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(sample, chunk, first, x, y): points in order of time, ranks from ``first`` on."""
    ranked = numbered(points.select("sample", "x", "y"), "sample", "x", "y", within=("sample",), name="rank", scratch=scratch)
    ranked = ranked.withColumn("rank", F.col("rank") - 1).withColumn("chunk", F.expr(f"rank div {size}"))
    got = ranked.groupBy("sample", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("p"))
    return scratch.table(got.select("sample", "chunk", F.col("p")[0]["rank"].alias("first"), F.col("p.x").alias("x"), F.col("p.y").alias("y")), "chunks")


def _rows(batches):
    """Rows as dicts, arrays as numpy."""
    for batch in batches:
        columns = [batch.column(c) for c in batch.schema.names]
        for i in range(batch.num_rows):
            yield {n: c[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) and c[i].is_valid else c[i].as_py() for n, c in zip(batch.schema.names, columns)}


def _scan(batches):
    """Anchors of each sample from its chunks in order: from one on, the last point within delta, or else the next point."""
    key, found, last, pending, delta = object(), [], None, None, 0.0

    def closed():
        if pending is not None and pending[0] > last[0] and pending[1] > found[-1][1]:
            found.append(pending)
        return {"sample": [key], "ar": [[a[0] for a in found]], "ax": [[a[1] for a in found]], "ay": [[a[2] for a in found]]}

    done = []
    for r in _rows(batches):
        x, y, first = r["x"], r["y"], r["first"]
        if r["sample"] != key:
            if found:
                done.append(closed())
            key, delta = r["sample"], r["delta"]
            found, last, pending = [(0, float(x[0]), float(y[0]))], (0, float(x[0])), None
        at = max(0, last[0] + 1 - first)
        while at < len(x):
            inside = int(np.searchsorted(x, last[1] + delta, "right"))
            if inside >= len(x):
                pending = (first + len(x) - 1, float(x[-1]), float(y[-1]))
                break
            if inside > at:
                nxt = (first + inside - 1, float(x[inside - 1]), float(y[inside - 1]))
            elif pending is not None and pending[0] > last[0]:
                nxt = pending
            else:
                nxt = (first + at, float(x[at]), float(y[at]))
            if nxt[1] > found[-1][1]:
                found.append(nxt)
            last, pending = nxt[:2], None
            at = max(at, nxt[0] + 1 - first)
    if found:
        done.append(closed())
    for d in done:
        yield pa.RecordBatch.from_pydict({"sample": d["sample"], "ar": pa.array(d["ar"], pa.list_(pa.int64())), "ax": pa.array(d["ax"], pa.list_(pa.float64())), "ay": pa.array(d["ay"], pa.list_(pa.float64()))})


def _lefts(batches):
    """How many l a pair of chunks has, for each anchor, with x[l] + x[l + k] under twice the anchor's time."""
    for r in _rows(batches):
        lo = max(r["first"], r["other_first"] - r["k"])
        hi = min(r["first"] + len(r["x"]), r["other_first"] + len(r["other"]) - r["k"])
        if lo < hi:
            s = r["x"][lo - r["first"] : hi - r["first"]] + r["other"][lo + r["k"] - r["other_first"] : hi + r["k"] - r["other_first"]]
            count = np.searchsorted(s, 2 * r["ax"], "left")
            yield pa.RecordBatch.from_pydict({"sample": [r["sample"]] * len(count), "anchor": pa.array(np.arange(len(count)), pa.int32()), "n": pa.array(count, pa.int64())})


def _ends(batches):
    """The times at both ends of each anchor's window, from the chunks that hold them."""
    for r in _rows(batches):
        for rank in (r["left"], r["left"] + r["k"] - 1):
            own = np.flatnonzero((rank >= r["first"]) & (rank < r["first"] + len(r["x"])))
            if len(own):
                gap = np.abs(r["x"][rank[own] - r["first"]] - r["ax"][own])
                yield pa.RecordBatch.from_pydict({"sample": [r["sample"]] * len(own), "anchor": pa.array(own, pa.int32()), "gap": pa.array(gap)})


def _residuals(r: dict) -> np.ndarray:
    return np.abs(r["y"] - np.interp(r["x"], r["ax"], r["fit"]))


def _sums(batches):
    """What each chunk adds to its anchors' weighted sums; distances are taken from the anchor."""
    for r in _rows(batches):
        robust = np.ones(len(r["x"])) if r["scale"] is None else bisquare(_residuals(r) / (6 * r["scale"]))
        lo, hi = np.maximum(r["left"] - r["first"], 0), np.minimum(r["left"] + r["k"] - r["first"], len(r["x"]))
        own = np.flatnonzero(lo < hi)
        if not len(own):
            continue
        out = np.empty((len(own), 5))
        for i, a in enumerate(own):
            part = slice(lo[a], hi[a])
            u, y = r["x"][part] - r["ax"][a], r["y"][part]
            w = tricube(np.abs(u) / max(r["reach"][a], 1e-300)) * robust[part]
            out[i] = w.sum(), w @ u, w @ y, w @ (u * u), w @ (u * y)
        yield pa.RecordBatch.from_arrays([pa.array([r["sample"]] * len(own)), pa.array(own, pa.int32()), *(pa.array(c) for c in out.T)], ["sample", "anchor", "w", "wu", "wy", "wuu", "wuy"])


def _fitted(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The sample's state with the lines' values at its anchors."""
    s, row = sums.set_index("anchor").sort_index(), state.iloc[0]
    w, safe = s["w"].to_numpy(), np.where(s["w"] > 0, s["w"], 1)
    um, ym = s["wu"].to_numpy() / safe, s["wy"].to_numpy() / safe
    suu, suy = s["wuu"].to_numpy() / safe - um**2, s["wuy"].to_numpy() / safe - um * ym
    line = np.sqrt(np.maximum(suu, 0)) > 0.001 * row["span"]
    value = np.where(line, ym - np.where(line, suy, 0) / np.where(line, suu, 1) * um, ym)
    return state.assign(fit=[np.where(w > 0, value, row["ay"]).tolist()])


def _counts(batches):
    """Residuals of a chunk by bins of the sample's bracket, or the residuals themselves once they are few."""
    for r in _rows(batches):
        e = _residuals(r)
        if r["lo"] is None:  # the bracket is not known yet
            yield pa.RecordBatch.from_pydict({"sample": [r["sample"]], "bin": pa.array([0], pa.int32()), "n": pa.array([len(e)], pa.int64()), "least": [float(e.min())], "most": [float(e.max())]})
            continue
        e = np.sort(e[(e >= r["lo"]) & (e <= r["hi"])])
        if not len(e):
            continue
        if r["inside"] <= FEW:
            yield pa.RecordBatch.from_pydict({"sample": [r["sample"]] * len(e), "bin": pa.array(np.arange(len(e)), pa.int32()), "n": pa.array(np.ones(len(e)), pa.int64()), "least": pa.array(e), "most": pa.array(e)})
        else:
            bin_of = np.minimum(((e - r["lo"]) * (BINS / (r["hi"] - r["lo"]))).astype(np.int64), BINS - 1)
            kinds, at, n = np.unique(bin_of, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"sample": [r["sample"]] * len(kinds), "bin": pa.array(kinds, pa.int32()), "n": pa.array(n, pa.int64()), "least": pa.array(e[at]), "most": pa.array(e[np.append(at[1:], len(e)) - 1])})


def narrowed(groups: pd.DataFrame, below: int, want: tuple[int, int]) -> tuple[float, float, int, int]:
    """Bracket (lo, hi, residuals below, residuals inside) of the groups that hold the wanted ranks (from 0)."""
    g = groups.sort_values(["least", "most"], kind="stable")
    upto = below + g["n"].cumsum().to_numpy()
    a, b = (int(np.searchsorted(upto, r, "right")) for r in want)
    return float(g["least"].iloc[a]), float(g["most"].iloc[b]), int(upto[a] - g["n"].iloc[a]), int(upto[b] - upto[a] + g["n"].iloc[a])


def _medians(chunks: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """(sample, scale): exact medians of absolute residuals."""
    kind = chunks.schema["sample"].dataType.simpleString()
    bracket = state.select("sample", "n", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("inside"), F.lit(None).cast("double").alias("scale"))
    while True:
        open_ = bracket.where("scale IS NULL")
        rows = chunks.join(F.broadcast(open_.select("sample", "lo", "hi", "inside")), "sample").join(F.broadcast(state.select("sample", "ax", "fit")), "sample")
        counted = rows.mapInArrow(_counts, f"sample {kind}, bin int, n long, least double, most double")

        def pick(groups: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            row = old.iloc[0].copy()
            want = ((int(row["n"]) - 1) // 2, int(row["n"]) // 2)
            exact = row["inside"] is not None and not pd.isna(row["inside"]) and row["inside"] <= FEW
            if exact:
                values = np.sort(groups["least"].to_numpy())
                return old.assign(scale=[float((values[want[0] - int(row["below"])] + values[want[1] - int(row["below"])]) / 2)])
            if pd.isna(row["lo"]):
                lo, hi, below, inside = float(groups["least"].min()), float(groups["most"].max()), 0, int(groups["n"].sum())
            else:
                merged = groups.groupby("bin").agg(n=("n", "sum"), least=("least", "min"), most=("most", "max"))
                lo, hi, below, inside = narrowed(merged, int(row["below"]), want)
            return old.assign(lo=[lo], hi=[hi], below=[below], inside=[inside], scale=[lo if lo == hi else np.nan])

        got = counted.groupBy("sample").cogroup(open_.groupBy("sample")).applyInPandas(pick, f"sample {kind}, n long, lo double, hi double, below long, inside long, scale double")
        got = got.withColumn("scale", F.when(~F.isnan("scale"), F.col("scale")))
        bracket = scratch.table(bracket.where("scale IS NOT NULL").unionByName(got), "bracket")
        if bracket.where("scale IS NULL").isEmpty():
            return bracket.select("sample", "scale")


_STATE = "sample {kind}, n long, k long, span double, ar array<long>, ax array<double>, ay array<double>, left array<long>, reach array<double>, fit array<double>, scale double, done boolean"


def fit_anchors(points: DataFrame, frac: float = 0.3, rounds: int = 3, delta: float = 0.01, size: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """(sample, ax, fit): times and values of the anchors of each sample's curve; linear between them. ``points``: sample, x, y."""
    scratch = scratch or Scratch(points.sparkSession, "lowess")
    kind = points.schema["sample"].dataType.simpleString()
    chunks = _chunks(points, scratch, size)
    whole = chunks.groupBy("sample").agg(F.sum(F.size("x")).alias("n"), F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    whole = scratch.table(whole.select("sample", "n", (F.col("hi") - F.col("lo")).alias("span")), "samples")
    steps = chunks.join(F.broadcast(whole.select("sample", (F.col("span") * delta).alias("delta"))), "sample")
    anchors = steps.repartition("sample").sortWithinPartitions("sample", "chunk").mapInArrow(_scan, f"sample {kind}, ar array<long>, ax array<double>, ay array<double>")
    k = F.least("n", F.greatest(F.lit(2), F.floor(frac * F.col("n") + 1e-10)))
    state = scratch.table(anchors.join(whole, "sample").withColumn("k", k.cast("long")), "anchors")

    def by_anchor(rows: DataFrame, value: str) -> DataFrame:
        """(sample, array over anchors)."""
        return rows.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor", value))), lambda s: s[value]).alias(value))

    wide = chunks.join(F.broadcast(state.select("sample", "k", "ax")), "sample")
    partner = F.expr(f"(first + k) div {size}")
    pairs = wide.select("sample", "k", "ax", "first", "x", F.explode(F.array(partner, partner + 1)).alias("want")).join(chunks.select("sample", F.col("chunk").alias("want"), F.col("first").alias("other_first"), F.col("x").alias("other")), ["sample", "want"])
    counted = pairs.mapInArrow(_lefts, f"sample {kind}, anchor int, n long").groupBy("sample", "anchor").agg(F.sum("n").alias("left"))
    state = state.join(by_anchor(counted, "left"), "sample", "left")
    none = F.transform("ax", lambda _: F.lit(0).cast("long"))
    state = scratch.table(state.withColumn("left", F.transform(F.coalesce("left", none), lambda v: F.least(v, F.col("n") - F.col("k")))), "windows")
    ends = chunks.join(F.broadcast(state.select("sample", "k", "ax", "left")), "sample").mapInArrow(_ends, f"sample {kind}, anchor int, gap double").groupBy("sample", "anchor").agg(F.max("gap").alias("reach"))
    state = state.join(by_anchor(ends, "reach"), "sample").withColumns({"fit": F.lit(None).cast("array<double>"), "scale": F.lit(None).cast("double"), "done": F.lit(False)})
    order = [c.split()[0] for c in _STATE.format(kind=kind).split(", ")]
    state = scratch.table(state.select(*order), "state")
    for sweep in range(rounds + 1):
        open_ = state.where("NOT done")
        rows = chunks.join(F.broadcast(open_.select("sample", "k", "ax", "left", "reach", "fit", "scale")), "sample")
        sums = rows.mapInArrow(_sums, _SUMS.format(kind=kind)).groupBy("sample", "anchor").agg(*[F.sum(c).alias(c) for c in ("w", "wu", "wy", "wuu", "wuy")])
        fitted = sums.groupBy("sample").cogroup(open_.groupBy("sample")).applyInPandas(_fitted, _STATE.format(kind=kind))
        state = scratch.table(state.where("done").unionByName(fitted), "fits")
        if sweep < rounds:
            scales = _medians(chunks, state.where("NOT done"), scratch)
            renewed = state.where("NOT done").drop("scale").join(scales, "sample").withColumn("done", F.col("scale") <= 0).select(*order)
            state = scratch.table(state.where("done").unionByName(renewed), "scaled")
            if state.where("NOT done").isEmpty():
                break
    return scratch.keep(state.select("sample", "n", "ax", "fit"), "curves")


def grid_values(anchors: DataFrame, grid: np.ndarray) -> DataFrame:
    """(sample, i, rt, fit) on a grid; null outside the anchors."""
    kind = anchors.schema["sample"].dataType.simpleString()

    def evaluated(batches):
        for r in _rows(batches):
            fit = np.where((grid >= r["ax"][0]) & (grid <= r["ax"][-1]), np.interp(grid, r["ax"], r["fit"]), np.nan)
            yield pa.RecordBatch.from_pydict({"sample": [r["sample"]] * len(grid), "i": pa.array(np.arange(len(grid)), pa.int32()), "rt": pa.array(grid), "fit": pa.array(fit)})

    return anchors.select("sample", "ax", "fit").mapInArrow(evaluated, f"sample {kind}, i int, rt double, fit double")
