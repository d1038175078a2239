"""Numpy kernels for single small matrices and curves, and the grouped maps that run them."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _median(x: np.ndarray, axis: int) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nan_to_num(np.nanmedian(x, axis=axis))


def median_polish(x: np.ndarray, max_sweeps: int = 20, tolerance: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Overall, row and column effects and residuals; overall + row + column + residual is x on every seen cell."""
    resid, overall = x.astype(float).copy(), 0.0
    rows, cols = np.zeros(x.shape[0]), np.zeros(x.shape[1])
    for _ in range(max_sweeps):
        before = resid.copy()
        d = _median(resid, 1)
        resid -= d[:, None]
        rows += d
        shift = float(np.median(cols))
        cols -= shift
        overall += shift
        e = _median(resid, 0)
        resid -= e
        cols += e
        shift = float(np.median(rows))
        rows -= shift
        overall += shift
        change = np.abs(resid - before)
        if not np.isfinite(change).any() or np.nanmax(change) < tolerance:
            break
    return overall, rows, cols, resid


#: Rows of cells that a task gathers before it works on the keys among them.
GATHER = 500_000


def _middle(x: np.ndarray, axis: int) -> np.ndarray:
    """Medians over one axis of a stack of matrices, NaN left out; 0 where nothing is seen."""
    n = (~np.isnan(x)).sum(axis)
    order = np.sort(x, axis=axis)  # NaN last
    at = lambda k: np.take_along_axis(order, np.expand_dims(k, axis), axis).squeeze(axis)
    return np.where(n > 0, (at(np.maximum(n - 1, 0) // 2) + at(np.minimum(n // 2, np.maximum(n - 1, 0)))) / 2, 0.0)


def median_polish_stack(x: np.ndarray, max_sweeps: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``median_polish`` of many matrices of one shape at once (matrix, row, column); each stops by itself."""
    resid = x.astype(float).copy()
    overall, rows, cols = np.zeros(len(x)), np.zeros(x.shape[:2]), np.zeros((len(x), x.shape[2]))
    live = np.arange(len(x))
    for _ in range(max_sweeps):
        r = resid if len(live) == len(x) else resid[live]
        d = _middle(r, 2)
        after = r - d[:, :, None]
        shift = np.median(cols[live], axis=1)
        cols[live] -= shift[:, None]
        e = _middle(after, 1)
        after -= e[:, None, :]
        rows[live] += d
        cols[live] += e
        level = np.median(rows[live], axis=1)
        rows[live] -= level[:, None]
        overall[live] += shift + level
        change = np.fmax.reduce(np.abs(after - r).reshape(len(live), -1), axis=1)
        if len(live) == len(x):
            resid = after
        else:
            resid[live] = after
        live = live[change >= tolerance]  # false where nothing is seen
        if not len(live):
            break
    return overall, rows, cols, resid


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ranks of a column's values and the sorted values."""
    d = column.combine_chunks().dictionary_encode("encode")
    order = pc.sort_indices(d.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[d.indices.to_numpy()], d.dictionary.take(order)  # codes of a null come last, as its place in the order


def _places(owner: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell's place among the distinct codes of its owner, how many an owner has, and all codes by owner and place."""
    distinct, at = np.unique(owner * width + code, return_inverse=True)
    count = np.bincount(distinct // width)
    first = np.cumsum(count) - count
    return at - first[owner], count, distinct % width


def _whole_keys(batches, key: str):
    """Tables of whole keys, ``GATHER`` rows or more (a longer key makes a longer table), of batches that are sorted by key."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < GATHER:
            continue
        last = batch.column(key)
        code = last.dictionary_encode("encode").indices.to_numpy()
        other = np.flatnonzero(code != code[-1])
        if len(other):  # the last key of this batch begins here
            cut = int(other[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        n = sum(b.num_rows for b in held) if len(other) else n
    if held:
        yield pa.Table.from_batches(held)


def matrices(batches, key: str, row: str, value: str = "x"):
    """Stacks (table of the stack's cells, keys, rows, samples, x, place of a key's first cell) of matrices of one shape.

    Cells are rows (key, row, sample, value) sorted by key. ``keys`` are one value a matrix, ``rows`` and
    ``samples`` one for each place of it in their order; of repeated cells the first that is not null counts.
    """
    for t in _whole_keys(batches, key):
        code = t[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        owner = np.r_[0, np.cumsum(np.diff(code) != 0)]
        rank, names = _codes(t[row])
        r, n_rows, row_codes = _places(owner, rank, len(names))
        rank, samples = _codes(t["sample"])
        c, n_cols, col_codes = _places(owner, rank, len(samples))
        first_row, first_col = np.cumsum(n_rows) - n_rows, np.cumsum(n_cols) - n_cols
        start = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        x = t[value].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        for shape in np.unique(np.stack([n_rows, n_cols], 1), axis=0):
            of = np.flatnonzero((n_rows == shape[0]) & (n_cols == shape[1]))
            place = np.full(len(start), -1)
            place[of] = np.arange(len(of))
            mine = np.flatnonzero((place[owner] >= 0) & ~np.isnan(x))[::-1]  # the first cell is written last
            stack = np.full((len(of), *shape), np.nan)
            stack[place[owner[mine]], r[mine], c[mine]] = x[mine]
            cells = np.flatnonzero(place[owner] >= 0)
            at = (cells, place[owner[cells]], r[cells], c[cells])
            yield t, t[key].combine_chunks().take(pa.array(start[of])), names.take(pa.array(row_codes[first_row[of][:, None] + np.arange(shape[0])].ravel())), samples.take(pa.array(col_codes[first_col[of][:, None] + np.arange(shape[1])].ravel())), stack, at


def sorted_cells(m: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns and ``_place``, all rows of a key in one partition and next to one another.

    A window asks for whole keys. A repartition by the keys of a join before it is left out of the plan,
    and adaptive execution may then read the join's rows as they lie, a key's in many tasks.
    """
    return m.select(key, *columns).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(key)))


def _spread(resid: np.ndarray) -> np.ndarray:
    """Root of the mean variance of the rows of each matrix."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.sqrt(np.nanmean(np.nanvar(resid, axis=2), axis=1))


def repeated(column: pa.Array, times: int) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(column)), times)))


def median_polish_frames(m: DataFrame, key: str, row: str, max_sweeps: int, tolerance: float, log_count: bool) -> DataFrame:
    """(key, sample, value, uncertainty, n_rows) of each key's row x sample matrix; matrices of one shape are polished together."""
    kind = m.schema[key].dataType.simpleString()

    def polished(batches):
        for _, keys, _, samples, x, _ in matrices(batches, key, row):
            overall, _, cols, resid = median_polish_stack(x, max_sweeps, tolerance)
            n = x.shape[1]
            value = overall[:, None] + cols + (np.log2(n) if log_count else 0.0)
            value[np.isnan(x).all(1)] = np.nan
            yield from pa.table({key: repeated(keys, x.shape[2]), "sample": samples, "value": value.ravel(), "uncertainty": np.repeat(_spread(resid), x.shape[2]), "n_rows": pa.array(np.full(value.size, n), pa.int32())}).to_batches(1 << 16)

    return sorted_cells(m, key, row, "sample", "x").mapInArrow(polished, f"{key} {kind}, sample string, value double, uncertainty double, n_rows int")


def median_polish_residuals(m: DataFrame, key: str, row: str, max_sweeps: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Long residuals (key, row, sample, residual, row_effect, column_effect, overall)."""
    kind, row_kind = m.schema[key].dataType.simpleString(), m.schema[row].dataType.simpleString()

    def polished(batches):
        for _, keys, names, samples, x, _ in matrices(batches, key, row):
            overall, rows, cols, resid = median_polish_stack(x, max_sweeps, tolerance)
            k, r, c = np.nonzero(~np.isnan(resid))
            for lo in range(0, len(k), 1 << 16):
                a, b, d = k[lo : lo + (1 << 16)], r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                yield from pa.table({key: keys.take(pa.array(a)), row: names.take(pa.array(a * x.shape[1] + b)), "sample": samples.take(pa.array(a * x.shape[2] + d)), "residual": resid[a, b, d], "row_effect": rows[a, b], "column_effect": cols[a, d], "overall": overall[a]}).to_batches()

    return sorted_cells(m, key, row, "sample", "x").mapInArrow(polished, f"{key} {kind}, {row} {row_kind}, sample string, residual double, row_effect double, column_effect double, overall double")


def tricube(ratio: np.ndarray) -> np.ndarray:
    """Weights by distance, as a share of the window's reach."""
    return np.where(ratio < 0.999, np.where(ratio <= 0.001, 1.0, (1 - ratio**3) ** 3), 0.0)


def bisquare(u: np.ndarray) -> np.ndarray:
    """Weights by residual, as a share of six scales."""
    return np.where(u <= 0.001, 1.0, np.where(u < 0.999, (1 - u**2) ** 2, 0.0))


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.3, rounds: int = 3, delta: float = 0.0) -> np.ndarray:
    """Robust locally weighted line at each point of sorted x.

    Points nearer than ``delta`` to the last fitted one are interpolated; points of one
    time share a fit. Anchors are fitted together: their windows are rows of one
    matrix, in blocks.
    """
    n = len(x)
    k = min(n, max(2, int(frac * n + 1e-10)))
    anchors = [0]
    while anchors[-1] < n - 1:
        last = anchors[-1]
        nxt = max(last + 1, int(np.searchsorted(x, x[last] + delta, "right")) - 1) if delta > 0 else last + 1
        anchors.append(min(nxt, n - 1))
    at = np.array(anchors)
    at = at[np.r_[True, np.diff(x[at]) > 0]]
    left = np.clip(at - k // 2, 0, n - k)
    # the k nearest neighbours of sorted points are a run: move it while the far end is nearer
    moving = True
    while moving:
        right = left + k
        go = (right < n) & (x[at] - x[left] > x[np.minimum(right, n - 1)] - x[at])
        back = ~go & (left > 0) & (x[np.minimum(right - 1, n - 1)] - x[at] > x[at] - x[np.maximum(left - 1, 0)])
        moving = bool(go.any() or back.any())
        left = left + go - back
    robust = np.ones(n)
    fit = np.zeros(n)
    block = max(1, 4_000_000 // k)
    for sweep in range(rounds + 1):
        value = np.empty(len(at))
        for lo in range(0, len(at), block):
            a, idx = at[lo : lo + block], left[lo : lo + block, None] + np.arange(k)
            xs, ys = x[idx], y[idx]
            dist = np.abs(xs - x[a][:, None])
            reach = np.maximum(dist.max(1), 1e-300)[:, None]
            ratio = dist / reach
            w = tricube(ratio) * robust[idx]
            total = w.sum(1)
            safe = np.where(total > 0, total, 1)
            xm, ym = (w * xs).sum(1) / safe, (w * ys).sum(1) / safe
            sxx = (w * (xs - xm[:, None]) ** 2).sum(1) / safe
            sxy = (w * (xs - xm[:, None]) * (ys - ym[:, None])).sum(1) / safe
            line = np.sqrt(sxx) > 0.001 * (x[-1] - x[0])
            v = np.where(line, ym + np.where(line, sxy, 0) / np.where(line, sxx, 1) * (x[a] - xm), ym)
            value[lo : lo + block] = np.where(total > 0, v, y[a])
        fit = np.interp(x, x[at], value)
        if sweep == rounds:
            break
        resid = np.abs(y - fit)
        scale = np.median(resid)
        if scale <= 0:
            break
        robust = bisquare(resid / (6 * scale))
    return fit


def principal_scores(gram: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Scores of samples on the first n components and their explained shares, from the centred Gram matrix."""
    c = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean()
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(values)[::-1][:n]
    kept = np.maximum(values[order], 0)
    return vectors[:, order] * np.sqrt(kept), kept / max(values[values > 0].sum(), 1e-300)
