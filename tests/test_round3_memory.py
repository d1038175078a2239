"""Findings of the third round: memory of one task."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import density, outputs, rollup
from quantloom.sources import spectral


def _nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _consensus(x: np.ndarray, regularization: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = x - np.nanmedian(x, axis=1, keepdims=True)
    residual = c - np.nanmedian(c, axis=0)
    variance = np.nanvar(residual, axis=1)
    raw = np.where(np.isnan(x), np.nan, 1 / (variance[:, None] + regularization))
    return residual, variance, raw * (~np.isnan(x)).sum(0) / np.nansum(raw, axis=0)


def test_consensus_sorts_transitions_not_cells(spark):
    rng = np.random.default_rng(13)
    seen = {f: np.where(rng.random((2 + f % 4, 5)) < 0.2 * (f % 2), np.nan, np.round(rng.normal(20, 2, (2 + f % 4, 5)), 3)) for f in range(12)}
    names = [f"S{s}" for s in range(5)]
    long = [(f, t, names[s], float(x[t, s])) for f, x in seen.items() for t in range(len(x)) for s in range(5) if not np.isnan(x[t, s])]
    rows = [(f, t, [float(v) for v in x[t]]) for f, x in seen.items() if f % 2 == 0 for t in range(len(x))]
    long_df = spark.createDataFrame(long, "feature int, transition int, sample string, x double").repartition(3)
    rows_df = spark.createDataFrame(rows, "feature int, transition int, xs array<double>").repartition(3)
    for m, samples, features in ((long_df, None, range(12)), (rows_df, names, range(0, 12, 2))):
        cells, rolled = rollup.consensus_cells(m, samples=samples), rollup.rollup_consensus(m, samples=samples)
        assert "Window" not in _nodes(cells) and "Window" not in _nodes(rolled)
        got = {(r.feature, r.transition, r["sample"]): r for r in cells.collect()}
        sums = {(r.feature, r["sample"]): r for r in rolled.collect()}
        assert len(got) == sum(int((~np.isnan(seen[f])).sum()) for f in features)
        for f in features:
            x = seen[f]
            residual, variance, weight = _consensus(x)
            for t, s in zip(*np.nonzero(~np.isnan(x))):
                r = got[f, t, names[s]]
                assert np.allclose([r.x, r.residual, r.variance, r.weight], [x[t, s], residual[t, s], variance[t], weight[t, s]], rtol=1e-9, atol=1e-12)
            for s in np.flatnonzero((~np.isnan(x)).any(0)):
                r = sums[f, names[s]]
                assert r.n_transitions == (~np.isnan(x[:, s])).sum() and np.isclose(r.value, np.log2(max(1, np.nansum(weight[:, s] * 2 ** x[:, s]))))
                assert np.isclose(r.uncertainty, np.nanstd(residual[:, s]), atol=1e-12)


def test_consensus_keeps_a_cell_without_a_value(spark):
    m = spark.createDataFrame([(1, 1, "S0", 3.0), (1, 1, "S1", 5.0), (1, 2, "S0", None), (1, 2, "S1", 4.0)], "feature int, transition int, sample string, x double")
    got = {(r.transition, r["sample"]): r for r in rollup.consensus_cells(m).collect()}
    assert len(got) == 4 and got[2, "S0"].residual is None and got[2, "S0"].weight is not None
    assert {r["sample"]: r.n_transitions for r in rollup.rollup_consensus(m).collect()} == {"S0": 2, "S1": 2}


def test_rows_of_the_matrix_hold_its_cells(spark):
    cells = spark.createDataFrame([(1, 1, "S0", 8.0), (1, 1, "S1", 0.0), (1, 2, "S1", 4.0), (2, 1, "S0", None)], "feature int, transition int, sample string, area double")
    names = ["S0", "S1", "S2"]
    want = {(r.feature, r.transition, r["sample"]): r.x for r in rollup.matrix(cells, names).collect()}
    got = {(r.feature, r.transition, s): x for r in rollup.matrix_rows(cells, names).collect() for s, x in zip(names, r.xs)}
    assert got == want and len(got) == 9


def test_display_grid_makes_no_pair_of_row_and_window(spark):
    rng = np.random.default_rng(16)
    edges = [(float(a), float(a + w)) for a, w in zip(np.round(rng.uniform(-30, 130, 400), 1), np.round(rng.uniform(0, 3, 400) ** 4, 1))]
    edges += [(0.125, 0.375), (0.125, 0.3750001), (50.0, 50.1), (99.875, 500.0), (-7.0, 0.125), (3.0, 3.0), (4.0, 2.0), (-1e9, 1e9)]
    edges += [(40.0, 42.0), (41.0, 43.0)]  # equal widths: the smaller window
    scheme = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(edges)] + [(999, None, 5.0), (998, 5.0, None)], "window int, lo double, hi double")
    got = density.display_grid(scheme, 400, 0.0, 100.0)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in range(400):
        held = [(hi - lo, i) for i, (lo, hi) in enumerate(edges) if lo <= (r + 0.5) * 0.25 < hi]
        if held:
            want[r] = min(held)[1]
    assert {r.row: r.window for r in got.collect()} == want and len(want) == 400


def test_one_task_writes_a_library_without_sorting_it(spark, tmp_path, monkeypatch):
    rows = [(f"P{k % 37:02d}", 1 + k % 3, float(k % 37), 100.0 + k, float(k % 11)) for k in range(900)]
    df = spark.createDataFrame(rows, "feature string, charge int, rt double, mz double, intensity double").repartition(7)

    def repartition(self, n, *columns):
        raise AssertionError(f"all spectra dealt to {n} partitions")

    monkeypatch.setattr(type(df), "repartition", repartition)
    path = str(tmp_path / "many.blib")
    spectral.write_library_sqlite(df, path)
    with sqlite3.connect(path) as db:
        got = db.execute("SELECT r.id, peptideSeq, precursorCharge, retentionTime, numPeaks, peakMZ, peakIntensity FROM RefSpectra r JOIN RefSpectraPeaks ON RefSpectraID = r.id ORDER BY r.id").fetchall()
        assert db.execute("SELECT count(*) FROM RefSpectraPeaks").fetchone() == (111,) and db.execute("PRAGMA index_list(RefSpectraPeaks)").fetchall()
    want = {}
    for feature, charge, rt, mz, intensity in rows:
        want.setdefault((feature, charge, rt), []).append((mz, intensity))
    assert [r[:5] for r in got] == [(i + 1, *k, len(want[k])) for i, k in enumerate(sorted(want))]
    for _, *key, _, mz, intensity in got:
        assert list(zip(spectral.packed(mz, "<f8"), spectral.packed(intensity, "<f4"))) == sorted(want[tuple(key)])


def test_weights_from_rows_equal_those_from_cells_and_no_write_sorts_by_tag(spark, tmp_path):
    rng = np.random.default_rng(24)
    names = ["S0", "S1", "S2", "S3"]
    x = {(f, t): [None if v < 0.15 else float(np.round(8 + 9 * v, 3)) for v in rng.random(4)] for f in range(9) for t in range(1 + f % 4)}
    x |= {(20, 0): [None, None, None, 9.0], (21, 0): [None] * 4}
    rows = spark.createDataFrame([(f, t, v) for (f, t), v in x.items()], "feature int, transition int, xs array<double>").repartition(3)
    cells = spark.createDataFrame([(f, t, s, v) for (f, t), vs in x.items() for s, v in zip(names, vs)], "feature int, transition int, sample string, x double").repartition(3)
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    found = []
    for name, m, samples in (("rows", rows, names), ("cells", cells, None)):
        path = str(tmp_path / name)
        outputs.write_outputs(outputs.rollup_outputs(m, "feature", "transition", "quality_weighted", samples=samples), path)
        found.append([sorted(map(tuple, outputs.read_output(spark, path, o, "feature", "transition").collect())) for o in ("values", "weights")])
    assert found[0] == found[1] and len(found[0][1]) == sum(v is not None for vs in x.values() for v in vs)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting
    status = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [status.apply(i).physicalPlanDescription() for i in range(status.size())]
    written = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and str(tmp_path / "rows") in p]
    assert written and all("Sort " not in p and "Sort (" not in p for p in written)
    with pytest.raises(ValueError, match="long cells"):
        outputs.rollup_outputs(rows, "feature", "transition", "topn", samples=names)
