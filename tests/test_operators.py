"""Operators that SQL cannot follow, and their edges, against plain numpy or made cases."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import pipeline
from quantloom.operators import combat as cb
from quantloom.operators import library as lib
from quantloom.operators import normalize as nrm
from quantloom.operators import parsimony as par
from quantloom.operators import qc, rollup, sequence
from quantloom.operators.kernels import lowess
from quantloom.operators.ordering import numbered
from quantloom.sources import formats, reports, spectral


def long(spark, x, names=None, **columns):
    """A matrix as rows (feature, sample, x, ...); columns are lists per sample or per feature."""
    names = names or [f"s{j:02d}" for j in range(x.shape[1])]
    rows = [(i, names[j], None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, "feature long, sample string, x double")
    for name, values in columns.items():
        by = dict(zip(names, values)) if len(values) == len(names) else dict(enumerate(values))
        key = "sample" if len(values) == len(names) else "feature"
        kind = {str: "string", float: "double", bool: "boolean"}[type(values[0])]
        df = df.join(spark.createDataFrame([(k, v) for k, v in by.items()], f"{key} {'string' if key == 'sample' else 'long'}, {name} {kind}"), key)
    return df


def matrix_of(df, names):
    wide = {(r.feature, r["sample"]): r.x for r in df.collect()}
    features = sorted({f for f, _ in wide})
    return np.array([[np.nan if wide[f, s] is None else wide[f, s] for s in names] for f in features], float)


def slow_lowess(x, y, frac, rounds, delta):
    """Point by point: nearest k, tricube weights, weighted line, bisquare rounds; skipped points interpolated."""
    n = len(x)
    k = min(n, max(2, int(frac * n + 1e-10)))
    robust, fit = np.ones(n), np.zeros(n)
    for sweep in range(rounds + 1):
        anchors, values, i = [], [], 0
        while True:
            near = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
            reach = np.abs(x[near] - x[i]).max()
            u = np.abs(x - x[i]) / reach
            w = np.where(u <= 0.001, 1, np.where(u < 0.999, (1 - u**3) ** 3, 0)) * robust
            keep = np.zeros(n, bool)
            keep[near] = True
            w = np.where(keep, w, 0)
            m, c = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            sxx = (w * (x - m) ** 2).sum() / w.sum()
            anchors.append(i)
            values.append(c + ((w * (x - m) * (y - c)).sum() / w.sum() / sxx * (x[i] - m) if np.sqrt(sxx) > 0.001 * (x[-1] - x[0]) else 0))
            if i == n - 1:
                break
            i = min(max(i + 1, int(np.searchsorted(x, x[i] + delta, "right")) - 1), n - 1)
        fit = np.interp(x, x[anchors], values)
        r = np.abs(y - fit)
        s = np.median(r)
        if sweep == rounds or s <= 0:
            return fit
        u = r / (6 * s)
        robust = np.where(u <= 0.001, 1, np.where(u < 0.999, (1 - u**2) ** 2, 0))


@pytest.mark.parametrize("delta", [0.0, 0.2])
def test_lowess_point_by_point(delta):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 150))
    y = np.sin(x) + rng.normal(0, 0.2, 150)
    y[::17] += 4
    assert np.allclose(lowess(x, y, 0.3, 3, delta), slow_lowess(x, y, 0.3, 3, delta), atol=1e-9)


def test_rt_lowess_by_hand(spark):
    rng = np.random.default_rng(4)
    rt = np.sort(rng.uniform(0, 60, 80))
    x = 20 + rng.normal(0, 0.1, (80, 4)) + np.outer(np.sin(rt / 10), [0, 1, 2, 3])
    d = long(spark, x, rt=[float(v) for v in rt])
    got = matrix_of(nrm.rt_lowess_normalize(d), [f"s{j:02d}" for j in range(4)])
    grid = np.linspace(rt[0], rt[-1], 100)
    fits = np.array([np.interp(grid, rt, slow_lowess(rt, x[:, j], 0.3, 3, 0.01 * (rt[-1] - rt[0]))) for j in range(4)])
    want = x - np.array([np.interp(rt, grid, f - np.median(fits, axis=0)) for f in fits]).T
    assert np.allclose(got, want, atol=1e-8)
    assert nrm.rt_lowess_normalize(d.where("false")).count() == 0 and nrm.lowess_curves(d.where("false")).count() == 0


def test_spline_takes_knots_only_where_it_must(spark):
    rng = np.random.default_rng(5)
    rt = np.linspace(0, 100, 400)
    bend = 9 * np.sin(rt / 6)
    x = 20 + rng.normal(0, 0.5, (400, 4))
    x[:, 2:] += bend[:, None]
    kinds, batches = ["reference", "experimental"] * 2, ["A", "A", "B", "B"]
    d = long(spark, x, rt=[float(v) for v in rt], batch=batches, sample_type=kinds)
    stats = spark.createDataFrame([(i, 20.0, float(rt[i])) for i in range(400)], "feature long, mean double, rt double")
    names = [f"s{j:02d}" for j in range(4)]
    got = matrix_of(nrm.rt_spline_correction(d, stats, ["s00", "s02"]), names)
    cubic = np.polyval(np.polyfit(rt, x[:, 0] - 20, 3), rt)
    assert np.allclose(got[:, 0], x[:, 0] - cubic, atol=1e-6) and np.allclose(got[:, 1], x[:, 1] - cubic, atol=1e-6)
    assert ((got[:, 2] - 20) ** 2).sum() <= 400 - 5 < ((x[:, 2] - 20 - np.polyval(np.polyfit(rt, x[:, 2] - 20, 3), rt)) ** 2).sum()
    assert np.abs(got[:, 3] - 20).std() < 1.5
    assert np.allclose(matrix_of(nrm.rt_spline_correction(d, stats, ["s00"]), names)[:, 2:], x[:, 2:])  # no reference: left alone
    assert nrm.rt_spline_correction(d, stats.where("false"), ["s00"]).count() == 1600
    assert nrm.rt_binned_correction(d.where("false"), stats, ["s00"]).count() == 0


def test_older_pipeline_reverts_what_makes_it_worse(spark):
    rng = np.random.default_rng(6)
    rt = np.linspace(0, 50, 60)
    x = 20 + rng.normal(0, 0.05, (60, 8)) + rng.normal(0, 1, (60, 1)) + np.array([0, 0, 0, 0, 2, 2, 2, 2])
    kinds = ["reference", "qc", "experimental", "experimental"] * 2
    d = long(spark, x, rt=[float(v) for v in rt], batch=["A"] * 4 + ["B"] * 4, sample_type=kinds)
    out = nrm.normalize_with_references(d)
    y = matrix_of(out, [f"s{j:02d}" for j in range(8)])
    assert "corrected" in out.columns and abs(y[:, :4].mean() - y[:, 4:].mean()) < 0.2


def test_covariates_are_kept(spark):
    rng = np.random.default_rng(7)
    dose = np.array([0, 1, 2, 3, 0, 1, 2, 3], float)
    x = 15 + rng.normal(0, 0.1, (40, 8)) + np.outer(rng.normal(0, 1, 40), dose) + np.array([0.0] * 4 + [3.0] * 4)
    d = long(spark, x, batch=["A"] * 4 + ["B"] * 4, dose=[float(v) for v in dose])
    names = [f"s{j:02d}" for j in range(8)]
    got = matrix_of(cb.combat_long(d, ["dose"]), names)
    slopes = lambda m: np.polyfit(dose[:4], m[:, :4].T, 1)[0]
    assert np.allclose(slopes(got), slopes(x), atol=0.2) and abs(got[:, :4].mean() - got[:, 4:].mean()) < 0.05
    with pytest.warns(UserWarning, match="confounded"):
        same = cb.combat_long(d.withColumn("dose", (F.col("batch") == "A").cast("double")), ["dose"])
    assert np.isfinite(matrix_of(same, names)).all()


def test_covariates_with_gaps_feature_by_feature(spark):
    """Two numeric covariates and one of names, cells missing at random: each feature by its own least squares."""
    rng = np.random.default_rng(17)
    n, names = 12, [f"s{j:02d}" for j in range(12)]
    batch, c1, c2, sex = ["A"] * 5 + ["B"] * 7, rng.normal(0, 1, n), np.arange(n) % 3.0, ["m", "f"] * 6
    x = rng.normal(20, 1, (60, n))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0, 3:] = np.nan  # fewer cells than columns
    d = long(spark, x, batch=batch, c1=[float(v) for v in c1], c2=[float(v) for v in c2], sex=sex, one=[1.0] * n)
    rest, part = cb.with_covariates(d, ["c1", "c2", "sex", "one"])
    design = np.column_stack([[b == "A" for b in batch], [b == "B" for b in batch], c1, c2, [s == "m" for s in sex]]).astype(float)
    want = np.zeros(x.shape)
    for f, row in enumerate(x):
        seen = ~np.isnan(row)
        if seen.sum() >= 5:
            want[f] = design[:, 2:] @ np.linalg.lstsq(design[seen], row[seen], rcond=None)[0][2:]
    assert np.allclose(matrix_of(part.withColumnRenamed("part", "x"), names), want) and np.allclose(matrix_of(rest, names), x - want, equal_nan=True)
    solvers = {}
    cb.covariate_parts(np.vstack([x, x]), design, 2, solvers)
    assert len(solvers) == len(np.unique(np.isnan(x), axis=0))


def test_correction_edges(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(20, 1, (6, 6))
    x[0] = 17.0  # no variance
    x[1, 3:] = np.nan  # absent from a batch
    d = long(spark, x, batch=["A"] * 3 + ["B"] * 3)
    got = matrix_of(cb.combat(d), [f"s{j:02d}" for j in range(6)])
    assert np.allclose(got[:2], x[:2], equal_nan=True) and not np.allclose(got[2:], x[2:])
    with pytest.raises(ValueError, match="single"):
        cb.combat(d.withColumn("batch", F.when(F.col("sample") == "s00", "C").otherwise(F.col("batch"))))
    fit = d.withColumn("fit", F.col("sample").isin("s00", "s01"))
    with pytest.raises(ValueError, match="no reference"):
        cb.combat_reference_anchored(fit, "error")
    with pytest.raises(ValueError):
        cb.combat_reference_anchored(d.withColumn("fit", F.lit(False)))
    assert cb.correct(d.withColumn("sample_type", F.lit("qc")), {"method": "none"}).count() == 36
    lone = d.withColumn("fit", F.col("sample").isin("s00", "s03"))  # one reference a batch: locations only
    got = matrix_of(cb.combat_reference_anchored(lone), [f"s{j:02d}" for j in range(6)])
    assert np.allclose(np.diff(got[2:, :3], axis=1), np.diff(x[2:, :3], axis=1))


def test_components_against_decomposition(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (50, 6)) + np.outer(rng.normal(0, 5, 50), [1, 1, 1, -1, -1, -1])
    for scale in (False, True):
        p = {r["sample"]: (abs(r.pc1), abs(r.pc2), r.share1) for r in qc.pca(long(spark, x), scale=scale).collect()}
        c = x - x.mean(1, keepdims=True)
        c = (c / x.std(1, ddof=1, keepdims=True) if scale else c).T
        c = c - c.mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        for j in range(6):
            assert np.allclose(p[f"s{j:02d}"], (abs(u[j, 0] * s[0]), abs(u[j, 1] * s[1]), s[0] ** 2 / (s**2).sum()), atol=1e-6)


def test_cluster_order_joins_the_closest_first():
    names, groups = [f"s{i}" for i in range(9)], [0, 1, 2, 0, 1, 2, 0, 1, 2]
    rng = np.random.default_rng(10)
    r = np.array([[1.0 if i == j else 0.9 if groups[i] == groups[j] else 0.1 for j in range(9)] for i in range(9)]) + rng.normal(0, 0.01, (9, 9))
    r = (r + r.T) / 2
    order = qc.cluster_order([(names[i], names[j], r[i, j]) for i in range(9) for j in range(9)])
    kinds = [groups[int(n[1:])] for n in order]
    assert sorted(order) == names and sum(a != b for a, b in zip(kinds, kinds[1:])) == 2
    clusters = [[i] for i in range(9)]  # average linkage from its definition
    while len(clusters) > 1:
        _, a, b = min((1 - r[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j)
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    assert order == [names[i] for i in clusters[0]] and qc.cluster_order([]) == []


def test_numbered_is_the_total_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k long, v string").repartition(7)
    assert {(r.k, r.position) for r in numbered(df, "k").collect()} == {(i, i + 1) for i in range(101)}
    assert {(r.k, r.rank) for r in numbered(df, F.desc("k"), name="rank").collect()} == {(i, 101 - i) for i in range(101)}
    assert numbered(df.where("false"), "k").count() == 0


def test_grouping_cases(spark):
    def grouped(sets):
        edges = spark.createDataFrame([(f, p) for p, fs in sets.items() for f in fs], "feature string, entity string")
        return {r.leader: r for r in par.groups(edges).collect()}

    g = grouped({"P1": "ABC", "P2": "ABC", "P3": "DE"})
    assert g["P1"].members == ["P1", "P2"] and len(g) == 2
    g = grouped({"P1": "ABC", "P2": "AB"})
    assert set(g) == {"P1"} and g["P1"].subsumed == ["P2"] and g["P1"].n_all == 3
    g = grouped({"P1": "ABCXY", "P2": "DXZ", "P3": "EYZ"})
    assert g["P1"].razor_features == ["X", "Y"] and g["P2"].razor_features == ["Z"] and g["P3"].n_razor == 0
    many = {f"Q{i:03d}": "H" for i in range(300)} | {"R": "HI", "S": "HJ"}  # one feature that all hold
    edges = spark.createDataFrame([(f, p) for p, fs in many.items() for f in fs], "feature string, entity string")
    assert {(r.entity, r.by) for r in par.subsumed(edges).collect()} == {(f"Q{i:03d}", "R") for i in range(300)}
    assert par.groups(edges.where("false")).count() == 0


def test_library_fit_by_hand(spark):
    expected = np.array([10.0, 20, 30, 40, 50])
    good = expected * 3
    bad = good.copy()
    bad[1] *= 10
    for method in ("median_polish", "least_squares"):
        scale, r2, use = lib.fit_matrix(np.column_stack([good, bad]), expected, method)
        assert np.allclose(scale, 3) and use[:, 0].all() and not use[1, 1] and np.allclose(r2, 1)
    rows = [("k", f"y{i}", s, float(v[i]), float(expected[i]), 150.0) for s, v in (("good", good), ("bad", bad)) for i in range(5)] + [("few", "y1", "good", 8.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "key string, ion string, sample string, area double, expected double, total double")
    got = {(r.key, r["sample"]): r for r in lib.library_rollup(df).collect()}
    assert np.isclose(got["k", "bad"].value, np.log2(450)) and got["k", "bad"].n_used == 4 and got["few", "good"].value == 3 and got["few", "good"].r2 is None
    steps = {(r["sample"], r.step): r for r in lib.fit_trace(df).where("key = 'k'").collect()}
    assert steps["good", 1].name == "library_scaled" and ("good", 2) not in steps and steps["bad", 2].excluded == ["y1"] and steps["bad", 2].name == "outliers_removed"
    noise = np.array([1.0, 100, 1, 250, 3])
    trace = lib.fit_trace(spark.createDataFrame([("k", f"y{i}", "s", float(noise[i]), float(expected[i])) for i in range(5)], "key string, ion string, sample string, area double, expected double")).collect()
    s0, r0, _ = lib.fit_matrix(noise[:, None], expected, least=0, trim=False)
    s1, r1, _ = lib.fit_matrix(noise[:, None], expected, least=2)
    last = max(trace, key=lambda r: r.step)
    assert last.name == ("outliers_removed" if r1[0] >= r0[0] else "outliers_reverted") and np.isclose(last.scale, s1[0] if r1[0] >= r0[0] else s0[0])


def test_library_settings():
    assert lib.library_settings({"library_assist": None})["min_fragments"] == 3
    given = {"spectral_library_path": "a", "library_path": "b", "library_mz_tolerance": 0.1, "library_assist": {"mz_tolerance": 0.3}}
    assert (lib.library_settings(given)["library_path"], lib.library_settings(given)["mz_tolerance"]) == ("b", 0.3)


def test_enzymes():
    assert sequence.enzyme_from_xml('<x><Enzyme name="T" Cut="KR" no_cut="P" sense="C"/></x>') == "trypsin"
    assert sequence.enzyme_from_xml('<enzyme cut="kr"/>') == "trypsin/p" and sequence.enzyme_from_xml('<enzyme cut="D" sense="N"/>') == "aspn"
    assert sequence.enzyme_from_xml('<enzyme cut_c="K" cut_n="D"/>') is sequence.enzyme_from_xml("<broken") is sequence.enzyme_from_xml(None) is None


def test_fingerprints_and_provenance(spark, tmp_path):
    source, sidecar = tmp_path / "a.csv", str(tmp_path / "a.json")
    source.write_text("x\n1\n")
    assert not reports.up_to_date(spark, [str(source)], sidecar)
    reports.write_fingerprint(spark, [str(source)], sidecar, content=True)
    assert reports.up_to_date(spark, [str(source)], sidecar)
    source.write_text("x\n2\n")
    assert not reports.up_to_date(spark, [str(source)], sidecar)
    reports.write_provenance(spark, str(tmp_path / "p.json"), {"a": 1}, [str(source)], {"rows": 1}, ["read"])
    assert reports.read_provenance(spark, str(tmp_path / "p.json")) == {"a": 1}


def test_metadata_conflicts(spark, tmp_path):
    for name, kind in (("a", "Standard"), ("b", "Unknown")):
        (tmp_path / f"{name}.csv").write_text(f"Replicate Name,Sample Type\nr1,{kind}\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "ab"]
    with pytest.raises(ValueError, match="r1"):
        reports.load_metadata(spark, paths)
    apart = reports.load_metadata(spark, paths, documents=["A", "B"])
    rows = spark.createDataFrame([("r1", "A"), ("r1", "B"), ("r2", "A")], "sample string, document string")
    assert {(r["sample"], r.document, r.sample_type) for r in reports.with_metadata(rows, apart).collect()} == {("r1", "A", "reference"), ("r1", "B", "experimental"), ("r2", "A", "experimental")}
    with pytest.raises(ValueError):
        reports.load_metadata(spark, paths, documents=["A"])


def test_no_row_is_lost_for_a_bad_cell(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Peptide,Area,Retention Time,Replicate Name\n"A,B",#N/A,1.5,r1\nC,12x,2.5,r2\nD,3.5,,#N/A\n')
    rows = [(r.Peptide, r.Area, r["Retention Time"], r["Replicate Name"]) for r in reports.read_report(spark, str(path)).collect()]
    assert rows == [("A,B", None, 1.5, "r1"), ("C", None, 2.5, "r2"), ("D", 3.5, None, None)]


def test_library_file_by_ranges(spark, tmp_path):
    path = str(tmp_path / "lib.blib")
    with sqlite3.connect(path) as db:
        db.executescript(spectral.SQLITE_TABLES)
        for i in range(7):
            db.execute("INSERT INTO RefSpectra VALUES (?, ?, NULL, 2, ?, ?, 3)", (i, f"BARE{i}", f"PEP{i}" if i else None, 1.5 * (i > 1)))
            mz, intensity = struct.pack("<3d", 100.0 + i, 200.0, 300.0), struct.pack("<3f", 1, 2, 4)
            db.execute("INSERT INTO RefSpectraPeaks VALUES (?, ?, ?)", (i, zlib.compress(mz) if i % 2 else mz, zlib.compress(intensity) if i % 3 else intensity))
        more = [(7, "PEP3", struct.pack("<d", 1.0), struct.pack("<f", 1)), (8, "ODD", struct.pack("<2d", 1, 2), struct.pack("<f", 1)), (9, "NONE", b"", b""), (10, "ZERO", struct.pack("<d", 5), struct.pack("<f", 0))]
        for i, seq, mz, intensity in more:
            db.execute("INSERT INTO RefSpectra VALUES (?, ?, NULL, 2, ?, 9.0, 1)", (i, seq, seq))
            db.execute("INSERT INTO RefSpectraPeaks VALUES (?, ?, ?)", (i, mz, intensity))
    got = formats.read_library(spark, path)
    keys = ["BARE0_2"] + [f"PEP{i}_2" for i in range(1, 7)]
    assert {(r.key, r.mz) for r in got.where("intensity = 0.25").collect()} == {(k, 100.0 + i) for i, k in enumerate(keys)}
    assert got.count() == 22 and got.where("key = 'ZERO_2' AND intensity = 0").count() == 1 and got.where("rt IS NULL").select("key").distinct().count() == 2
    spark.dataSource.register(spectral.LibrarySource)
    raw = spark.read.format("spectral_library").option("name", "lib.blib").option("spectraPerTask", 4).load()
    assert raw.rdd.getNumPartitions() == 3
    empty = str(tmp_path / "empty.blib")
    with sqlite3.connect(empty) as db:
        db.executescript(spectral.SQLITE_TABLES)
    assert spectral.read_library_sqlite(spark, empty).collect() == []
    copy = str(tmp_path / "copy.blib")
    spectral.write_library_sqlite(got, copy)
    again = spectral.read_library_sqlite(spark, copy, spectra_per_task=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_hash_sample_takes_the_same_keys(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    a = {r.k for r in reports.hash_sample(df, "k").collect()}
    assert 850 < len(a) < 1150 and a == {r.k for r in reports.hash_sample(df.union(df), "k").collect()}


def test_run_writes_everything(spark, tmp_path):
    rows = [(f"P{f % 3}", f"PEP{f}", f"y{t}", 2, 1, f"r{s}", float(1000 + 10 * f + t + 100 * s), 10.0 + f) for f in range(30) for t in range(4) for s in range(4)]
    df = spark.createDataFrame(rows, "`Protein Accession` string, `Peptide Modified Sequence` string, `Fragment Ion` string, `Precursor Charge` int, `Product Charge` int, `Replicate Name` string, Area double, `Retention Time` double")
    paths = {}
    for b in ("A", "B"):
        paths[b] = str(tmp_path / f"{b}.csv")
        df.withColumn("Area", F.col("Area") * (2 if b == "B" else 1)).write.option("header", True).csv(paths[b])
    meta = spark.createDataFrame([(f"r{s}", ["reference", "qc", "experimental", "experimental"][s], None) for s in range(4)], "sample string, sample_type string, batch string")
    features, entities, groups = pipeline.run_reports(spark, paths, meta, None, str(tmp_path / "out"))
    assert (features.count(), entities.count(), groups.count()) == (240, 24, 3)
    assert spark.read.parquet(str(tmp_path / "out/corrected_features")).count() == 30
    assert reports.read_group_table(spark, str(tmp_path / "out/groups")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out/sample_metadata")).count() == 8
    assert reports.read_provenance(spark, str(tmp_path / "out/provenance.json"))["parsimony"] == {"shared": "all_groups"}
    means = {r["batch"]: r.m for r in features.groupBy("batch").agg(F.avg("x").alias("m")).collect()}
    assert abs(means["A"] - means["B"]) < 0.05


def test_settings_merge_deeply_and_report_typos():
    assert pipeline.settings(None) == pipeline.settings({}) == pipeline.DEFAULTS and pipeline.settings({"parsimony": None})["parsimony"] == {"shared": "all_groups"}
    got = pipeline.settings({"transition_rollup": {"min_transitions": 4}, "protein_rollup": {"n": 2, "topn": {"n": 5}}})
    assert got["transition_rollup"] == {"method": "sum", "min_transitions": 4, "use_ms1": False} and got["protein_rollup"]["n"] == 5
    assert pipeline.DEFAULTS["protein_rollup"] == {"method": "median_polish", "min_features": 3}
    typos = {"transition_rolup": {"method": "sum"}, "batch_correction": {"enabeld": False}, "protein_rollup": {"topn": {"count": 3}}}
    assert pipeline.unknown_keys(typos) == ["transition_rolup", "batch_correction.enabeld", "protein_rollup.topn.count"]
    with pytest.warns(UserWarning, match="enabeld .did you mean enabled"):
        assert pipeline.settings(typos) == pipeline.DEFAULTS
    with pytest.raises(ValueError, match="transition_rolup, batch_correction.enabeld"):
        pipeline.settings(typos, strict=True)
    assert pipeline.merged({"a": {"b": 1, "c": {"d": 2}}}, {"a": {"c": {"e": 3}}, "f": 4}) == {"a": {"b": 1, "c": {"d": 2, "e": 3}}, "f": 4}


def test_entity_dispatch(spark):
    rng = np.random.default_rng(12)
    p = long(spark, rng.normal(20, 1, (9, 3))).withColumn("entity", F.when(F.col("feature") < 1, "one").when(F.col("feature") < 3, "two").otherwise("many"))
    for method in ("sum", "topn", "median_polish", "max_ratio"):
        got = rollup.rollup_entities(p, method)
        assert got.count() == 9 and got.where("low_confidence").count() == 6
    with pytest.raises(NotImplementedError):
        rollup.rollup_entities(p, "direct")
    with pytest.raises(ValueError):
        rollup.rollup_entities(p, "ibaq")
