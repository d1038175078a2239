"""Findings of the third round: what large tables and ties broke."""

import numpy as np
import pyarrow as pa
import pytest
from compare import TABLES, connect, difference
from pyspark.sql import functions as F

from quantloom.operators import compare as compare_cvs
from quantloom.operators import joins, kernels, library, ordering, outputs, parsimony
from quantloom.plans import queries_groups


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50_000])
def test_quantiles_are_exact_without_gathering_a_group(spark, n):
    rng = np.random.default_rng(n)
    v = {g: np.round(rng.normal(size=n) * 50, 2 if g else 9) for g in (0, 1)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in v.items() for x in xs] + [(0, None), (1, float("nan"))], "g int, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = ordering.quantiles(df, "x", probs, ("g",))
    for r in got.collect():
        assert np.allclose(r.q, np.quantile(v[r.g], probs), rtol=1e-12, atol=1e-12) and r.n == n
    whole = ordering.quantiles(df.drop("g"), "x", probs).first()
    assert np.allclose(whole.q, np.quantile(np.concatenate(list(v.values())), probs), rtol=1e-12, atol=1e-12)
    assert "percentile(" not in got._jdf.queryExecution().toString()


def test_polish_of_many_matrices_equals_one_by_one(spark):
    rng = np.random.default_rng(5)
    stack = np.round(rng.normal(20, 4, size=(40, 5, 6)), 3)
    stack[rng.random(stack.shape) < 0.2] = np.nan
    many = kernels.median_polish_stack(stack)
    for i, x in enumerate(stack):
        for got, want in zip(many, kernels.median_polish(x)):
            assert np.allclose(got[i], want, rtol=0, atol=1e-12, equal_nan=True)


def test_polish_runs_without_a_pandas_call_for_each_feature(spark, monkeypatch):
    monkeypatch.setattr(kernels, "GATHER", 50)
    rows = [(k, t, f"S{s}", float((k * 7 + t * 3 + s * s) % 11)) for k in range(30) for t in range(1 + k % 4) for s in range(2 + k % 3)]
    df = spark.createDataFrame([*rows, (3, 0, "S0", 99.0), (3, 1, "S9", None)], "feature int, transition int, sample string, x double")
    out = kernels.median_polish_frames(df.coalesce(1), "feature", "transition", 20, 1e-4, True)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = {(r.feature, r["sample"]): (r.value, r.n_rows) for r in out.collect()}
    for k in range(30):
        if k == 3:
            continue
        x = np.array([[(k * 7 + t * 3 + s * s) % 11 for s in range(2 + k % 3)] for t in range(1 + k % 4)], float)
        overall, _, cols, _ = kernels.median_polish(x)
        for s in range(x.shape[1]):
            assert abs(got[k, f"S{s}"][0] - (overall + cols[s] + np.log2(len(x)))) < 1e-9 and got[k, f"S{s}"][1] == len(x)
    assert np.isnan(got[3, "S9"][0]) or got[3, "S9"][0] is None


def test_top_does_not_order_equal_scores_by_rounding_noise(spark):
    pairs = spark.createDataFrame([(1, 0.3, 0.2), (2, 0.3 + 1e-15, 0.2), (3, 0.4, 0.2)], "feature int, cv_a double, cv_b double")
    assert [r.feature for r in compare_cvs.top(pairs, n=2, digits=9).collect()] == [3, 1]


def test_range_counts_makes_no_pairs(spark):
    points = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(None,)], "v double")
    intervals = spark.createDataFrame([(1, 2.0, 5.0), (2, 2.0, 2.0), (3, 5.0, 2.0), (4, -1.0, 0.0), (5, 8.5, 99.0), (6, None, 3.0)], "w int, lo double, hi double")
    out = joins.range_counts(points, intervals, "v", "lo", "hi")
    assert {r.w: r.n for r in out.collect()} == {1: 300, 2: 0, 3: 0, 4: 0, 5: 100, 6: 0}
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nearest_within_takes_the_smaller_value_when_distances_differ_by_noise_only(spark):
    left = spark.createDataFrame([(1, "a", 12.3), (2, "a", 90.0), (3, "b", 12.3), (4, "a", None), (5, "c", 1.0)], "id int, k string, x double")
    right = spark.createDataFrame([("a", 12.2, 7), ("a", 12.4, 8), ("a", 12.2, 6), ("b", 12.9, 9)], "k string, v double, y int")
    assert abs(12.3 - 12.4) < abs(12.3 - 12.2)  # by noise
    got = joins.nearest_within(left, right, "x", "v", 1.0, ["k"], ["id"], ["y"], digits=8)
    assert {r.id: (r.v, r.y) for r in got.collect()} == {1: (12.2, 6), 2: (None, None), 3: (12.9, 9), 4: (None, None), 5: (None, None)}
    raw = joins.nearest_within(left, right, "x", "v", 1.0, ["k"], ["id"], ["y"])
    assert {r.id: r.v for r in raw.collect()}[1] == 12.4
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_fragments_do_not_give_a_fit_quality_by_rounding(spark):
    x = np.full((3, 1), 50000.37)  # their mean is off by rounding in some sums
    x = np.vstack([x, x, x, x[:1]])
    mean = x.sum(0) / len(x)
    noisy = np.repeat(x + np.spacing(x) * (mean == x), 1, axis=1)
    noisy[0] = x[0]
    _, r2, _ = library.fit_matrix(noisy, np.arange(1.0, 11.0), "least_squares", trim=False)
    assert r2[0] == 0.0


def test_library_rollup_fits_many_precursors_in_one_call(spark):
    rows = [(f"k{k}", f"y{i}", f"S{s}", float((k * 31 + i * 17 + s * 7) % 23) if (k + i + s) % 5 else None, float(i) if k % 4 else None, 30.0) for k in range(12) for i in range(1, 4 + k % 4) for s in range(3 + k % 2)]
    df = spark.createDataFrame(rows, "key string, ion string, sample string, area double, expected double, total double")
    for method in ("median_polish", "least_squares"):
        out = library.library_rollup(df, method)
        assert "MapInArrow" in out._jdf.queryExecution().toString()
        got = {(r.key, r["sample"]): r for r in out.collect()}
        for k in range(12):
            x = np.array([[next((a for q, j, t, a, *_ in rows if (q, j, t) == (f"k{k}", f"y{i}", f"S{s}")), None) for s in range(3 + k % 2)] for i in range(1, 4 + k % 4)], float)
            scale, r2, use = library.fit_matrix(x, np.arange(1.0, 4 + k % 4), method)
            for s in range(x.shape[1]):
                r = got[f"k{k}", f"S{s}"]
                amount = scale[s] * 30 if k % 4 else np.nansum(x[:, s])
                assert (r.value is None) == (not amount > 0) and (r.value is None or abs(r.value - np.log2(amount)) < 1e-9)
                assert r.n_used == (use[:, s].sum() if k % 4 else 0)


def test_outputs_of_a_polish_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(outputs, "BATCH", 64)
    x = np.round(np.random.default_rng(3).normal(20, 3, (90, 5)), 3)
    cells = pa.table({"key": ["a"] * 450, "row": np.repeat(np.arange(90), 5), "sample": [f"S{s}" for _ in range(90) for s in range(5)], "x": x.ravel()})
    got = list(outputs.polished_batches(iter(cells.to_batches()), False))
    assert max(b.num_rows for b in got) <= 64
    overall, rows, cols, resid = kernels.median_polish(x)
    t = pa.Table.from_batches(got).to_pandas()
    assert np.allclose(t[t.output == "values"].value, overall + cols) and np.allclose(t[t.output == "residuals"].sort_values(["row", "sample"]).residual, resid.ravel())


def test_unique_group_sums_cover_the_edges_of_all_lines(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 3 = 2")
    first = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"))
    lines.join(first, ["l_partkey", "l_orderkey"]).coalesce(1).write.parquet(f"{tmp_path}/lines")
    (next((tmp_path / "lines").glob("*.parquet"))).rename(tmp_path / "lineitem.parquet")
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    run, sql = queries_groups.QUERIES["par_group_sum_unique"]
    rows = run(spark, str(tmp_path))
    assert rows.count() > 0 and rows.where("entity NOT LIKE 'O%'").isEmpty()  # groups of orders, not of brands
    assert not difference(spark, connect(str(tmp_path)), run, sql, str(tmp_path))


def test_a_known_grouping_is_not_made_again(spark, monkeypatch):
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "feature int, entity string")
    values = spark.createDataFrame([(1, "S", 1.0), (2, "S", 2.0)], "feature int, sample string, x double")
    made = parsimony.grouping(edges)
    monkeypatch.setattr(parsimony, "grouping", None)
    assert {r.leader for r in parsimony.groups(edges, made).collect()} == {"a", "b"}
    assert sorted((r.entity, r.feature) for r in parsimony.group_matrix(values, edges, made=made).collect()) == [("a", 1), ("a", 2), ("b", 2)]


def test_small_sets_are_compared_where_they_meet(spark, monkeypatch):
    """Only true supersets are written as pairs; sets on both sides of ``SMALL`` are told apart on all features."""
    written = {}
    table = parsimony.Scratch.table

    def kept(self, df, name="t"):
        out = table(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(parsimony.Scratch, "table", kept)
    sets = {f"s{i:02d}": {0, 1, 100 + i, 200 + i} for i in range(30)} | {f"t{i:02d}": {0, 1, 100 + i} for i in range(10)}
    edges = lambda named: spark.createDataFrame([(f, e) for e, fs in named.items() for f in fs] * 2, "feature long, entity string")
    assert {(r.entity, r.by) for r in parsimony.subsumed(edges(sets)).collect()} == {(f"t{i:02d}", f"s{i:02d}") for i in range(10)}
    assert written["pairs"] == 10
    n = parsimony.SMALL
    big = {"a": set(range(n + 5)), "b": set(range(n + 4)), "c": set(range(3)), "d": set(range(n)) | {99}, "e": {1, 99}, "f": set(range(n + 5)), "g": {2, 77}, "h": {5}}
    want = {x: min(o for o, s in big.items() if s > v) for x, v in big.items() if any(s > v for s in big.values())}
    absorbed, leaders, role = parsimony.grouping(edges(big))
    assert {r.entity: r.by for r in absorbed.collect()} == want
    assert {(r.entity, r.leader) for r in leaders.collect()} == {("a", "a"), ("f", "a"), ("d", "d"), ("g", "g")}
    assert {(r.feature, r.leader) for r in role.where("role <> 'shared'").collect()} == {(f, "a") for f in range(n + 5)} | {(99, "d"), (77, "g")}


def test_group_sums_shuffle_no_row_for_each_sample(spark):
    """As the sum over the group matrix, for more samples than one row carries."""
    values = spark.createDataFrame([(f, f"S{s:03d}", float(f + s % 7)) for f in (1, 2, 3) for s in range(70) if (f + s) % 5], "feature int, sample string, x double")
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "feature int, entity string")
    made = parsimony.grouping(edges)
    sums = parsimony.group_sums(values, edges, made=made)
    assert "hashpartitioning(entity#" in (plan := sums._jdf.queryExecution().executedPlan().toString()) and "sample" not in plan.split("hashpartitioning(entity#")[1].split(")")[0]
    want = {}
    for r in parsimony.group_matrix(values, edges, made=made).collect():
        y, n = want.get((r.entity, r["sample"]), (0.0, 0))
        want[r.entity, r["sample"]] = (y + 2**r.x, n + 1)
    got = {(r.entity, r["sample"]): (r.value, r.n_features) for r in sums.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - np.log2(max(y, 1.0))) < 1e-9 and got[k][1] == n for k, (y, n) in want.items())
