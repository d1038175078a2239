"""Searches, LOWESS over tasks, pairwise ratios, substring places and grouping against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import combat, joins, learn, library, outputs, parsimony, rollup, search, sequence, spread_lowess
from quantloom.operators import normalize as nrm
from quantloom.operators.kernels import lowess, median_polish
from quantloom.operators.ordering import numbered


def test_simplex_search_follows_the_textbook():
    bowl = lambda ps: [float(((p - [3, -1]) ** 2 * [1, 10]).sum()) for p in ps]
    best, cost = search.simplex_search(bowl, (1.0, 1.0), 200)
    assert np.allclose(best, [3, -1], atol=1e-2) and cost < 1e-3
    asked = []
    search.simplex_search(lambda ps: asked.append(len(ps)) or bowl(ps), (1.0, 1.0), 5)
    assert asked == [3] + [6] * 5  # a generation is one call
    rosenbrock = lambda ps: [float(100 * (p[1] - p[0] ** 2) ** 2 + (1 - p[0]) ** 2) for p in ps]
    assert np.allclose(search.simplex_search(rosenbrock, (-1.2, 1.0), 400)[0], [1, 1], atol=1e-2)
    assert search.simplex_search(lambda ps: [None] * len(ps), (1.0,), 3)[1] == search.WORST


def test_gradient_search_stays_inside_and_keeps_the_best():
    bounds = ((-1.0, 1.0), (-1.0, 0.0))
    cost = lambda ps: [float((p[0] - 0.4) ** 2 + (p[1] + 0.3) ** 2) for p in ps]
    best, least = search.gradient_search(cost, (0, 0), bounds)
    assert np.allclose(best, [0.4, -0.3], atol=0.02) and least <= 1e-3
    best, _ = search.gradient_search(lambda ps: [float(-p[0] + p[1]) for p in ps], (0, 0), bounds)
    assert np.allclose(best, [1, -1])
    assert np.allclose(search.gradient_search(lambda ps: [5.0] * len(ps), (0, 0), bounds)[0], 0)


@pytest.fixture(scope="module")
def transitions(spark):
    """40 features x 5 transitions x 4 reference and 3 qc samples; the transition of highest m/z and poorest shape is noise."""
    rng, rows = np.random.default_rng(2), []
    for f in range(40):
        for t in range(2 if f == 39 else 5):
            for s in ("r0", "r1", "r2", "r3", "q0", "q1", "q2"):
                noisy = t == 4
                x = 14 + f % 5 - t + rng.normal(0, 1.4 if noisy else 0.05)
                rows.append((f, f"y{t}", s, None if (f, t, s) == (3, 2, "r1") else float(2**x), float(x), 400.0 + 150 * t, float(rng.uniform(0.1, 0.4) if noisy else rng.uniform(0.8, 1)), bool(not noisy)))
    return rows, spark.createDataFrame(rows, "feature long, transition string, sample string, area double, x double, mz double, shape double, coeluting boolean")


REF, QC = ["r0", "r1", "r2", "r3"], ["q0", "q1", "q2"]


def variance_objective(rows, p, shape=True, coeluting=True):
    alpha, beta, gamma, delta, penalty = np.exp([*p[:4], p[5]])
    cvs = []
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        cells = {}
        for r in own:
            if r[2] in REF:
                cells.setdefault(r[1], []).append(r)
        if len(cells) < 3:
            continue
        weights, matrix = [], []
        for t in cells.values():
            lin = np.array([2 ** r[4] for r in t])
            i = np.median(lin)
            v = alpha * max(i, 1) + beta * max(i, 1) ** 2 + gamma
            if shape:
                v *= 1 + delta * ((1 / max((lin * [r[6] for r in t]).sum() / lin.sum(), 0.01)) ** p[4] - 1)
            if coeluting:
                v *= 1 if (lin * [r[7] for r in t]).sum() / lin.sum() > 0.5 else penalty
            weights.append(i**2 / v)
            matrix.append([r[4] for r in t])
        values = np.array(weights) / np.sum(weights) @ np.array(matrix)
        if values.std() > 0:
            cvs.append(values.std() / abs(values.mean()))
    return float(np.median(cvs))


@pytest.mark.parametrize("given", ["both", "shape", "none"])
def test_variance_parameters_by_brute_force(spark, transitions, given):
    rows, df = transitions
    drop = {"both": [], "shape": ["coeluting"], "none": ["shape", "coeluting"]}[given]
    got = learn.learn_variance(df.drop("area", *drop), REF, rounds=6)
    rate = lambda ps: [variance_objective(rows, p, given != "none", given == "both") for p in ps]
    best, cost = search.simplex_search(rate, learn.VARIANCE_START, 6)
    assert np.isclose(got.cv_after, cost) and np.isclose(got.cv_before, rate([np.array(learn.VARIANCE_START)])[0]) and got.cv_after <= got.cv_before
    want = dict(zip(learn.VARIANCE_DEFAULTS, [*np.exp(best[:4]), best[4], np.exp(best[5])]))
    for k, v in want.items():
        kept = given == "none" and k in ("delta", "shape_exponent") or given != "both" and k == "coelution_penalty"
        assert np.isclose(got.params[k], learn.VARIANCE_DEFAULTS[k] if kept else v), k
    assert rollup.rollup_quality_weighted(df.where("x IS NOT NULL"), **got.params).count() == 40 * 7
    assert learn.learn_variance(df.drop("area"), ["r0"]).params == learn.VARIANCE_DEFAULTS


def adaptive_objective(rows, samples, betas, mz=(400.0, 1000.0)):
    cvs = []
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        t = {}
        for r in own:
            if r[2] in samples:
                t.setdefault(r[1], {})[r[2]] = r
        if len(t) < 3:
            continue
        z = [betas[0] * min(max((next(iter(c.values()))[5] - mz[0]) / (mz[1] - mz[0]), 0), 1) + betas[1] * np.mean([r[6] < 0.5 for r in c.values()]) for c in t.values()]
        w = np.exp(z)
        w = w * len(w) / w.sum()
        v = [max(1, sum(a * (c[s][3] or 0) for a, c in zip(w, t.values()))) for s in samples]
        cvs.append(np.std(v, ddof=1) / np.mean(v))
    return float(np.median(cvs))


def test_adaptive_betas_are_learned_and_checked(spark, transitions):
    rows, df = transitions
    got = learn.learn_adaptive(df.drop("x"), REF, QC, rounds=4)
    assert got.mz_range == (400.0, 1000.0) and got.use and got.reason is None
    betas = tuple(got.betas.values())
    assert betas[0] < 0 and betas[1] <= 0 and all(-1 <= b <= 1 for b in betas)
    for samples, cv in ((REF, got.reference_cv), (QC, got.qc_cv)):
        assert np.allclose(cv, [adaptive_objective(rows, samples, (0, 0)), adaptive_objective(rows, samples, betas)])
        assert cv[1] < cv[0] * 0.95
    grid = min(adaptive_objective(rows, REF, (a, b)) for a in np.linspace(-1, 1, 9) for b in np.linspace(-1, 0, 5))
    assert got.reference_cv[1] <= grid * 1.05
    m = df.select("feature", "transition", "sample", "x")
    scaled = rollup.transition_descriptors(m, df.select("feature", "transition", "mz").distinct(), got.mz_range).join(rollup.shape_descriptors(df.where(F.col("sample").isin(REF))), ["feature", "transition"])
    assert rollup.rollup_weighted(m, rollup.adaptive_weights(scaled, got.betas)).count() == 40 * 7


def test_adaptive_falls_back_to_the_sum(spark, transitions):
    _, df = transitions
    assert learn.learn_adaptive(df, ["r0"], QC).reason == "fewer than two reference samples"
    assert learn.learn_adaptive(df, REF, [], rounds=2).use  # without qc samples the reference decides
    steady = F.lit(float(2**16))  # what the references call noise is the only steady one in the qc samples
    moved = F.col("area") * (1 + F.pmod(F.xxhash64("feature", "sample"), F.lit(100)) / 100)
    odd = df.withColumn("area", F.when(~F.col("sample").startswith("q"), F.col("area")).when(F.col("transition") == "y4", steady).otherwise(moved))
    got = learn.learn_adaptive(odd, REF, QC, rounds=2)
    assert not got.use and "qc" in got.reason
    flat = df.withColumn("area", F.lit(1000.0))
    got = learn.learn_adaptive(flat, REF, QC, rounds=2)
    assert not got.use and tuple(got.betas.values()) == (0, 0) and got.reason == "no improvement on the reference samples"
    sums = df.where("area IS NOT NULL AND feature < 39").groupBy("feature", "sample").agg(F.sum("area").alias("v"))
    per = sums.where(F.col("sample").isin(REF)).groupBy("feature").agg((F.stddev_samp("v") / F.avg("v")).alias("cv")).agg(F.median("cv")).first()[0]
    assert np.isclose(learn.learn_adaptive(df, REF, QC, rounds=1).reference_cv[0], per)


def evenness(v, a):
    if a <= 0:
        return search.WORST
    s, size = np.sort(v), max(100, len(v) // 20)
    var = [np.var(np.arcsinh(a * s[i : i + size])) for i in range(0, len(s) - size, size // 4)]
    return np.std(var) / np.mean(var) if len(var) > 1 and np.mean(var) > 0 else search.WORST


def test_vsn_factor_of_each_sample(spark):
    rng = np.random.default_rng(8)
    samples = {"a": rng.normal(12, 2, 900), "b": rng.normal(15, 1, 2500), "few": rng.normal(10, 1, 90), "edge": rng.normal(9, 3, 126)}  # of two windows: even where nothing is scaled, the factor grows until rounding ends it
    df = spark.createDataFrame([(i, s, float(v)) for s, x in samples.items() for i, v in enumerate(x)] + [(-1, "a", None), (-1, "b", float("nan"))], "feature long, sample string, x double")
    got = {r["sample"]: r for r in nrm.vsn_search(df).collect()}
    for s, x in samples.items():
        v = 2**x
        start = 1 / np.median(v)
        best, cost = search.simplex_search(lambda ps, v=v: [evenness(v, p[0]) for p in ps], (start,), 500)
        assert np.isclose(got[s].start, start) and (s == "edge" or np.isclose(got[s].factor, best[0], rtol=1e-6)) and np.isclose(got[s].cost, cost, rtol=1e-6), s
    assert got["a"].factor != got["a"].start and got["few"].factor == got["few"].start
    out = {(r.feature, r["sample"]): r.x for r in nrm.vsn_normalize(df, optimize=True).collect()}
    assert np.isclose(out[5, "a"], np.arcsinh(got["a"].factor * 2 ** samples["a"][5]))
    assert nrm.vsn_search(df.where("false")).collect() == []


@pytest.mark.parametrize("size", [50, 333])
def test_lowess_over_tasks_is_the_kernel(spark, size):
    rng, rows, want = np.random.default_rng(1), [], {}
    shapes = {"plain": np.sort(rng.uniform(0, 100, 1500)), "ties": np.sort(np.round(rng.uniform(0, 30, 1200), 0)), "lead": np.r_[np.zeros(40), np.sort(rng.uniform(20, 100, 400))], "gap": np.sort(np.r_[rng.uniform(0, 1, 300), rng.uniform(90, 91, 300)]), "one": np.full(70, 5.0), "short": np.sort(rng.uniform(0, 9, 25))}
    for s, x in shapes.items():
        y = np.sin(x / 9) + rng.normal(0, 0.2, len(x))
        y[:: 40] += 5
        if s == "gap":
            y = 2 * x + rng.normal(0, 0.1, len(x))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        want[s] = (x, lowess(x, y, 0.3, 3, 0.01 * (x[-1] - x[0])))
        rows += [(s, float(a), float(b)) for a, b in zip(x, y)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "sample string, x double, y double").repartition(5)
    got = {r["sample"]: r for r in spread_lowess.fit_anchors(df, size=size).collect()}
    for s, (x, fit) in want.items():
        assert got[s].n == len(x) and np.allclose(np.interp(x, got[s].ax, got[s].fit), fit, rtol=1e-9, atol=1e-9), s
        assert len(got[s].ax) < 260


def test_curves_of_long_samples_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(f, s, float(t), float(10 + np.cos(t / 7) + rng.normal(0, 0.1))) for s in ("a", "b") for f, t in enumerate(rng.uniform(0, 60, 700 if s == "a" else 60))] + [(-1, "a", None, 1.0), (-2, "a", 3.0, None)]
    df = spark.createDataFrame(rows, "feature long, sample string, rt double, x double")
    whole, spread = ({(r["sample"], r.i): r.fit for r in nrm.lowess_curves(df, most_points=k).collect()} for k in (1 << 16, 100))
    assert whole.keys() == spread.keys() and len(whole) == 200
    assert all((v is None) == (spread[k] is None) and (v is None or abs(v - spread[k]) < 1e-9) for k, v in whole.items())


def test_pairwise_ratios_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(20, 2, (6, 300))
    x[rng.random(x.shape) < 0.4] = np.nan
    rows = [("p", f, f"s{s:03d}", float(x[f, s])) for f in range(6) for s in range(300) if not np.isnan(x[f, s])] + [("solo", 0, "s001", 5.0)]
    got = {(r.entity, r["sample"]): r.value for r in rollup.entity_max_ratio(spark.createDataFrame(rows, "entity string, feature long, sample string, x double")).collect()}
    seen = np.flatnonzero(~np.isnan(x).all(0))
    with np.errstate(all="ignore"):
        profile = np.array([sum(np.nan_to_num(np.nanmedian(x[:, a] - x[:, b])) if (~np.isnan(x[:, a] - x[:, b])).any() else 0 for b in seen if b != a) / len(seen) for a in seen])
    want = profile - np.median(profile) + np.median([np.nanmedian(x[:, a]) for a in seen])
    assert len(got) == len(seen) + 1 and got["solo", "s001"] == 5.0
    assert np.allclose([got["p", f"s{a:03d}"] for a in seen], want)


def test_substring_places(spark):
    r = random.Random(2)
    texts = {i: "".join(r.choice("ABC") for _ in range(r.choice([0, 1, 5, 40, 1500, 2300]))) for i in range(30)} | {99: "é" * 1100 + "ABCA", 100: None}
    needles = ["A", "BC", "CABA", "é", "ABCA", texts[0][:9] or "AAA", "ABCABCABCABC", next(t for t in texts.values() if t and len(t) > 1400)[1000:1200], "ZZZ", "", None]
    got = sorted((x.w, x.k, x["at"]) for x in joins.substring_join(spark.createDataFrame([(n,) for n in needles], "w string"), spark.createDataFrame(list(texts.items()), "k long, t string"), "w", "t", ["k"]).collect())
    want = sorted((n, k, i + 1) for n in {n for n in needles if n} for k, t in texts.items() if t for i in range(len(t)) if t.startswith(n, i))
    assert got == want
    none = spark.createDataFrame([], "w string")
    assert joins.substring_join(none, spark.createDataFrame([(1, "abc")], "k long, t string"), "w", "t", ["k"]).collect() == []


def test_a_short_needle_makes_only_its_own_places_rows(spark):
    text = "".join(random.Random(1).choice("BCDEFGH") for _ in range(20_000)) + "A"
    needles = spark.createDataFrame([("A",), ("BCDEFGHBCDEF",)], "w string")
    joined = joins.substring_join(needles, spark.createDataFrame([(1, text)], "k long, t string"), "w", "t", ["k"])
    assert [tuple(r) for r in joined.collect()] == [("A", 1, 20_001)]


def brute_grouping(edges):
    sets = {}
    for f, e in edges:
        sets.setdefault(e, set()).add(f)
    by = {e: min(o for o in sets if sets[o] > s) for e, s in sets.items() if any(sets[o] > s for o in sets)}
    rest = {e: frozenset(s) for e, s in sets.items() if e not in by}
    leader = {e: min(o for o in rest if rest[o] == s) for e, s in rest.items()}
    held = {}
    for e in set(leader.values()):
        for f in rest[e]:
            held.setdefault(f, set()).add(e)
    unique = {e: sum(held[f] == {e} for f in rest[e]) for e in set(leader.values())}
    role = {(f, e): "unique" if len(es) == 1 else "razor" if e == min(es, key=lambda x: (-unique[x], -len(rest[x]), x)) else "shared" for f, es in held.items() for e in es}
    return by, leader, role


@pytest.mark.parametrize("seed", range(4))
def test_grouping_of_random_sets(spark, seed):
    r = random.Random(seed)
    edges = {(f, f"e{e:02d}") for e in range(40) for f in r.sample(range(12 if seed % 2 else 30), r.choice([1, 1, 2, 3, 5, 8]))}
    edges |= {(0, f"hot{k}") for k in range(20)} | {(f, "all") for f in range(6)}
    df = spark.createDataFrame(sorted(edges) * 2, "feature long, entity string").repartition(3)
    by, leader, role = brute_grouping(edges)
    absorbed, leaders, roles = parsimony.grouping(df)
    assert {r.entity: r.by for r in absorbed.collect()} == by == {r.entity: r.by for r in parsimony.subsumed(df).collect()}
    assert {r.entity: r.leader for r in leaders.collect()} == leader
    assert {(r.feature, r.leader): r.role for r in roles.collect()} == role
    assert {r.entity: r.leader for r in parsimony.canonical(df, parsimony.subsumed(df)).collect()} == leader
    for g in parsimony.groups(df).collect():
        assert g.members == sorted(e for e, x in leader.items() if x == g.leader) and g.subsumed == sorted(e for e, x in by.items() if leader.get(x) == g.leader)
        assert g.all_features == sorted(f for f, e in role if e == g.leader) and g.n_unique == sum(v == "unique" for (f, e), v in role.items() if e == g.leader)


def test_numbers_within_groups_that_span_partitions(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 50 = 1 THEN concat('g', id) ELSE 'big' END AS g", "id * 7919 % 1000 AS v").repartition(7)
    got = {}
    for r in numbered(df, "g", "v", within=("g",), name="k").collect():
        got.setdefault(r.g, []).append((r.k, r.v))
    for rows in got.values():
        rows.sort()
        assert [k for k, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_batch_verdict_by_the_qc_samples(spark):
    """The reference gets perfect and the qc samples noisier: not passed, though their CV grows by less than a tenth."""
    rng = np.random.default_rng(0)

    def verdict(qc_noise, **limits):
        rows = [(f, f"{k}{s}", f"b{s % 2}", k, 10.0 + s % 2, 10.0 if k == "reference" else 10.0 + s % 2 + qc_noise * (s // 2 - 1)) for k in ("reference", "qc") for s in range(6) for f in range(20)]
        return combat.evaluate(spark.createDataFrame(rows, "feature long, sample string, batch string, sample_type string, x_before double, x_after double"), **limits).first()

    v = verdict(0.08)
    assert v.qc_gain < 0 and v.qc_x_after <= 1.1 * v.qc_x_before and not v.passed and v.overfit == float("inf")
    assert verdict(0.08, min_qc_improvement=-1.0).passed and not verdict(0.5, min_qc_improvement=-9.0).passed
    assert verdict(0.5, min_qc_improvement=-9.0, worsen_tolerance=9.0).passed
    v = verdict(0.0)
    assert v.qc_gain == 0 and v.passed and v.ref_gain == 1
    none = combat.evaluate(spark.createDataFrame([(1, "a", "b", "other", 1.0, 1.0)], "feature long, sample string, batch string, sample_type string, x_before double, x_after double")).first()
    assert none.passed and none.overfit == 1 and rng is not None


def test_isotopes_of_at_least_half_the_largest_set_the_scale(spark):
    rows = [("k", "s", 0, 200.0, 1.0), ("k", "s", 1, 60.0, 0.6), ("k", "s", 2, 1.0, 0.2), ("n", "s", 0, 5.0, 0.0), ("z", "s", 0, -3.0, 1.0), ("z", "s", 1, 4.0, 0.9)]
    got = {r.key: r for r in library.isotope_correction(spark.createDataFrame(rows, "key string, sample string, isotope int, observed double, expected double")).collect()}
    assert got["k"].scale == 100 and np.isclose(got["k"].corrected_total, 180) and got["k"].interfered == [0] and np.allclose(got["k"].corrected, [100, 60, 1])
    assert got["n"].scale is None and got["n"].corrected_total == 5 and got["n"].interfered == []
    assert got["z"].scale == 0 and got["z"].interfered == [1]


@pytest.mark.parametrize(("enzyme", "want"), [("lysc", ["AAK", "PBBBRCCCCK", "DE"]), ("lys-c", ["AAK", "PBBBRCCCCK", "DE"]), ("trypsin", ["AAKPBBBR", "CCCCK", "DE"]), ("trypsin/p", ["AAK", "PBBBR", "CCCCK", "DE"]), ("argc", ["AAKPBBBR", "CCCCKDE"]), ("aspn", ["AAKPBBBRCCCCK", "DE"]), ("lysn", ["AA", "KPBBBRCCCC", "KDE"]), ("gluc", ["AAKPBBBRCCCCKDE"])])
def test_cleavage_rules(spark, enzyme, want):
    df = spark.createDataFrame([("AAKPBBBRCCCCKDE",)], "s string")
    assert df.select(sequence.cut_sequence(F.col("s"), enzyme)).first()[0] == want
    with pytest.raises(ValueError, match="Unknown enzyme"):
        sequence.cut_sequence(F.col("s"), "unknown")
    whole = sequence.digest(df, "s", "nonspecific", shortest=14, longest=15).collect()
    assert sorted(r.peptide for r in whole) == sorted(["AAKPBBBRCCCCKDE", "AAKPBBBRCCCCKD", "AKPBBBRCCCCKDE"])


def test_outputs_of_one_write(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(20, 1, (5, 6))
    x[0, 0] = x[4, :] = np.nan
    rows = [("p", f"f{f}", f"s{s}", None if np.isnan(x[f, s]) else float(x[f, s])) for f in range(5) for s in range(6)] + [("solo", "f9", "s0", 7.0)]
    df = spark.createDataFrame(rows, "entity string, feature string, sample string, x double")
    for method, names in (("median_polish", ["residuals", "values"]), ("topn", ["selections", "values"]), ("quality_weighted", ["values", "weights"])):
        path = str(tmp_path / method)
        outputs.write_outputs(outputs.rollup_outputs(df, method=method), path)
        assert sorted(p.name for p in (tmp_path / method).iterdir() if p.is_dir()) == [f"output={n}" for n in names]
    read = lambda method, name: outputs.read_output(spark, str(tmp_path / method), name).where("entity = 'p'").collect()
    overall, effects, columns, resid = median_polish(x)
    assert np.allclose([r.value for r in sorted(read("median_polish", "values"), key=lambda r: r["sample"])], overall + columns)
    got = {(r.feature, r["sample"]): r for r in read("median_polish", "residuals")}
    assert len(got) == 23 and all(np.isclose(r.residual, resid[int(f[1]), int(s[1])]) and np.isclose(r.row_effect, effects[int(f[1])]) for (f, s), r in got.items())
    assert np.isclose(got["f1", "s0"].residual_mad, np.median(np.abs(resid[1] - np.median(resid[1])))) and np.isclose(got["f0", "s1"].residual_std, np.nanstd(resid[0]))
    order = sorted(range(4), key=lambda f: -np.nanmedian(x[f]))
    assert [(r.selection_rank, r.feature, r.n_rows, r.n_selected) for r in sorted(read("topn", "selections"), key=lambda r: r.selection_rank)] == [(k + 1, f"f{f}", 5, 3) for k, f in enumerate(order[:3])]
    assert np.allclose([r.value for r in sorted(read("topn", "values"), key=lambda r: r["sample"])], np.nanmean(x[order[:3]], axis=0))
    weights = read("quality_weighted", "weights")
    for s in range(6):
        own = {r.feature: r.weight for r in weights if r["sample"] == f"s{s}"}
        assert np.isclose(sum(own.values()), 1) and set(own) == {f"f{f}" for f in range(5) if not np.isnan(x[f, s])}
        value = next(r.value for r in read("quality_weighted", "values") if r["sample"] == f"s{s}")
        assert np.isclose(value, sum(w * x[int(f[1]), s] for f, w in own.items()))
    with pytest.raises(ValueError, match="no further outputs"):
        outputs.rollup_outputs(df, method="sum")
