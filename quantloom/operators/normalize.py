"""Sample normalisation on long log2 data (feature, sample, x [, rt])."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from . import search, spread_lowess
from .kernels import lowess
from .ordering import numbered, quantiles


def sample_medians(df: DataFrame) -> DataFrame:
    return quantiles(df, "x", [0.5], ("sample",)).select("sample", F.get("q", 0).alias("med"))


def median_normalize(df: DataFrame) -> DataFrame:
    """x minus the sample's median plus the median of all sample medians. Factors are one row per sample."""
    med = sample_medians(df)
    level = med.agg(F.median("med").alias("level"))
    factors = med.join(level, F.lit(True)).select("sample", (F.col("med") - F.col("level")).alias("shift"))
    return df.join(factors, "sample").withColumn("x", F.col("x") - F.col("shift")).drop("shift")


def quantile_normalize(df: DataFrame) -> DataFrame:
    """Every sample gets the mean distribution. Ties share the mean of their places; a half rank takes the mean of two."""
    by = Window.partitionBy("sample").orderBy("x")
    r = df.where(F.col("x").isNotNull())
    r = r.withColumns({"k": F.row_number().over(by), "lo": F.rank().over(by), "ties": F.count("*").over(Window.partitionBy("sample", "x"))})
    reference = r.groupBy("k").agg(F.avg("x").alias("ref"))
    r = r.withColumn("at", F.col("lo") + (F.col("ties") - 1) / 2)
    low, high = reference.select(F.col("k").alias("kl"), F.col("ref").alias("rl")), reference.select(F.col("k").alias("kh"), F.col("ref").alias("rh"))
    out = r.join(low, F.floor("at") == F.col("kl")).join(high, F.ceil("at") == F.col("kh"))
    return out.withColumn("x", (F.col("rl") + F.col("rh")) / 2).select(*df.columns)


def vsn_normalize(df: DataFrame, optimize: bool = False, rounds: int = 500) -> DataFrame:
    """asinh of the linear value over the sample's median: variance-stabilised, no longer log2.

    With ``optimize`` each sample's factor is searched from 1 / median (``vsn_search``).
    """
    linear = F.pow(F.lit(2.0), F.col("x"))
    if optimize:
        d = Scratch(df.sparkSession, "vsn").table(df, "input")
        factors = vsn_search(d, rounds).select("sample", "factor")
        return d.join(factors, "sample").withColumn("x", F.asinh(F.col("factor") * linear)).drop("factor")
    med = df.groupBy("sample").agg(F.median(linear).alias("med"))
    return df.join(med, "sample").withColumn("x", F.asinh(linear / F.col("med"))).drop("med")


def vsn_windows(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(sample, window, v): linear values by rank in windows of a twentieth of the sample (100 values at least) that begin a quarter window apart.

    A value is in four windows at most. Only whole windows that begin before the last
    possible place count, so a sample of 100 values or fewer has none.
    """
    seen = df.where(F.col("x").isNotNull() & ~F.isnan("x")).select("sample", F.pow(F.lit(2.0), F.col("x")).alias("v"))
    ranked = numbered(seen, "sample", "v", within=("sample",), name="rank", scratch=scratch)
    ranked = scratch.table(ranked, "ranked")
    sizes = ranked.groupBy("sample").agg(F.max("rank").alias("n"))
    r = ranked.join(F.broadcast(sizes), "sample")  # one row a run
    size = F.expr("greatest(100, n div 20)")
    r = r.withColumn("size", size).withColumn("step", F.expr("size div 4")).withColumn("many", F.expr("CASE WHEN n > size THEN (n - size + step - 1) div step ELSE 0 END"))
    first, last = F.expr("greatest(0, (rank - 1 - size + step) div step)"), F.expr("least(many - 1, (rank - 1) div step)")
    r = r.withColumns({"first": F.when(F.col("rank") <= F.col("size"), 0).otherwise(first), "last": last}).where("first <= last")
    return scratch.table(r.select("sample", F.explode(F.sequence("first", "last")).alias("window"), "v"), "windows")


def vsn_evenness(windows: DataFrame, factors: DataFrame) -> DataFrame:
    """(sample, k, cost): relative spread of the windows' variances of asinh(factor * v), for each factor of the sample.

    ``factors``: (sample, factors array), one row a run. Factors of 0 or less, fewer
    than two windows and windows that do not vary cost 1e6.
    """
    rows = windows.join(F.broadcast(factors), "sample").select("sample", "window", "v", F.posexplode("factors").alias("k", "a"))
    per = rows.groupBy("sample", "k", "a", "window").agg(F.var_pop(F.asinh(F.col("a") * F.col("v"))).alias("var"))
    even = per.groupBy("sample", "k", "a").agg(F.count("*").alias("n"), F.stddev_pop("var").alias("sd"), F.avg("var").alias("mean"))
    return even.select("sample", "k", F.when((F.col("a") > 0) & (F.col("n") > 1) & (F.col("mean") > 0), F.col("sd") / F.col("mean")).otherwise(search.WORST).alias("cost"))


def vsn_search(df: DataFrame, rounds: int = 500) -> DataFrame:
    """(sample, start, factor, cost): for each sample the factor that makes the windows' variances most even.

    All samples' simplices move together: a round is one job that rates what each of
    them may ask for, and its result is a few numbers a run. A sample that has not
    settled after ``rounds`` keeps 1 / median.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "vsn")
    linear = F.pow(F.lit(2.0), F.col("x"))
    med = {r["sample"]: r["med"] for r in df.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("sample").agg(F.median(linear).alias("med")).collect()}
    start = {s: 1.0 / m if m > 0 else 1.0 for s, m in med.items()}
    windows = vsn_windows(df, scratch)
    kind = df.schema["sample"].dataType.simpleString()

    def rated(asked: dict) -> dict:
        factors = spark.createDataFrame([(s, [float(v) for v in p]) for s, p in asked.items()], f"sample {kind}, factors array<double>")
        got = {s: np.full(len(p), search.WORST) for s, p in asked.items()}
        for r in vsn_evenness(windows, factors).collect():
            got[r["sample"]][r["k"]] = r["cost"]
        return got

    state, done = {}, {}
    simplices = {s: search.first_simplex([v]) for s, v in start.items()}
    for s, cost in rated({s: p[:, 0] for s, p in simplices.items()}).items() if simplices else ():
        order = np.argsort(cost, kind="stable")
        state[s] = (simplices[s][order], cost[order])
    for n in range(rounds + 1):
        for s in [s for s, (p, c) in state.items() if search.settled(p, c)]:
            p, c = state.pop(s)
            done[s] = (float(p[0, 0]), float(c[0]))
        if not state or n == rounds:
            break
        points = {s: search.offered(p) for s, (p, _) in state.items()}
        for s, cost in rated({s: p[:, 0] for s, p in points.items()}).items():
            state[s] = search.stepped(*state[s], points[s], cost)
    scratch.clean()
    rows = [(s, start[s], *done.get(s, (start[s], None))) for s in start]
    return spark.createDataFrame(rows, f"sample {kind}, start double, factor double, cost double")


def rt_range(df: DataFrame) -> tuple[float, float] | None:
    lo, hi = df.agg(F.min("rt"), F.max("rt")).first()
    return None if lo is None else (float(lo), float(hi))


def lowess_curves(df: DataFrame, frac: float = 0.3, grid_points: int = 100, min_points: int = 20, span: tuple[float, float] | None = None, most_points: int = 1 << 16) -> DataFrame:
    """(sample, i, rt, fit): each sample's curve on one common grid; null outside the sample's own range.

    A curve needs the sample's points in order. Samples of up to ``most_points`` are
    fitted whole, one task each; longer ones spread over tasks (``spread_lowess``),
    which gives the same curve in more passes.
    """
    span = span or rt_range(df)
    schema = "sample {}, i int, rt double, fit double".format(df.schema["sample"].dataType.simpleString())
    if span is None:
        return df.sparkSession.createDataFrame([], schema)
    grid = np.linspace(*span, grid_points)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=["rt", "x"]).sort_values(["rt", "x"], kind="stable")
        fit = np.full(grid_points, np.nan)
        if len(p) >= min_points:
            x, y = p["rt"].to_numpy(float), p["x"].to_numpy(float)
            curve = lowess(x, y, frac, 3, 0.01 * (x[-1] - x[0]))
            inside = (grid >= x[0]) & (grid <= x[-1])
            keep = np.r_[True, np.diff(x) > 0]
            fit[inside] = np.interp(grid[inside], x[keep], curve[keep])
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "i": np.arange(grid_points), "rt": grid, "fit": fit})

    points = df.select("sample", F.col("rt").cast("double").alias("rt"), F.col("x").cast("double").alias("x"))
    sizes = points.groupBy("sample").agg(F.count("*").alias("_n"))
    long = [r[0] for r in sizes.where(F.col("_n") > most_points).select("sample").collect()]  # one name a run
    short = points if not long else points.where(~F.col("sample").isin(long))
    curves = short.groupBy("sample").applyInPandas(one, schema)
    if long:
        rest = points.where(F.col("sample").isin(long) & F.col("rt").isNotNull() & ~F.isnan("rt") & F.col("x").isNotNull() & ~F.isnan("x"))
        anchors = spread_lowess.fit_anchors(rest.select("sample", F.col("rt").alias("x"), F.col("x").alias("y")), frac)
        curves = curves.unionByName(spread_lowess.grid_values(anchors.where(F.col("n") >= min_points), grid))
    return curves.withColumn("fit", F.when(~F.isnan("fit"), F.col("fit")))


def rt_lowess_normalize(df: DataFrame, frac: float = 0.3, grid_points: int = 100) -> DataFrame:
    """x minus the sample's curve plus the median curve; outside a sample's range x stays.

    The input is written once, so that what made it runs once; the curves come back
    as one array per sample.
    """
    d = Scratch(df.sparkSession, "lowess").table(df, "input")
    span = rt_range(d)
    if span is None:
        return df
    curves = lowess_curves(d, frac, grid_points, span=span)
    shared = curves.groupBy("i").agg(F.median("fit").alias("all"))
    shift = curves.join(shared, "i").groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("fit") - F.col("all")).alias("s")))), lambda p: p["s"]).alias("_s"))
    step = (span[1] - span[0]) / (grid_points - 1) or 1.0
    at = (F.col("rt") - span[0]) / step
    i = F.least(F.floor(at), F.lit(grid_points - 2)).cast("int")
    correction = F.coalesce(F.get("_s", i) * (1 - (at - i)) + F.get("_s", i + 1) * (at - i), F.lit(0.0))
    return d.join(shift, "sample", "left").withColumn("x", F.col("x") - correction).select(*df.columns)


def reference_statistics(df: DataFrame, reference: list[str]) -> DataFrame:
    """Per feature over the reference samples: mean, spread, count, median rt and linear CV (0 where undefined)."""
    linear = F.pow(F.lit(2.0), F.col("x"))
    s = df.where(F.col("sample").isin(reference)).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), F.median("rt").alias("rt"), F.try_divide(F.stddev_samp(linear), F.avg(linear)).alias("cv"))
    return s.withColumn("cv", F.coalesce("cv", F.lit(0.0)))


def _reference_residuals(df: DataFrame, stats: DataFrame, reference: list[str], by: str | None) -> DataFrame:
    """(group, rt, residual) of the reference samples: rt is the features' median among the references."""
    r = df.where(F.col("sample").isin(reference) & F.col("x").isNotNull()).join(stats.select("feature", F.col("mean").alias("_m"), F.col("rt").alias("_rt")), "feature")
    group = F.col(by) if by else F.lit(0)
    return r.where("_rt IS NOT NULL AND _m IS NOT NULL").select(group.alias("group"), F.col("_rt").alias("rt"), (F.col("x") - F.col("_m")).alias("residual"))


def _with_curve(df: DataFrame, stats: DataFrame, curves: DataFrame, by: str | None, value) -> DataFrame:
    """x minus ``value``, an expression of _rt and the columns of ``curves`` (one row per group); rows without either keep x."""
    d = df.join(stats.select("feature", F.col("rt").alias("_rt")), "feature", "left").withColumn("_group", F.col(by) if by else F.lit(0))
    return d.join(curves.withColumnRenamed("group", "_group"), "_group", "left").withColumn("x", F.col("x") - F.coalesce(value, F.lit(0.0))).select(*df.columns)


def rt_binned_correction(df: DataFrame, stats: DataFrame, reference: list[str], by: str | None = "batch", bins: int = 20) -> DataFrame:
    """Subtract the references' binned median residual, one curve per batch (or one for all if ``by`` is None).

    Bins are equal and half open over the references' own times, so the very last
    time is in none; an empty bin counts as 0; between bin centres the curve is
    linear, beyond the outer ones constant. Batches without references stay.
    """
    r = _reference_residuals(df, stats, reference, by)
    span = r.groupBy("group").agg(F.min("rt").alias("lo"), ((F.max("rt") - F.min("rt")) / bins).alias("width")).where("width > 0")
    binned = r.join(span, "group").withColumn("bin", F.floor((F.col("rt") - F.col("lo")) / F.col("width")).cast("int")).where(F.col("bin") < bins)
    medians = binned.groupBy("group", "bin").agg(F.median("residual").alias("c")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    curves = span.join(medians, "group").select("group", F.col("lo").alias("_lo"), F.col("width").alias("_w"), F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("_c"))
    at = F.greatest(F.least((F.col("_rt") - F.col("_lo")) / F.col("_w") - 0.5, F.lit(bins - 1.0)), F.lit(0.0))
    i = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
    return _with_curve(df, stats, curves, by, F.get("_c", i) * (1 - (at - i)) + F.get("_c", i + 1) * (at - i))


def spline_basis(t: Column, knots: list[float]) -> list[Column]:
    return [F.lit(1.0), t, t * t, t * t * t, *[F.pow(F.greatest(t - k, F.lit(0.0)), F.lit(3.0)) for k in knots]]


def rt_spline_correction(df: DataFrame, stats: DataFrame, reference: list[str], by: str | None = "batch", df_: int = 5, most_knots: int = 31) -> DataFrame:
    """Subtract a cubic smoothing spline of the references' residuals over rt, one per batch (or one for all if ``by`` is None).

    The smoothing rule is a residual sum of squares of at most n - ``df_``: the
    cubic polynomial if it meets that, else a cubic spline with 1, 3, 7... knots at
    quantiles, the first number that does. Only the sums of products of basis
    columns leave the executors, one row per batch and try. Batches with fewer than
    ``df_`` + 1 points or without references stay.
    """
    lo, hi = stats.agg(F.min("rt"), F.max("rt")).first()
    if lo is None:
        return df
    t = (F.lit(2.0) * (F.col("rt") - lo) / (float(hi - lo) or 1.0) - 1).alias("t")
    scratch = Scratch(df.sparkSession, "spline")
    points = scratch.table(_reference_residuals(df, stats, reference, by).select("group", t, F.col("residual").alias("y")), "points")
    kind, fits, open_, n_knots = points.schema["group"].dataType.simpleString(), {}, None, 0
    while open_ is None or (open_ and n_knots <= most_knots):
        rows = points if open_ is None else points.where(F.col("group").isin(list(open_)))
        knots: list[float] = []
        if n_knots:
            knots = [float(k) for k in points.agg(F.percentile_approx("t", [(i + 1) / (n_knots + 1) for i in range(n_knots)], 10_000)).first()[0]]
        basis = spline_basis(F.col("t"), knots)
        cross = [F.sum(a * b) for i, a in enumerate(basis) for b in basis[i:]]
        got = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*[F.sum(b * F.col("y")) for b in basis]).alias("by"), F.array(*cross).alias("bb")).where(F.col("n") > df_).collect()
        open_ = set()
        for r in got:
            gram = np.zeros((len(basis),) * 2)
            gram[np.triu_indices(len(basis))] = r["bb"]
            gram = gram + np.triu(gram, 1).T
            right = np.array(r["by"])
            coef = np.linalg.lstsq(gram, right, rcond=1e-13)[0]
            fits[r["group"]] = (knots, [float(c) for c in coef])
            if r["yy"] - 2 * coef @ right + coef @ gram @ coef > r["n"] - df_:
                open_.add(r["group"])
        n_knots = 2 * n_knots + 1
    if not fits:
        return df
    curves = df.sparkSession.createDataFrame([(g, k, c) for g, (k, c) in fits.items()], f"group {kind}, _k array<double>, _c array<double>")
    at = F.lit(2.0) * (F.col("_rt") - lo) / (float(hi - lo) or 1.0) - 1
    line = F.get("_c", 0) + at * (F.get("_c", 1) + at * (F.get("_c", 2) + at * F.get("_c", 3)))
    bends = F.aggregate(F.zip_with("_k", F.slice("_c", F.lit(5), F.greatest(F.size("_k"), F.lit(1))), lambda k, c: c * F.pow(F.greatest(at - k, F.lit(0.0)), F.lit(3.0))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return _with_curve(df, stats, curves, by, line + bends)


def normalize_with_references(df: DataFrame, sample_types: tuple[str, str] = ("reference", "qc"), rt: str | None = "spline", method: str = "median", correct_batches: bool = True) -> DataFrame:
    """The older pipeline: reference statistics, RT correction, global normalisation, batch correction that is kept only if it passes.

    ``df`` has feature, sample, batch, sample_type, rt and x.
    """
    from .combat import corrected_or_original

    names = [r[0] for r in df.where(F.col("sample_type") == sample_types[0]).select("sample").distinct().orderBy("sample").collect()]
    if names and rt:
        stats = reference_statistics(df, names)
        df = {"spline": rt_spline_correction, "binned": rt_binned_correction}[rt](df, stats, names)
    df = normalize(df, method)
    return corrected_or_original(df) if correct_batches else df.withColumn("corrected", F.lit(False))


def sample_outliers(df: DataFrame, multiplier: float = 1.5, fold: float = 0.1) -> DataFrame:
    """(sample, linear_median, low_limit, fold_limit, outlier): one-sided, on linear medians."""
    med = df.groupBy("sample").agg(F.median(F.pow(F.lit(2.0), F.col("x"))).alias("linear_median"))
    q = med.agg(F.percentile("linear_median", F.lit(0.25)).alias("q1"), F.percentile("linear_median", F.lit(0.75)).alias("q3"), F.median("linear_median").alias("mid"))
    out = med.join(q, F.lit(True)).select("sample", "linear_median", (F.col("q1") - multiplier * (F.col("q3") - F.col("q1"))).alias("low_limit"), (fold * F.col("mid")).alias("fold_limit"))
    return out.withColumn("outlier", (F.col("linear_median") < F.col("low_limit")) | (F.col("linear_median") < F.col("fold_limit")))


def normalize(df: DataFrame, method: str = "median", **options) -> DataFrame:
    """Dispatch by name; an unknown name falls back to the median, as none leaves the data alone."""
    if method == "none":
        return df
    known = {"median": median_normalize, "quantile": quantile_normalize, "vsn": vsn_normalize, "rt_lowess": rt_lowess_normalize}
    return known.get(method, median_normalize)(df, **options)
