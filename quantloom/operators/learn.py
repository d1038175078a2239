"""Rollup parameters learned on reference samples.

What the objective needs of a feature is written once, one row a feature. A generation
of candidates is an array of parameter rows that is exploded beside each feature, rated
there and reduced to one median a candidate: one Spark job, whose only shuffle holds a
number for each feature and candidate. Only candidates' costs reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from .search import gradient_search, simplex_search

#: Start of the variance search: log of alpha, beta, gamma, delta; exponent; log of the co-elution penalty.
VARIANCE_START = (0.0, -4.6, 4.6, 0.0, 2.0, 2.3)
VARIANCE_DEFAULTS = {"alpha": 1.0, "beta": 0.01, "gamma": 100.0, "delta": 1.0, "shape_exponent": 2.0, "coelution_penalty": 10.0}


def rated(features: DataFrame, points: list[np.ndarray], cost: Callable[[DataFrame, list[Column]], DataFrame]) -> list[float | None]:
    """Median over features of the column ``cost`` at each point (null where no feature has one), in one job."""
    candidates = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in points])
    rows = features.select("*", F.posexplode(candidates).alias("_k", "_p"))
    got = cost(rows, [F.element_at("_p", i + 1) for i in range(len(points[0]))]).groupBy("_k").agg(F.median("cost").alias("c")).collect()
    found = {r["_k"]: r["c"] for r in got}
    return [found.get(k) for k in range(len(points))]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _weighted(rows: DataFrame, weight: Callable[[Column], Column], total: Column) -> DataFrame:
    """Adds ``_v``: of each column the sum of its values by the traits' weights, which are scaled to ``total``.

    Each step is a column of its own: inside lambdas nothing is worked out twice.
    """
    w = rows.withColumn("_w", F.transform("traits", weight)).withColumn("_all", _sum(F.col("_w")))
    w = w.withColumn("_w", F.transform("_w", lambda v: v * (total / F.col("_all"))))
    return w.withColumn("_v", F.transform("columns", lambda c: _sum(F.zip_with(c, "_w", lambda x, y: x * y))))


def _with_spread(rows: DataFrame, sample: bool) -> DataFrame:
    """Adds the mean and the standard deviation (of a sample, or of all) of the array ``_v``."""
    rows = rows.withColumn("_n", F.size("_v")).withColumn("_mean", F.try_divide(_sum(F.col("_v")), F.col("_n").cast("double")))
    square = F.aggregate("_v", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean")))
    return rows.withColumn("_sd", F.sqrt(F.try_divide(square, (F.col("_n") - int(sample)).cast("double"))))


def _by_feature(t: DataFrame, traits: list[str], min_transitions: int) -> DataFrame:
    """(feature, t): transitions in order with their traits and their cells as a map; features of enough transitions."""
    f = t.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("transition", *traits, "cells"))).alias("t")).where(F.size("t") >= min_transitions)
    return f.withColumn("t", F.transform("t", lambda r: F.struct(*[r[c].alias(c) for c in traits], F.map_from_entries(r["cells"]).alias("cells"))))


def variance_summary(m: DataFrame, min_transitions: int = 3) -> DataFrame:
    """A row a feature: traits of its transitions (intensity, shape, coeluting) and, for each sample that has all of them, their log2 values.

    Intensities are medians over samples; shape and co-elution are means weighted by
    linear intensity, 0.5 where no cell has them.
    """
    linear = F.pow(F.lit(2.0), F.col("x"))

    def weighted(name: str) -> Column:
        if name not in m.columns:
            return F.lit(None).cast("double")
        v = F.col(name).cast("double")
        seen = v.isNotNull() & ~F.isnan(v) & F.col("x").isNotNull()
        return F.coalesce(F.try_divide(F.sum(F.when(seen, linear * v)), F.sum(F.when(seen, linear))), F.lit(0.5))

    t = m.groupBy("feature", "transition").agg(
        F.median(linear).alias("intensity"), weighted("shape").alias("shape"), weighted("coeluting").alias("coeluting"),
        F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("cells"),
    )
    f = _by_feature(t, ["intensity", "shape", "coeluting"], min_transitions)
    samples = F.array_sort(F.array_distinct(F.flatten(F.transform("t", lambda r: F.map_keys(r["cells"])))))
    columns = F.transform(samples, lambda s: F.transform("t", lambda r: F.try_element_at(r["cells"], s)))
    full = F.filter(columns, lambda c: ~F.exists(c, lambda v: v.isNull() | F.isnan(v)))
    return f.select("feature", F.transform("t", lambda r: F.struct(r["intensity"].alias("i"), r["shape"].alias("s"), (r["coeluting"] > 0.5).alias("c"))).alias("traits"), full.alias("columns"), F.size(samples).alias("n_samples"))


def variance_cost(rows: DataFrame, p: list[Column]) -> DataFrame:
    """Adds ``cost``: CV of a feature's inverse-variance weighted mean over its samples; null where it does not vary."""
    q = rows.withColumn("_q", F.array(*[F.exp(c) for c in p[:4]], p[4], F.exp(p[5])))
    alpha, beta, gamma, delta, exponent, penalty = (F.element_at("_q", i + 1) for i in range(6))

    def weight(t: Column) -> Column:
        i = F.greatest(t["i"], F.lit(1.0))
        poor = F.when(t["s"].isNull(), 1.0).otherwise(1 + delta * (F.pow(1 / F.greatest(t["s"], F.lit(0.01)), exponent) - 1))
        late = F.when(F.coalesce(t["c"], F.lit(True)), 1.0).otherwise(penalty)
        return t["i"] * t["i"] / ((alpha * i + beta * i * i + gamma) * poor * late)

    d = _with_spread(_weighted(q, weight, F.lit(1.0)), sample=False)
    varies = (F.col("n_samples") >= 2) & (F.col("_sd") > 1e-12)  # beyond rounding
    return d.withColumn("cost", F.when(varies, F.try_divide(F.col("_sd"), F.abs("_mean"))))


@dataclass
class LearnedVariance:
    params: dict[str, float]
    cv_before: float | None
    cv_after: float | None


def learn_variance(m: DataFrame, reference: list[str], rounds: int = 50, min_transitions: int = 3) -> LearnedVariance:
    """The six parameters of the variance model that minimise the median CV of weighted means over the reference samples.

    ``m``: feature, transition, sample, x (log2) and, if known, shape and coeluting.
    Parameters of a quality that is not given keep their defaults, and all do with
    fewer than two reference samples.
    """
    rows = m.where(F.col("sample").isin(reference))
    if rows.select("sample").distinct().count() < 2:
        return LearnedVariance(dict(VARIANCE_DEFAULTS), None, None)
    scratch = Scratch(m.sparkSession, "variance")
    features = scratch.table(variance_summary(rows, min_transitions), "features")
    rate = lambda points: [1.0 if v is None else v for v in rated(features, points, variance_cost)]
    best, after = simplex_search(rate, VARIANCE_START, rounds)
    (before,) = rate([np.array(VARIANCE_START)])
    scratch.drop(features)
    found = dict(zip(VARIANCE_DEFAULTS, map(float, np.r_[np.exp(best[:4]), best[4], np.exp(best[5])])))
    kept = ([] if "shape" in m.columns else ["delta", "shape_exponent"]) + ([] if "coeluting" in m.columns else ["coelution_penalty"])
    return LearnedVariance(found | {k: VARIANCE_DEFAULTS[k] for k in kept}, before, after)


def adaptive_traits(cells: DataFrame, low: float = 0.5, min_transitions: int = 3) -> DataFrame:
    """A row a feature of enough transitions: m/z and share of low shape of each, and its columns of areas, for each sample.

    ``cells``: feature, transition, sample, area (linear), and mz and shape if known.
    Precursor ions are left out. An area that is missing or negative is null.
    """
    mz = F.coalesce(F.first("mz", ignorenulls=True).cast("double"), F.lit(0.0)) if "mz" in cells.columns else F.lit(0.0)
    poor = F.avg((F.coalesce("shape", F.lit(1.0)) < low).cast("double")) if "shape" in cells.columns else F.lit(0.0)
    area = F.when((F.col("area") >= 0) & ~F.isnan("area"), F.col("area").cast("double"))
    own = cells.where(~F.col("transition").cast("string").startswith("precursor"))
    t = own.groupBy("feature", "transition").agg(mz.alias("mz"), poor.alias("low"), F.array_sort(F.collect_list(F.struct("sample", area.alias("area")))).alias("cells"))
    f = _by_feature(t, ["mz", "low"], min_transitions)
    samples = F.array_sort(F.array_distinct(F.flatten(F.transform("t", lambda r: F.map_keys(r["cells"])))))
    columns = F.transform(samples, lambda s: F.transform("t", lambda r: F.try_element_at(r["cells"], s)))
    enough = F.filter(columns, lambda c: F.size(F.array_compact(c)) >= min_transitions)
    return f.select("feature", F.transform("t", lambda r: F.struct(r["mz"].alias("mz"), r["low"].alias("low"))).alias("traits"), F.transform(enough, lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(0.0)))).alias("columns"))


def mz_range(features: DataFrame) -> tuple[float, float]:
    lo, hi = features.select(F.explode("traits.mz").alias("mz")).where("mz > 0").agg(F.min("mz"), F.max("mz")).first()
    return (0.0, 2000.0) if lo is None or features.isEmpty() else (float(lo), float(hi))


def adaptive_cost(mz: tuple[float, float]) -> Callable[[DataFrame, list[Column]], DataFrame]:
    """CV over samples of the weighted sum of areas, by weights exp(beta_mz * m/z + beta_low * share of low shape); null where the mean is 1 or less."""

    def cost(rows: DataFrame, p: list[Column]) -> DataFrame:
        def weight(t: Column) -> Column:
            place = F.greatest(F.least((t["mz"] - mz[0]) / (mz[1] - mz[0]), F.lit(1.0)), F.lit(0.0)) if mz[1] > mz[0] else F.lit(0.0)
            return F.exp(F.greatest(F.least(p[0] * place + p[1] * t["low"], F.lit(50.0)), F.lit(-50.0)))

        d = _weighted(rows, weight, F.size("traits").cast("double"))
        d = _with_spread(d.withColumn("_v", F.transform("_v", lambda v: F.greatest(v, F.lit(1.0)))), sample=True)
        return d.withColumn("cost", F.when(F.col("_mean") > 1, F.col("_sd") / F.col("_mean")))

    return cost


@dataclass
class LearnedAdaptive:
    """``betas`` for ``adaptive_weights`` (mz_scaled, shape_low), the m/z range that scales them, whether to use them and why not."""

    betas: dict[str, float]
    mz_range: tuple[float, float] = (0.0, 2000.0)
    use: bool = False
    reference_cv: tuple[float | None, float | None] = (None, None)
    qc_cv: tuple[float | None, float | None] = (None, None)
    reason: str | None = None
    seen: int = field(default=0)


def _gain(before: float | None, after: float | None) -> float:
    return (before - after) / before * 100 if before and before > 0 and after is not None else 0.0


def learn_adaptive(cells: DataFrame, reference: list[str], qc: list[str], rounds: int = 20, min_improvement: float = 0.1, worse: float = 1.05, low: float = 0.5, min_transitions: int = 3, bounds: tuple[tuple[float, float], ...] = ((-1.0, 1.0), (-1.0, 0.0))) -> LearnedAdaptive:
    """Betas of m/z and of low shape that minimise the median CV of the reference samples; checked on the qc samples.

    The sum (betas 0) is the baseline, and the best point seen counts. Weights are
    used if the reference gains ``min_improvement`` percent and the qc does too;
    without two qc samples the reference decides.
    """
    none = {"mz_scaled": 0.0, "shape_low": 0.0}
    if len(set(reference)) < 2:
        return LearnedAdaptive(none, reason="fewer than two reference samples")
    scratch = Scratch(cells.sparkSession, "adaptive")
    features = scratch.table(adaptive_traits(cells.where(F.col("sample").isin(reference)), low, min_transitions), "reference")
    mz, count = mz_range(features), [0]

    def rate(points: list[np.ndarray]) -> list[float | None]:
        count[0] += len(points)
        return rated(features, points, adaptive_cost(mz))

    (before,) = rate([np.zeros(2)])
    best, after = gradient_search(lambda ps: [1.0 if v is None else v for v in rate(ps)], (0.0, 0.0), bounds, rounds)
    if before is None or not after < before:
        best, after = np.zeros(2), before
    betas, gain = dict(zip(none, map(float, best))), _gain(before, after)
    out = LearnedAdaptive(betas, mz, False, (before, after), (None, None), None, count[0])
    if len(set(qc)) >= 2:
        held = scratch.table(adaptive_traits(cells.where(F.col("sample").isin(qc)), low, min_transitions), "qc")
        out.qc_cv = tuple(rated(held, [np.zeros(2), best], adaptive_cost(mz)))
    if gain < min_improvement:
        out.reason = "no improvement on the reference samples"
    elif len(set(qc)) < 2:
        out.use = True
    elif _gain(*out.qc_cv) >= min_improvement:
        out.use = True
    elif out.qc_cv[1] is not None and out.qc_cv[1] > out.qc_cv[0] * worse:
        out.reason = "the qc samples got worse"
    else:
        out.reason = "no improvement on the qc samples"
    scratch.drop(features)
    return out
