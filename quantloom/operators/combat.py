"""Batch effects: empirical-Bayes correction from sufficient statistics, evaluation, batch estimation.

Input is long: (feature, sample, batch, x[, fit]). Everything but the posterior
iteration is aggregation: a feature needs count, mean and sum of squares in each
batch, taken in one pass. The posterior of a (feature, batch) is iterated by itself
from three numbers and its batch's priors, wherever its row happens to be; only
the round at which a batch stops is shared, a maximum over features taken in a
second, equally cheap pass. No task holds a batch.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

ROUNDS, TOLERANCE = 100, 1e-4


def check_batches(df: DataFrame) -> None:
    small = [r["batch"] for r in df.groupBy("batch").agg(F.countDistinct("sample").alias("n")).where("n < 2").orderBy("batch").collect()]
    if small:
        raise ValueError(f"batches of a single sample: {', '.join(map(str, small))}")


def batch_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("batch").agg(F.countDistinct("sample").alias("n_b"))


def cell_sums(df: DataFrame) -> DataFrame:
    """(feature, batch, c, m, ss, n_b): count, mean and squares about it of a feature in a batch, and the batch's size."""
    per = df.where(F.col("x").isNotNull()).groupBy("feature", "batch").agg(F.count("x").alias("c"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss"))
    return per.join(batch_sizes(df), "batch")


def scale_of(sums: DataFrame) -> DataFrame:
    """(feature, grand, var): of features seen in every batch with some variance.

    The grand mean weighs batch means by batch sizes, seen or not; the pooled
    variance is the population variance about batch means, a non-positive one
    replaced by the median of the positive ones.
    """
    totals = sums.select("batch", "n_b").distinct().agg(F.sum("n_b").alias("n_all"), F.count("*").alias("n_batches"))
    per = sums.join(totals, F.lit(True))
    whole = per.groupBy("feature").agg(F.sum(F.col("n_b") / F.col("n_all") * F.col("m")).alias("grand"), (F.sum("ss") / F.sum("c")).alias("var"), F.count("*").alias("seen"), F.max("n_batches").alias("n_batches"), F.max("m").alias("top"), F.min("m").alias("bottom"))
    whole = whole.where("seen = n_batches AND (var > 0 OR top <> bottom)")
    middle = whole.where("var > 0").agg(F.median("var").alias("mid"))
    return whole.join(middle, F.lit(True)).select("feature", "grand", F.when(F.col("var") > 0, F.col("var")).otherwise(F.col("mid")).alias("var"))


def effects_of(sums: DataFrame, scale: DataFrame) -> DataFrame:
    """(feature, batch, c, gamma, ss, delta, estimable) of standardised values."""
    e = sums.join(scale, "feature").select("feature", "batch", "c", ((F.col("m") - F.col("grand")) / F.sqrt("var")).alias("gamma"), (F.col("ss") / F.col("var")).alias("ss"))
    return with_scale_estimates(e)


def with_scale_estimates(e: DataFrame) -> DataFrame:
    """Add delta, the sample variance, and whether it can be told from zero; else delta is 1."""
    delta = F.try_divide(F.col("ss"), F.col("c") - 1)
    usable = (F.col("c") >= 2) & (F.sqrt(delta) > 1e-12 * F.greatest(F.abs("gamma"), F.lit(1.0)))
    return e.withColumn("estimable", F.coalesce(usable, F.lit(False))).withColumn("delta", F.when(F.col("estimable"), delta).otherwise(1.0))


def standardization(df: DataFrame) -> DataFrame:
    return scale_of(cell_sums(df))


def batch_effects(df: DataFrame, scale: DataFrame) -> DataFrame:
    return effects_of(cell_sums(df), scale)


def priors(effects: DataFrame) -> DataFrame:
    """(batch, g_bar, tau2, a, b): moments of the locations; inverse-gamma parameters of the estimable scales.

    Scales that are all equal (a lone replicated batch is scaled by itself) are the
    limit of ever smaller spread: the prior then fixes them, whatever rounding leaves.
    """
    d = F.when(F.col("estimable"), F.col("delta"))
    p = effects.groupBy("batch").agg(F.avg("gamma").alias("g_bar"), F.coalesce(F.var_samp("gamma"), F.lit(0.0)).alias("tau2"), F.avg(d).alias("m"), F.when(F.count(d) > 1, F.var_samp(d)).alias("v"))
    ok = (F.col("m") > 0) & (F.col("v") > 0)
    ratio = F.try_divide(F.col("m") * F.col("m"), F.col("v"))
    p = p.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest("v", 1e-24 * F.col("m") * F.col("m"))))
    return p.select("batch", "g_bar", "tau2", F.when(ok, ratio + 2).otherwise(1.0).alias("a"), F.when(ok, F.col("m") * (ratio + 1)).otherwise(1.0).alias("b"))


def eb_rounds(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gamma, delta, relative change) of each row after each round."""
    c, hat, ss, delta, mean, tau2, a, b = (part.column(k).to_numpy().astype(float) for k in ("c", "gamma", "ss", "delta", "g_bar", "tau2", "a", "b"))
    known = part.column("estimable").to_numpy(zero_copy_only=False)
    gamma = hat
    for _ in range(ROUNDS):
        new = (tau2 * c * hat + delta * mean) / (tau2 * c + delta)
        spread = np.where(known, (0.5 * (ss + c * (hat - new) ** 2) + b) / (0.5 * c + a - 1), 1.0)
        change = np.maximum(np.abs(new - gamma) / np.maximum(np.abs(gamma), 1e-12), np.abs(spread - delta) / np.maximum(delta, 1e-12))
        gamma, delta = new, spread
        yield gamma, delta, change


def _largest_changes(batches):
    """Largest change of each batch in each round, over the rows of one Arrow batch."""
    for part in batches:
        coded = part.column("batch").dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        for k, (_, _, change) in enumerate(eb_rounds(part)):
            most = np.zeros(n)
            np.maximum.at(most, code, change)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(n, k + 1, np.int32)), pa.array(most)], ["batch", "round", "change"])


def _after_rounds(batches):
    """Location and scale of each row after its batch's number of rounds."""
    for part in batches:
        last = part.column("rounds").to_numpy()
        gamma, delta = np.zeros(part.num_rows), np.ones(part.num_rows)
        for k, (g, d, _) in enumerate(eb_rounds(part)):
            now = last == k + 1
            gamma[now], delta[now] = g[now], d[now]
        yield pa.RecordBatch.from_arrays([part.column("feature"), part.column("batch"), pa.array(gamma), pa.array(delta)], ["feature", "batch", "gamma_star", "delta_star"])


def posterior(effects: DataFrame, mean_only: bool = False) -> DataFrame:
    """(feature, batch, gamma_star, delta_star); ``effects`` should be a written table, it is read three times.

    All features of a batch stop after the same round: the first in which none of
    them changes by ``TOLERANCE`` of itself, ``ROUNDS`` at most.
    """
    e = effects.join(priors(effects), "batch")
    if mean_only:
        pull = F.col("tau2") * F.col("c")
        return e.select("feature", "batch", ((pull * F.col("gamma") + F.col("g_bar")) / (pull + 1)).alias("gamma_star"), F.lit(1.0).alias("delta_star"))
    kind, batch_kind = (effects.schema[c].dataType.simpleString() for c in ("feature", "batch"))
    change = e.mapInArrow(_largest_changes, f"batch {batch_kind}, round int, change double").groupBy("batch", "round").agg(F.max("change").alias("change"))
    stop = change.groupBy("batch").agg(F.coalesce(F.min(F.when(F.col("change") < TOLERANCE, F.col("round"))), F.lit(ROUNDS)).alias("rounds"))
    return e.join(stop, "batch").mapInArrow(_after_rounds, f"feature {kind}, batch {batch_kind}, gamma_star double, delta_star double")


def shrunken(effects: DataFrame) -> DataFrame:
    """The non-parametric variant: locations and scales shrunk by var / (var + 1) of their batch."""
    p = effects.groupBy("batch").agg(F.avg("gamma").alias("gm"), F.var_pop("gamma").alias("gv"), F.avg("delta").alias("dm"), F.var_pop("delta").alias("dv"))
    e = effects.join(p, "batch")
    mixed = lambda v, m, s: F.col(s) / (F.col(s) + 1) * F.col(v) + F.col(m) / (F.col(s) + 1)
    return e.select("feature", "batch", mixed("gamma", "gm", "gv").alias("gamma_star"), mixed("delta", "dm", "dv").alias("delta_star"))


def adjust(df: DataFrame, scale: DataFrame, post: DataFrame, ref_batch: str | None = None) -> DataFrame:
    """Apply the correction; features without statistics and the reference batch pass through."""
    joined = df.join(scale, "feature", "left").join(post, ["feature", "batch"], "left")
    s = (F.col("x") - F.col("grand")) / F.sqrt("var")
    new = (s - F.col("gamma_star")) / F.sqrt("delta_star") * F.sqrt("var") + F.col("grand")
    keep: Column = F.col("gamma_star").isNull()
    if ref_batch is not None:
        keep = keep | (F.col("batch") == ref_batch)
    return joined.withColumn("x", F.when(keep, F.col("x")).otherwise(new)).select(*df.columns)


def combat(df: DataFrame, parametric: bool = True, mean_only: bool = False, ref_batch: str | None = None) -> DataFrame:
    """Standard correction: a pass for the sums and one for the result; what lies between is one row a feature and batch."""
    scratch = Scratch(df.sparkSession, "combat")
    df = scratch.table(df, "input")  # what made the matrix runs once
    check_batches(df)
    sums = scratch.table(cell_sums(df), "sums")
    scale = scratch.table(scale_of(sums), "scale")
    effects = scratch.table(effects_of(sums, scale), "effects")
    return adjust(df, scale, posterior(effects, mean_only) if parametric else shrunken(effects), ref_batch)


def design_of(df: DataFrame, covariates: list[str]) -> tuple[list[str], np.ndarray, int]:
    """(samples, design, number of batches): a column for each batch, then the covariates, dummy-coded if they are strings.

    The sample table is one row a run. A covariate of ones only is left out: batches
    have their own levels. Covariates that repeat what batches or other covariates say
    are reported; the fit then takes the shortest coefficients.
    """
    samples = df.select("sample", "batch", *covariates).distinct().toPandas().sort_values("sample")
    batch = pd.get_dummies(samples["batch"].astype(str), dtype=float)
    extra = pd.get_dummies(samples[covariates], drop_first=True, dtype=float)
    extra = extra.loc[:, ~(extra == 1).all()]
    design = np.hstack([batch.to_numpy(), extra.to_numpy()])
    if np.linalg.matrix_rank(design) < design.shape[1]:
        warnings.warn("the design is rank deficient: covariates may be confounded with batches", stacklevel=3)
    return samples["sample"].tolist(), design, batch.shape[1]


def covariate_parts(x: np.ndarray, design: np.ndarray, n_batch: int, solvers: dict[bytes, np.ndarray | None]) -> np.ndarray:
    """Of features x samples with gaps (NaN): what the covariates explain, by least squares on batches and covariates over the cells that are there.

    Features with the same gaps are solved together, and each pattern of gaps is
    factorised once (``solvers`` keeps them). Features with fewer cells than the
    design has columns keep 0.
    """
    part = np.zeros(x.shape)
    patterns, of = np.unique(np.isnan(x), axis=0, return_inverse=True)
    for k, gaps in enumerate(patterns):
        key = np.packbits(gaps).tobytes()
        if key not in solvers:
            own = design[~gaps]
            solvers[key] = np.linalg.pinv(own)[n_batch:] if len(own) >= design.shape[1] else None
        if solvers[key] is not None:
            rows = np.flatnonzero(of.ravel() == k)
            part[rows] = x[np.ix_(rows, ~gaps)] @ solvers[key].T @ design[:, n_batch:].T
    return part


def with_covariates(df: DataFrame, covariates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Residual long data and fitted covariate part of each cell, by least squares of each feature on batch and covariates.

    A feature is a row with its cells in the order of the samples; tasks solve many
    features at a time (``covariate_parts``).
    """
    samples, design, n_batch = design_of(df, covariates)
    place = F.create_map(*[F.lit(v) for i, s in enumerate(samples) for v in (s, i)])
    kind = df.schema["feature"].dataType.simpleString()
    cells = df.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("feature").agg(F.collect_list(F.element_at(place, F.col("sample"))).alias("at"), F.collect_list(F.col("x").cast("double")).alias("x"))

    def solved(batches):
        solvers: dict[bytes, np.ndarray | None] = {}
        for batch in batches:
            at, values = batch.column("at"), batch.column("x")
            x = np.full((batch.num_rows, len(samples)), np.nan)
            x[np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = values.flatten().to_numpy()
            part = covariate_parts(x, design, n_batch, solvers)
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(samples), pa.int32()), pa.array(part.ravel()))], ["feature", "parts"])

    parts = cells.mapInArrow(solved, f"feature {kind}, parts array<double>")
    names = F.array(*map(F.lit, samples))
    part = parts.select("feature", F.posexplode("parts").alias("_i", "part")).select("feature", F.element_at(names, F.col("_i") + 1).alias("sample"), "part")
    return df.join(part, ["feature", "sample"]).withColumn("x", F.col("x") - F.col("part")).select(*df.columns), part


def combat_long(df: DataFrame, covariates: list[str] | None = None, **options) -> DataFrame:
    """Correction that keeps what covariates explain."""
    if not covariates:
        return combat(df, **options)
    df = Scratch(df.sparkSession, "covariates").table(df, "input")
    rest, part = with_covariates(df, covariates)
    part = Scratch(df.sparkSession, "covariates").table(part, "parts")
    return combat(rest, **options).join(part, ["feature", "sample"]).withColumn("x", F.col("x") + F.col("part")).select(*df.columns)


def combat_reference_anchored(df: DataFrame, no_reference: str = "fallback") -> DataFrame:
    """Batch parameters from reference samples only (``fit`` true), applied to all samples.

    A batch with one reference gets its location corrected, not its scale. One
    without reference: ``fallback`` fits its location on all its samples, ``skip``
    leaves it alone, ``error`` raises.
    """
    if no_reference not in ("fallback", "skip", "error"):
        raise ValueError(no_reference)
    scratch = Scratch(df.sparkSession, "anchored")
    df = scratch.table(df, "input")
    refs = df.groupBy("batch").agg(F.countDistinct(F.when(F.col("fit"), F.col("sample"))).alias("n_ref"), F.countDistinct("sample").alias("n_all"))
    mode = F.when(F.col("n_ref") >= 2, "full").when(F.col("n_ref") == 1, "location").when(F.lit(no_reference == "skip"), "skip").otherwise("all")
    policy = scratch.table(refs.select("batch", "n_ref", mode.alias("mode"), F.when(F.col("n_ref") > 0, F.col("n_ref")).otherwise(F.col("n_all")).alias("size")), "policy")
    facts = policy.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_ref"), F.lit(0)).alias("refs"), F.coalesce(F.min("n_ref"), F.lit(0)).alias("least"), F.coalesce(F.sum(F.when(F.col("mode") == "full", F.col("size") - 1)), F.lit(0)).alias("df")).first()
    if facts["n"] < 2:
        return df
    if not facts["refs"]:
        raise ValueError("there is no reference sample")
    if no_reference == "error" and not facts["least"]:
        raise ValueError("a batch has no reference sample")
    seen = df.where("x IS NOT NULL").join(policy, "batch")
    per = seen.where("mode <> 'skip' AND (fit OR mode = 'all')").groupBy("feature", "batch", "mode", "size").agg(F.count("x").alias("c"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss"))
    per = scratch.table(per, "sums")
    totals = policy.where("mode <> 'skip'").agg(F.sum("size").alias("n_fit"), F.count("*").alias("n_batches"))
    whole = per.join(totals, F.lit(True)).groupBy("feature").agg(F.sum(F.col("size") / F.col("n_fit") * F.col("m")).alias("grand"), (F.sum(F.when(F.col("mode") == "full", F.col("ss"))) / facts["df"] if facts["df"] else F.lit(None).cast("double")).alias("var"), F.count("*").alias("seen"), F.max("n_batches").alias("n_batches"))
    varied = df.groupBy("feature").agg((F.max("x") > F.min("x")).alias("varied")).where("varied").select("feature")
    whole = whole.where("seen = n_batches").join(varied, "feature").select("feature", "grand", "var")
    if not facts["df"]:  # no batch has two references: the spread about what was fitted
        left = seen.select("feature", "batch", "x").join(whole.drop("var"), "feature").join(per.select("feature", "batch", "m"), ["feature", "batch"], "left")
        whole = whole.drop("var").join(left.groupBy("feature").agg(F.var_samp(F.col("x") - F.coalesce("m", "grand")).alias("var")), "feature")
    whole = scratch.table(whole, "pooled")
    middle = whole.where("var > 0").agg(F.coalesce(F.median("var"), F.lit(1.0)).alias("mid"))
    scale = scratch.table(whole.join(middle, F.lit(True)).select("feature", "grand", F.when(F.col("var") > 0, F.col("var")).otherwise(F.col("mid")).alias("var")), "scale")
    e = per.join(scale, "feature").withColumns({"gamma": (F.col("m") - F.col("grand")) / F.sqrt("var"), "ss": F.col("ss") / F.col("var")})
    full = scratch.table(with_scale_estimates(e.where("mode = 'full'").select("feature", "batch", "c", "gamma", "ss")), "full")
    location = scratch.table(e.where("mode <> 'full'").select("feature", "batch", F.col("size").alias("c"), "gamma"), "location")
    pull = location.withColumns({"ss": F.lit(0.0), "delta": F.lit(1.0), "estimable": F.lit(False)})
    post = posterior(full).unionByName(posterior(pull, mean_only=True))
    return adjust(df, scale, post)


def correct(df: DataFrame, config: dict | None = None) -> DataFrame:
    """The correction that a configuration asks for: enabled, method (combat or none), reference_anchored, reference_type, auto_revert.

    ``df`` has sample_type besides the usual columns.
    """
    c = {"enabled": True, "method": "combat", "reference_anchored": False, "reference_type": "reference", "auto_revert": False} | (config or {})
    if not c["enabled"] or c["method"] == "none":
        return df
    if c["method"] != "combat":
        raise ValueError(f"unknown correction {c['method']}")
    if c["reference_anchored"]:
        anchored = combat_reference_anchored(df.withColumn("fit", F.col("sample_type") == c["reference_type"]))
        return anchored.select(*df.columns)
    if c["auto_revert"]:
        return corrected_or_original(df).select(*df.columns)
    return combat(df)


def median_cv(df: DataFrame, value: str = "x") -> DataFrame:
    """(sample_type, cv): median over features of the linear coefficient of variation."""
    v = F.pow(F.lit(2.0), F.col(value))
    per = df.groupBy("sample_type", "feature").agg(F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"))
    return per.groupBy("sample_type").agg(F.median("cv").alias("cv"))


def batch_variance(df: DataFrame, value: str = "x") -> DataFrame:
    return df.groupBy("batch").agg(F.avg(value).alias("m")).agg(F.var_pop("m").alias("v"))


def evaluate(df: DataFrame, before: str = "x_before", after: str = "x_after", reference: str = "reference", qc: str = "qc", min_qc_improvement: float = 0.0, max_overfitting_ratio: float = 2.0, worsen_tolerance: float = 0.1) -> DataFrame:
    """One row: CVs before and after, improvements, overfitting ratio, batch variances, passed.

    Fails if the qc samples gain less than ``min_qc_improvement``, if the reference
    gains more than ``max_overfitting_ratio`` times as much as they do, or if their
    CV grows by more than ``worsen_tolerance``. The ratio is infinite (and no failure
    by itself) if only the reference gains, 1 if neither does. A CV of 0 gains 0; one
    that cannot be worked out fails nothing.
    """
    def cv(col, kind):
        v = F.pow(F.lit(2.0), F.col(col))
        return df.where(F.col("sample_type") == kind).groupBy("feature").agg(F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv")).agg(F.median("cv").alias(f"{kind}_{col}"))

    parts = [cv(c, k) for k in (reference, qc) for c in (before, after)] + [batch_variance(df, c).withColumnRenamed("v", f"batch_{c}") for c in (before, after)]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, F.lit(True))
    gain = lambda k: F.when(F.col(f"{k}_{before}") > 0, (F.col(f"{k}_{before}") - F.col(f"{k}_{after}")) / F.col(f"{k}_{before}")).otherwise(0.0)
    row = row.withColumns({"ref_gain": gain(reference), "qc_gain": gain(qc)})
    row = row.withColumn("overfit", F.when(F.col("qc_gain") > 0, F.col("ref_gain") / F.col("qc_gain")).when(F.col("ref_gain") > 0, float("inf")).otherwise(1.0))
    enough = F.coalesce(F.col("qc_gain") >= min_qc_improvement, F.lit(True))
    overfitted = F.coalesce((F.col("qc_gain") > 0) & (F.col("overfit") > max_overfitting_ratio), F.lit(False))
    steady = F.coalesce(F.col(f"{qc}_{after}") <= (1 + worsen_tolerance) * F.col(f"{qc}_{before}"), F.lit(True))
    passed = enough & ~overfitted & steady
    return row.withColumn("passed", passed)


def corrected_or_original(df: DataFrame, limits: dict[str, float] | None = None, **options) -> DataFrame:
    """Correct, evaluate (``limits``: those of ``evaluate``), and keep the original values where the evaluation fails. Adds column ``corrected``."""
    scratch = Scratch(df.sparkSession, "verdict")
    df = scratch.table(df, "input")
    fixed = combat(df, **options).select("feature", "sample", F.col("x").alias("x_after"))
    both = scratch.table(df.withColumnRenamed("x", "x_before").join(fixed, ["feature", "sample"]), "both")
    verdict = evaluate(both, **(limits or {})).select("passed")
    return both.join(verdict, F.lit(True)).select(*[c for c in df.columns if c != "x"], F.when(F.col("passed"), F.col("x_after")).otherwise(F.col("x_before")).alias("x"), F.col("passed").alias("corrected"))


def batches_by_gap(runs: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """(sample, time) -> batch numbers: a new batch after every gap over max(Q3 + multiplier * IQR, 1.1 * median) minutes."""
    order = Window.orderBy("time", "sample")
    r = runs.withColumn("gap", (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lag("time").over(order).cast("timestamp"))) / 6e7)
    q = r.agg(F.percentile("gap", F.lit(0.25)).alias("q1"), F.percentile("gap", F.lit(0.75)).alias("q3"), F.median("gap").alias("mid"))
    r = r.join(q, F.lit(True)).withColumn("limit", F.greatest(F.col("q3") + multiplier * (F.col("q3") - F.col("q1")), 1.1 * F.col("mid")))
    brk = F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0))
    return r.withColumn("batch", 1 + F.sum(brk).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("sample", "time", "batch")


def batches_by_count(runs: DataFrame, k: int) -> DataFrame:
    """k batches of equal size in order of time; the first ones take the remainder."""
    return runs.withColumn("batch", F.ntile(k).over(Window.orderBy("time", "sample")))


def batches_by_width(runs: DataFrame, k: int) -> DataFrame:
    """k batches of equal width in position."""
    pos = F.row_number().over(Window.orderBy("time", "sample")) - 1
    return runs.withColumn("_p", pos).withColumn("_n", F.count("*").over(Window.partitionBy())).withColumn("batch", F.greatest(F.least(F.ceil(F.col("_p") * k / F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(k)), F.lit(1)).cast("int")).drop("_p", "_n")


def batches_by_document(df: DataFrame) -> DataFrame:
    """(sample, batch) from distinct source documents; empty unless there are two at least."""
    d = df.select("sample", F.col("source_document").alias("batch")).distinct()
    several = d.agg((F.countDistinct("batch") >= 2).alias("ok"))
    return d.join(several, F.lit(True)).where("ok").drop("ok")


def apply_batches(df: DataFrame, batches: DataFrame) -> DataFrame:
    """Give rows their sample's batch where they have none."""
    joined = df.join(batches.select("sample", F.col("batch").alias("_b")), "sample", "left")
    return joined.withColumn("batch", F.coalesce(F.col("batch"), F.col("_b")) if "batch" in df.columns else F.col("_b")).drop("_b")
