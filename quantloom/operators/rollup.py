"""Rollups: transitions to features, features to entity groups.

Data is long: (feature, transition, sample, area) with linear areas, one row per
observed cell. ``matrix`` turns it into the dense, imputed log2 form that the
rollups read. All rollups are aggregations; only Tukey's median polish is an
iterative kernel and runs as a grouped map.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import once
from quantloom.scratch import Scratch

from .kernels import median_polish_frames

#: Samples whose ratios one task works out, and cells of the differences that it holds at a time.
RATIO_BLOCK, RATIO_CELLS = 256, 4_000_000


def first_cells(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One area for each (feature, transition, sample): the first that is not null in ``order``, else the largest."""
    area = F.min_by("area", F.struct(*order)) if order else F.max("area")  # without an order the files' own is unknown
    return df.where(F.col("area").isNotNull()).groupBy("feature", "transition", "sample").agg(area.alias("area"))


def sample_list(df: DataFrame, col: str = "sample") -> list[str]:
    """The sorted samples: the columns of the matrix, as many as the cohort has runs."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def _measured(cells: DataFrame, min_transitions: int) -> DataFrame:
    """(feature, transition, areas, low): a map of the areas by sample, and what stands for missing ones."""
    rows = cells.groupBy("feature", "transition").agg(F.map_from_entries(F.collect_list(F.struct("sample", "area"))).alias("areas"))
    low = cells.where("area > 0").groupBy("feature").agg(F.greatest(0.5 * F.percentile("area", F.lit(0.01)), F.lit(1.0)).alias("low"))
    if min_transitions > 1:
        enough = cells.groupBy("feature").agg(F.countDistinct("transition").alias("k")).where(F.col("k") >= min_transitions).select("feature")
        rows = rows.join(enough, "feature", "left_semi")
    return rows.join(low, "feature", "left")


def _imputed(sample: Column) -> Column:
    area = F.greatest(F.coalesce(F.try_element_at("areas", sample), F.lit(0.0)), F.lit(0.0))
    return F.log2(F.when(area > 0, area).otherwise(F.coalesce("low", F.lit(1.0))))


def matrix(cells: DataFrame, samples: list[str], min_transitions: int = 1) -> DataFrame:
    """Dense log2 matrix (feature, transition, sample, x).

    Cells that a sample never had exist too. Areas are clipped at 0; missing and
    zero cells become max(half the feature's first percentile of positive areas, 1).
    One shuffle by feature: a feature's cells are folded into a map per transition,
    so no join is needed to find the missing ones.
    """
    rows = _measured(cells, min_transitions).withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    return rows.select("feature", "transition", "sample", _imputed(F.col("sample")).alias("x"))


def matrix_rows(cells: DataFrame, samples: list[str], min_transitions: int = 1) -> DataFrame:
    """The same matrix with a row a transition: (feature, transition, xs), xs in the order of ``samples``."""
    names = F.array(*map(F.lit, samples)).cast("array<string>")
    return _measured(cells, min_transitions).select("feature", "transition", F.transform(names, _imputed).alias("xs"))


def shape_scores(cells: DataFrame) -> DataFrame:
    """(feature, transition, score): median shape correlation over samples, 0 where there is none."""
    return cells.groupBy("feature", "transition").agg(F.coalesce(F.median("shape"), F.lit(0.0)).alias("score"))


def quality_means(cells: DataFrame, value: str, default: float = 0.5) -> DataFrame:
    """(feature, transition, value): mean of a quality column weighted by area, over cells that have both; else ``default``."""
    v = F.col(value).cast("double")
    both = v.isNotNull() & ~F.isnan(v) & F.col("area").isNotNull()
    return cells.groupBy("feature", "transition").agg(F.coalesce(F.try_divide(F.sum(F.when(both, F.col("area") * v)), F.sum(F.when(both, F.col("area")))), F.lit(default)).alias(value))


def mean_times(cells: DataFrame) -> DataFrame:
    """(feature, mean_rt): over all rows that have a time and are no precursor ions."""
    return cells.where(~F.lower(F.col("transition").cast("string")).startswith("precursor")).groupBy("feature").agg(F.avg("rt").alias("mean_rt"))


def shape_descriptors(cells: DataFrame, low: float = 0.5) -> DataFrame:
    """(feature, transition, shape_median, shape_max, shape_low): the last is the share of samples under ``low``; unseen shapes count as 1 there."""
    s = cells.groupBy("feature", "transition").agg(F.median("shape").alias("shape_median"), F.max("shape").alias("shape_max"), F.avg((F.coalesce("shape", F.lit(1.0)) < low).cast("double")).alias("shape_low"))
    return s


def residual_summary(residuals: DataFrame, key: str = "entity", row: str = "feature") -> DataFrame:
    """(key, row, mean, sd, mad, max_abs) of each row's residuals."""
    med = residuals.groupBy(key, row).agg(F.median("residual").alias("_m"))
    r = residuals.join(med, [key, row])
    return r.groupBy(key, row).agg(F.avg("residual").alias("residual_mean"), F.stddev_pop("residual").alias("residual_sd"), F.median(F.abs(F.col("residual") - F.col("_m"))).alias("residual_mad"), F.max(F.abs("residual")).alias("residual_max_abs"))


def rollup_transitions(m: DataFrame, method: str = "median_polish", min_transitions: int = 3, cells: DataFrame | None = None, **options) -> DataFrame:
    """(feature, sample, value, n_transitions) by name: sum, median_polish, topn, consensus, adaptive, quality_weighted.

    Features with fewer transitions than ``min_transitions`` give their per-sample
    median. ``cells`` (feature, transition, sample, area, shape...) serves the
    methods that look at peak quality.
    """
    n = m.groupBy("feature").agg(F.countDistinct("transition").alias("_k"))
    enough = m.join(n.where(F.col("_k") >= min_transitions), "feature", "left_semi")
    if method == "sum":
        got = rollup_sum(enough)
    elif method == "median_polish":
        got = rollup_median_polish(enough, **options).withColumnRenamed("n_rows", "n_transitions")
    elif method == "topn":
        got = rollup_topn(enough, scores=shape_scores(cells) if cells is not None and "shape" in cells.columns else None, **options)
    elif method == "consensus":
        got = rollup_consensus(enough, **options)
    elif method == "adaptive":
        d = transition_descriptors(enough)
        if cells is not None and "shape" in cells.columns:
            d = d.join(shape_descriptors(cells), ["feature", "transition"], "left")
        got = rollup_weighted(enough, adaptive_weights(d, options.get("betas", {})))
    elif method == "quality_weighted":
        got = rollup_quality_weighted(enough, **options)
    else:
        raise ValueError(f"unknown rollup {method}")
    few = m.join(n.where(F.col("_k") < min_transitions).select("feature", "_k"), "feature").groupBy("feature", "sample").agg(F.median("x").alias("value"), F.max("_k").alias("n_transitions"))
    cols = ["feature", "sample", "value", F.col("n_transitions").cast("long").alias("n_transitions")]
    return got.select(*cols).unionByName(few.select(*cols))


def rollup_entities(p: DataFrame, method: str = "median_polish", min_features: int = 3, theoretical: DataFrame | None = None, n: int = 3, selection: str = "median_abundance") -> DataFrame:
    """(entity, sample, value, n_features, low_confidence) by name, with the common rules for small groups."""
    if method == "median_polish":
        rolled = rollup_median_polish(p, "entity", "feature", log_count=False).select("entity", "sample", "value")
    elif method == "ibaq":
        if theoretical is None:
            raise ValueError("ibaq needs the numbers of theoretical features")
        rolled = entity_ibaq(p, theoretical)
    elif method == "topn":
        rolled = entity_topn(p, n, selection)
    elif method in ("sum", "max_ratio", "direct"):
        rolled = {"sum": entity_sum, "max_ratio": entity_max_ratio, "direct": entity_direct}[method](p)
    else:
        raise ValueError(f"unknown rollup {method}")
    return entity_rules(p, rolled, min_features)


def rollup_sum(m: DataFrame) -> DataFrame:
    """log2 of the summed linear areas, at least 1."""
    return m.groupBy("feature", "sample").agg(F.log2(F.greatest(F.sum(F.pow(F.lit(2.0), F.col("x"))), F.lit(1.0))).alias("value"), F.count("*").alias("n_transitions"))


def rollup_topn(m: DataFrame, n: int = 3, weighting: str = "sqrt", scores: DataFrame | None = None, min_transitions: int = 1) -> DataFrame:
    """Weighted sum of the n best transitions: by ``scores`` (feature, transition, score) or by mean linear area.

    Ties keep the smaller transition. Weights are 1 or the root of the mean area,
    rescaled to sum to n. Fewer selected transitions than ``min_transitions``: null.
    """
    mean = m.groupBy("feature", "transition").agg(F.avg(F.pow(F.lit(2.0), F.col("x"))).alias("mean"))
    ranked = mean.withColumn("score", F.col("mean")) if scores is None else mean.join(scores, ["feature", "transition"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("feature").orderBy(F.desc("score"), "transition")
    top = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    whole = Window.partitionBy("feature")
    w = F.sqrt(F.greatest("mean", F.lit(1.0))) if weighting == "sqrt" else F.lit(1.0)
    top = top.withColumn("w", w).withColumn("n_selected", F.count("*").over(whole)).withColumn("w", F.col("w") * F.col("n_selected") / F.sum("w").over(whole))
    joined = m.join(top.select("feature", "transition", "w", "n_selected"), ["feature", "transition"])
    out = joined.groupBy("feature", "sample").agg(F.log2(F.greatest(F.sum(F.col("w") * F.pow(F.lit(2.0), F.col("x"))), F.lit(1.0))).alias("value"), F.max("n_selected").alias("n_transitions"))
    return out.withColumn("value", F.when(F.col("n_transitions") >= min_transitions, F.col("value")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _array_median(values: Column) -> Column:
    half = lambda n: F.floor(n / 2).cast("int")
    return once(F.sort_array(F.array_compact(values)), lambda s: (F.get(s, half(F.size(s) - 1)) + F.get(s, half(F.size(s)))) / 2)


def _array_variance(values: Column) -> Column:
    squares = lambda v, mean: _sum(F.transform(v, lambda x: (x - mean) * (x - mean)))
    return once(F.array_compact(values), lambda v: once(F.try_divide(_sum(v), F.size(v)), lambda mean: F.try_divide(squares(v, mean), F.size(v))))


def _consensus_sets(m: DataFrame, samples: list[str] | None, regularization: float) -> tuple[DataFrame, Column, Column]:
    """A row a feature: ``p``, its transitions with arrays over the samples, and ``total``, for each sample the number and the summed raw weights of its cells."""
    if samples is None:  # long cells: first a row a transition
        samples = sample_list(m)
        names = F.array(*map(F.lit, samples)).cast("array<string>")
        m = m.where(F.col("sample").isNotNull()).groupBy("feature", "transition").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.col("x").cast("double").alias("x")))).alias("_x"))
        m = m.select("feature", "transition", F.transform(names, lambda s: F.try_element_at("_x", s)).alias("xs"), F.transform(names, lambda s: F.map_contains_key("_x", s)).alias("seen"))
    else:
        m = m.select("feature", "transition", "xs", F.lit(None).cast("array<boolean>").alias("seen"))
    places, name = F.sequence(F.lit(0), F.lit(len(samples) - 1)) if samples else F.array().cast("array<int>"), lambda i: F.get(F.array(*map(F.lit, samples)).cast("array<string>"), i)
    sets = m.groupBy("feature").agg(F.collect_list(F.struct("transition", "xs", "seen")).alias("p"))

    centred = F.transform("p", lambda r: r.withField("c", once(_array_median(r["xs"]), lambda mid: F.transform(r["xs"], lambda x: x - mid))))
    mids = lambda p: F.transform(places, lambda i: _array_median(F.transform(p, lambda r: F.get(r["c"], i))))
    residual = once(centred, lambda p: once(mids(p), lambda mid: F.transform(p, lambda r: r.withField("c", F.zip_with(r["c"], mid, lambda c, v: c - v)))))
    sets = sets.select("feature", F.transform(residual, lambda r: r.withField("variance", _array_variance(r["c"]))).alias("p"))
    raw = lambda r: 1 / (r["variance"] + regularization)
    own = lambda i: F.filter("p", lambda r: F.coalesce(F.get(r["seen"], i), F.lit(True)))
    total = F.transform(places, lambda i: once(own(i), lambda q: F.struct(F.size(q).cast("long").alias("n"), _sum(F.transform(q, lambda r: F.coalesce(raw(r), F.lit(0.0)))).alias("raw"))))
    return sets.withColumn("total", total), places, name


def consensus_cells(m: DataFrame, regularization: float = 0.1, samples: list[str] | None = None) -> DataFrame:
    """Residual, weight and variance of every cell: x less the row median less the column median of the centred rows.

    ``m`` are long cells or, with ``samples``, the rows of ``matrix_rows``. A feature's matrix is one row of
    arrays, so that a task sorts rows of transitions, not cells, and only once.
    """
    sets, places, name = _consensus_sets(m, samples, regularization)
    rows = sets.select("feature", "total", F.explode("p").alias("r"))
    cells = rows.select("feature", "total", "r", F.explode(places).alias("i")).where(F.coalesce(F.get("r.seen", F.col("i")), F.lit(True)))
    at = lambda c: F.get(F.col(c), F.col("i"))
    weight = F.try_divide(at("total")["n"] / (F.col("r.variance") + regularization), at("total")["raw"])
    return cells.select("feature", "r.transition", name(F.col("i")).alias("sample"), at("r.xs").alias("x"), at("r.c").alias("residual"), "r.variance", weight.alias("weight"))


def rollup_consensus(m: DataFrame, regularization: float = 0.1, samples: list[str] | None = None) -> DataFrame:
    """Transitions weighted by the inverse variance of their residuals; ``m`` as in ``consensus_cells``."""
    sets, places, name = _consensus_sets(m, samples, regularization)

    def rolled(i: Column) -> Column:
        total = F.get("total", i)
        part = lambda r: F.pow(F.lit(2.0), F.get(r["xs"], i)) / (r["variance"] + regularization)
        linear = F.try_divide(_sum(F.array_compact(F.transform("p", part))) * total["n"], total["raw"])
        spread = F.sqrt(_array_variance(F.transform("p", lambda r: F.get(r["c"], i))))
        return F.struct(i.alias("i"), F.log2(F.greatest(linear, F.lit(1.0))).alias("value"), spread.alias("uncertainty"), total["n"].alias("n_transitions"))

    rows = sets.select("feature", F.explode(F.transform(places, rolled)).alias("r")).where("r.n_transitions > 0")
    return rows.select("feature", name(F.col("r.i")).alias("sample"), "r.value", "r.uncertainty", "r.n_transitions")


def adaptive_weights(features: DataFrame, betas: dict[str, float]) -> DataFrame:
    """(feature, transition, w): exp of the clipped weighted sum of transition descriptors, scaled to sum to n.

    ``features`` has (feature, transition) and one column per name in ``betas``.
    All betas 0 make every weight 1.
    """
    z = sum((F.lit(float(b)) * F.coalesce(F.col(c), F.lit(0.0)) for c, b in sorted(betas.items())), F.lit(0.0))
    whole = Window.partitionBy("feature")
    w = F.exp(F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))
    return features.select("feature", "transition", w.alias("w")).withColumn("w", F.col("w") * F.count("*").over(whole) / F.sum("w").over(whole))


def transition_descriptors(m: DataFrame, mz: DataFrame | None = None, mz_range: tuple[float, float] | None = None) -> DataFrame:
    """Per transition: centred mean log intensity, share of the feature's mean intensity, m/z scaled to 0..1 in the feature (or over ``mz_range``)."""
    d = m.groupBy("feature", "transition").agg(F.avg("x").alias("mean_log"), F.avg(F.pow(F.lit(2.0), F.col("x"))).alias("mean_linear"))
    whole = Window.partitionBy("feature")
    d = d.withColumn("log_intensity", F.col("mean_log") - F.avg("mean_log").over(whole)).withColumn("relative", F.col("mean_linear") / F.max("mean_linear").over(whole))
    if mz is not None:
        d = d.join(mz, ["feature", "transition"], "left")
        if mz_range is None:
            lo, hi = F.min("mz").over(whole), F.max("mz").over(whole)
            d = d.withColumn("mz_scaled", F.coalesce(F.try_divide(F.col("mz") - lo, hi - lo), F.lit(0.5)))
        else:
            lo, hi = map(F.lit, mz_range)
            scaled = F.coalesce(F.try_divide(F.coalesce("mz", F.lit(0.0)) - lo, hi - lo), F.lit(0.0))
            d = d.withColumn("mz_scaled", F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))
    return d.drop("mean_log", "mean_linear")


def rollup_weighted(m: DataFrame, weights: DataFrame) -> DataFrame:
    return m.join(weights, ["feature", "transition"]).groupBy("feature", "sample").agg(F.log2(F.greatest(F.sum(F.col("w") * F.pow(F.lit(2.0), F.col("x"))), F.lit(1.0))).alias("value"), F.count("*").alias("n_transitions"))


def signal_variance(intensity: Column, shape: Column | None = None, coeluting: Column | None = None, alpha: float = 1.0, beta: float = 0.01, gamma: float = 100.0, delta: float = 1.0, shape_exponent: float = 2.0, coelution_penalty: float = 10.0) -> Column:
    """Variance of a linear intensity, inflated for poor peak shape and for peaks that do not co-elute."""
    v = alpha * intensity + beta * intensity * intensity + gamma
    if shape is not None:
        v = v * (1 + delta * (F.pow(1 / F.greatest(shape, F.lit(0.01)), F.lit(shape_exponent)) - 1))
    if coeluting is not None:
        v = v * F.when(coeluting, 1.0).otherwise(coelution_penalty)  # a boolean column
    return v


def log_variance(intensity: Column, **options) -> Column:
    """Variance on the log2 scale by the delta method."""
    return signal_variance(intensity, **options) / F.pow(intensity * F.log(F.lit(2.0)), F.lit(2.0))


def rollup_quality_weighted(m: DataFrame, max_ratio: float = 100.0, **options) -> DataFrame:
    """Inverse-variance mean of log2 intensities; variances are capped at max_ratio times a sample's smallest.

    Columns ``shape`` and ``coeluting`` of m, where they exist, inflate variances.
    """
    options = {c: F.col(c) for c in ("shape", "coeluting") if c in m.columns} | options
    cell = Window.partitionBy("feature", "sample")
    v = m.withColumn("v", log_variance(F.pow(F.lit(2.0), F.col("x")), **options))
    v = v.withColumn("v", F.least("v", max_ratio * F.min("v").over(cell)))
    return v.groupBy("feature", "sample").agg((F.sum(F.col("x") / F.col("v")) / F.sum(1 / F.col("v"))).alias("value"), F.sqrt(1 / F.sum(1 / F.col("v"))).alias("uncertainty"), F.count("*").alias("n_transitions"))


def rollup_median_polish(m: DataFrame, key: str = "feature", row: str = "transition", max_sweeps: int = 20, tolerance: float = 1e-4, log_count: bool = True) -> DataFrame:
    """Tukey's median polish of each feature's matrix; with ``log_count`` log2 of the row count is added."""
    return median_polish_frames(m, key, row, max_sweeps, tolerance, log_count)


def _prepared(p: DataFrame) -> DataFrame:
    """Entity-group input (entity, feature, sample, x) with the group's row count."""
    return p.join(p.groupBy("entity").agg(F.countDistinct("feature").alias("n_rows")), "entity")


def entity_rules(p: DataFrame, rolled: DataFrame, min_features: int = 3) -> DataFrame:
    """The common rules: a single row is taken as it is; fewer than min_features rows are summed linearly.

    ``rolled`` is (entity, sample, value) of the wanted method.
    """
    base = _prepared(p).groupBy("entity", "sample").agg(F.max("n_rows").alias("n_features"), F.max("x").alias("only"), F.log2(F.greatest(F.sum(F.pow(F.lit(2.0), F.col("x"))), F.lit(1.0))).alias("summed"))
    value = F.when(F.col("n_features") == 1, F.col("only")).when(F.col("n_features") < min_features, F.col("summed")).otherwise(F.col("value"))
    return base.join(rolled, ["entity", "sample"], "left").select("entity", "sample", value.alias("value"), "n_features", (F.col("n_features") < min_features).alias("low_confidence"))


def entity_sum(p: DataFrame) -> DataFrame:
    return p.groupBy("entity", "sample").agg(F.log2(F.greatest(F.sum(F.pow(F.lit(2.0), F.col("x"))), F.lit(1.0))).alias("value"))


def entity_log_sum(p: DataFrame) -> DataFrame:
    """The older sum: of log2 values."""
    return p.groupBy("entity", "sample").agg(F.sum("x").alias("value"))


def entity_topn(p: DataFrame, n: int = 3, selection: str = "median_abundance") -> DataFrame:
    """Mean log2 of the n features with the highest median (then most samples), chosen once for all samples."""
    s = p.groupBy("entity", "feature").agg(F.median("x").alias("med"), F.count("x").alias("seen"))
    keys = [F.desc_nulls_last("med"), F.desc("seen")]
    if selection == "frequency":
        keys.reverse()
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(*keys, "feature"))).where(F.col("k") <= n)
    return p.join(top.select("entity", "feature"), ["entity", "feature"], "left_semi").groupBy("entity", "sample").agg(F.avg("x").alias("value"))


def entity_ibaq(p: DataFrame, theoretical: DataFrame) -> DataFrame:
    """log2 of the summed intensity divided by the entity's number of theoretical features; null where nothing was seen."""
    s = p.groupBy("entity", "sample").agg(F.sum(F.pow(F.lit(2.0), F.col("x"))).alias("total"))
    return s.join(theoretical, "entity").select("entity", "sample", F.when(F.col("total") > 0, F.log2(F.col("total") / F.greatest("n_theoretical", F.lit(1)))).alias("value"))


def _ratio_totals(block: pa.Table, first: int) -> pa.Table:
    """For the samples of one block: the sum over all others of the median log ratio over shared features, and the own median."""
    entity, f = block["entity"][:1], block["feature"].combine_chunks().dictionary_encode()
    row, col = f.indices.to_numpy(), block["_s"].to_numpy()
    seen, col = np.unique(col, return_inverse=True)
    x = np.full((len(f.dictionary), len(seen)), np.nan)
    x[row, col] = block["x"].to_numpy()
    own = np.flatnonzero((seen >= first) & (seen < first + RATIO_BLOCK))
    total, step = np.zeros(len(own)), max(1, RATIO_CELLS // max(1, x.size))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            ratio = np.nan_to_num(np.nanmedian(x[:, part, None] - x[:, None, :], axis=0))
            total[at : at + step] = ratio.sum(1)  # the ratio to itself is 0
        med = np.nanmedian(x[:, own], axis=0)
    return pa.table({"entity": entity.take(pa.array(np.zeros(len(own), np.int64))), "_s": pa.array(seen[own], pa.int32()), "profile": pa.array(total / len(seen)), "med": pa.array(med)})


def entity_max_ratio(p: DataFrame) -> DataFrame:
    """Median pairwise log ratios.

    For each pair of samples the median ratio over shared features (0 if none is
    shared), averaged over all samples including itself, centred on its own median
    and moved to the median of the samples' medians. Pairs are never rows: an entity's
    matrix goes to one task for each block of ``RATIO_BLOCK`` samples, which takes the
    medians of its pairs in slices of bounded size.
    """
    samples = sample_list(p)
    blocks = range(0, max(1, len(samples)), RATIO_BLOCK)
    place = F.create_map(*[F.lit(v) for i, s in enumerate(samples) for v in (s, i)]) if samples else F.create_map().cast("map<string,int>")
    kind = p.schema["entity"].dataType.simpleString()
    rows = p.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("sample").isNotNull()).select("entity", "feature", F.element_at(place, F.col("sample")).alias("_s"), "x", F.explode(F.array(*map(F.lit, blocks))).alias("_first"))

    def totals(key: tuple, block: pa.Table) -> pa.Table:
        return _ratio_totals(block, key[1].as_py())

    mean = rows.groupBy("entity", "_first").applyInArrow(totals, f"entity {kind}, _s int, profile double, med double")
    mean = Scratch(p.sparkSession, "ratio").table(mean, "profiles")
    centre = mean.groupBy("entity").agg(F.median("profile").alias("pm"), F.median("med").alias("level"))
    name = F.element_at(F.array(*map(F.lit, samples)), F.col("_s") + 1) if samples else F.lit(None).cast("string")
    return mean.join(centre, "entity").select("entity", name.alias("sample"), (F.col("profile") - F.col("pm") + F.col("level")).alias("value"))


def entity_direct(p: DataFrame) -> DataFrame:
    raise NotImplementedError("the direct ratio method is not offered; use entity_max_ratio")


def entity_spread(p: DataFrame) -> DataFrame:
    """Per cell: standard deviation over features, its standard error, and flags."""
    s = p.groupBy("entity", "sample").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"))
    flag = F.concat_ws(";", F.when(F.col("n") == 1, "single_feature"), F.when(F.col("n") == 2, "two_features"))
    return s.select("entity", "sample", "n", "sd", (F.col("sd") / F.sqrt("n")).alias("uncertainty"), flag.alias("qc_flag"))


def outlier_rows(residuals: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows whose residuals stand out: (entity, feature, residual) -> MAD score, share beyond, flag."""
    med = residuals.groupBy("entity").agg(F.median("residual").alias("m"))
    overall = residuals.join(med, "entity").groupBy("entity").agg(F.median(F.abs(F.col("residual") - F.col("m"))).alias("mad"))
    rows = residuals.groupBy("entity", "feature").agg(F.median("residual").alias("rm"))
    dev = residuals.join(rows, ["entity", "feature"]).join(overall, "entity")
    s = dev.groupBy("entity", "feature", "mad").agg(F.median(F.abs(F.col("residual") - F.col("rm"))).alias("row_mad"), F.avg((F.abs("residual") > threshold * F.col("mad")).cast("double")).alias("share"))
    score = F.coalesce(F.try_divide(F.col("row_mad"), F.col("mad")), F.lit(0.0))
    return s.select("entity", "feature", score.alias("score"), "share", ((F.col("share") > 0.5) | (score > threshold)).alias("flagged"))
