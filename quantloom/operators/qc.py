"""Quality metrics: coefficients of variation, correlation, components, distributions, drift over retention time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from .kernels import principal_scores
from .ordering import quantiles


def linear(c: str = "x") -> Column:
    return F.pow(F.lit(2.0), F.col(c))


def feature_cvs(df: DataFrame, by: list[str] = ("sample_type",), value: Column | None = None) -> DataFrame:
    """Linear CV of each feature inside each group; two values at least."""
    v = linear() if value is None else value
    s = df.groupBy(*by, "feature").agg(F.count(v).alias("n"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"))
    return s.where("n >= 2").drop("n")


def median_cvs(df: DataFrame, by: list[str] = ("sample_type",)) -> DataFrame:
    return feature_cvs(df, by).groupBy(*by).agg(F.median("cv").alias("median_cv"), F.count("cv").alias("n_features"))


def cv_summary(cvs: DataFrame, by: str = "sample_type", limit: float = 0.2) -> DataFrame:
    share = lambda t: F.avg((F.col("cv") < t).cast("double"))
    return cvs.groupBy(by).agg(F.median("cv").alias("median"), F.avg("cv").alias("mean"), share(limit).alias("under_limit"), share(0.1).alias("under_tenth"))


def histogram(df: DataFrame, by: str, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(by, bin, n) over equal bins of [lo, hi]; the last bin is closed."""
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def _rows(df: DataFrame, samples: list[str]) -> DataFrame:
    """One row per feature: its values as an array in the order of ``samples``, null where unseen."""
    m = df.where("x IS NOT NULL").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("sample", "x"))).alias("m"))
    return m.select(F.transform(F.array(*map(F.lit, samples)), lambda s: F.try_element_at("m", s)).alias("v"))


def _matrices(batches, width: int):
    """Rows of values, NaN where unseen, a few thousand at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            v = batch.column("v").slice(lo, 4096)
            yield v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), width)


def pair_sums(df: DataFrame, samples: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of samples i <= j over the features that both have.

    A feature is one row of values; each task adds its rows up to matrices of
    samples x samples, so no row is made for a pair of samples of a feature.
    """
    width = len(samples)

    def summed(batches):
        total = np.zeros((6, width, width))
        for x in _matrices(batches, width):
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += (seen.T @ seen, x.T @ seen, seen.T @ x, (x * x).T @ seen, seen.T @ (x * x), x.T @ x)
        i, j = np.triu_indices(width)
        if total[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = _rows(df, samples).mapInArrow(summed, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).where("n > 0")


def correlations(df: DataFrame, method: str = "pearson") -> DataFrame:
    """(s, t, r, n) for all pairs of samples over shared features; one row per (feature, sample) is expected."""
    d = df.select("feature", "sample", "x").where("x IS NOT NULL")
    if method == "spearman":
        ties = F.count("*").over(Window.partitionBy("sample", "x"))
        d = d.withColumn("x", F.rank().over(Window.partitionBy("sample").orderBy("x")) + (ties - 1) / 2)
    names = [r[0] for r in d.select("sample").distinct().orderBy("sample").collect()]
    if not names:
        return d.select(F.col("sample").alias("s"), F.col("sample").alias("t"), F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("n")).limit(0)
    p = pair_sums(d, names)
    spread = lambda q, s: F.greatest(F.col("n") * F.col(q) - F.col(s) * F.col(s), F.lit(0.0))
    r = F.when(F.col("i") == F.col("j"), F.when(spread("sxx", "sx") > 0, 1.0)).otherwise(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))))
    at = F.array(*map(F.lit, names))
    half = p.select(F.get(at, F.col("i")).alias("s"), F.get(at, F.col("j")).alias("t"), r.alias("r"), F.col("n").cast("long").alias("n"))
    return half.unionByName(half.where("s <> t").select(F.col("t").alias("s"), F.col("s").alias("t"), "r", "n"))


def cluster_order(pairs: list[tuple[str, str, float]]) -> list[str]:
    """Leaf order of average-linkage clustering with distance 1 - r.

    A driver job over the matrix of samples: one look for the smallest distance and
    one row update per merge, seconds for 1,000 samples.
    """
    names = sorted({s for s, _, _ in pairs})
    at = {s: i for i, s in enumerate(names)}
    d = np.ones((len(names),) * 2)
    for s, t, r in pairs:
        d[at[s], at[t]] = 1 - (r if r is not None else 0)
    d = np.round(d, 12)
    np.fill_diagonal(d, np.inf)
    clusters = [[i] for i in range(len(names))]
    for _ in range(len(names) - 1):
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        n, m = len(clusters[a]), len(clusters[b])
        row = (n * d[a] + m * d[b]) / (n + m)
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        clusters[a] += clusters[b]
    return [names[i] for i in clusters[0]] if clusters else []


def filled(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Features seen in ``share`` of the samples at least, with gaps filled by their median. Dense."""
    samples = [r[0] for r in df.select("sample").distinct().orderBy("sample").collect()]
    rows = df.where("x IS NOT NULL").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("sample", "x"))).alias("m"), F.median("x").alias("mid"), F.count("x").alias("n"))
    rows = rows.where(F.col("n") >= share * len(samples)).withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    return rows.select("feature", "sample", F.coalesce(F.try_element_at("m", F.col("sample")), F.col("mid")).alias("x"))


def gram(df: DataFrame, scale: bool = False) -> tuple[list[str], np.ndarray]:
    """Samples and the matrix of their inner products over features (centred, optionally scaled to unit variance); dense input.

    Partial matrices are added up in the tasks and in one aggregation.
    """
    names = [r[0] for r in df.select("sample").distinct().orderBy("sample").collect()]
    width = len(names)

    def summed(batches):
        total = np.zeros((width, width))
        for x in _matrices(batches, width):
            x = x - x.mean(1, keepdims=True)
            if scale:
                sd = x.std(1, ddof=1, keepdims=True) if width > 1 else np.zeros((len(x), 1))
                x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "g"])

    g = np.zeros((width, width))
    if width:
        for r in _rows(df, names).mapInArrow(summed, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
            g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return names, g


def pca(df: DataFrame, n: int = 2, scale: bool = False) -> DataFrame:
    """(sample, pc1.., share1..): the Gram matrix is distributed work, the eigenvectors of samples x samples are not."""
    names, g = gram(filled(df), scale)
    scores, shares = principal_scores(g, n) if names else (np.zeros((0, n)), np.zeros(n))
    cols = [f"pc{i + 1}" for i in range(scores.shape[1])]
    rows = [(s, *map(float, scores[i])) for i, s in enumerate(names)]
    out = df.sparkSession.createDataFrame(rows, "sample string, " + ", ".join(f"{c} double" for c in cols))
    return out.withColumns({f"share{i + 1}": F.lit(float(shares[i])) for i in range(len(cols))})


def centroid_distance(df: DataFrame, a: list[str], b: list[str]) -> float:
    rows = {r["sample"]: (r["pc1"], r["pc2"]) for r in pca(df.where(F.col("sample").isin(a + b))).collect()}
    mean = lambda names: np.mean([rows[s] for s in names if s in rows], axis=0)
    return float(np.linalg.norm(mean(a) - mean(b)))


def validate(before: DataFrame, after: DataFrame) -> dict:
    """Verdict on a correction: the qc CV improves, centroids keep apart, the reference does not improve out of proportion."""
    cv = lambda d: {r["sample_type"]: r["median_cv"] for r in median_cvs(d).collect()}
    types = {}
    for r in before.select("sample", "sample_type").distinct().collect():
        types.setdefault(r["sample_type"], []).append(r["sample"])
    b, a = cv(before), cv(after)
    ref, qc = types.get("reference", []), types.get("qc", [])
    gain = lambda k: (b[k] - a[k]) / b[k] if b.get(k) and a.get(k) is not None else None
    ref_gain, qc_gain = gain("reference"), gain("qc")
    rvr = ref_gain / qc_gain if ref_gain is not None and ref_gain > 0 and qc_gain else None
    d0, d1 = (centroid_distance(x, ref, qc) for x in (before, after))
    checks = {"qc_improved": qc_gain is not None and qc_gain > 0, "distance_kept": d0 == 0 or d1 / d0 > 0.5, "not_overfitted": rvr is None or rvr < 2}
    return {"cv_before": b, "cv_after": a, "distance_ratio": d1 / d0 if d0 else None, "relative_gain": rvr, **checks, "passed": all(checks.values())}


def five_numbers(df: DataFrame, by: str = "sample", value: str = "x") -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    s = df.groupBy(by).agg(q.alias("q"), F.count(value).alias("n"))
    return s.select(by, "n", *[F.get("q", i).alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))])


def density_curve(df: DataFrame, value: str = "x", bins: int = 512) -> DataFrame:
    """Gaussian density on ``bins`` grid points, bandwidth by Silverman's rule; a self-join of bins, not of rows."""
    s = df.agg(F.min(value), F.max(value), F.stddev_samp(value), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))), F.count(value)).first()
    lo, hi, sd, (q1, q3), n = s if s[0] is not None else (0.0, 1.0, 1.0, (0.0, 1.0), 1)
    h = 0.9 * min(sd or 1.0, ((q3 - q1) / 1.34) or sd or 1.0) * n ** -0.2 or 1.0
    lo, hi = lo - 3 * h, hi + 3 * h
    step = (hi - lo) / bins
    counts = df.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - lo) / step).cast("int").alias("b")).agg(F.count("*").alias("n"))
    reach = int(np.ceil(4 * h / step))
    spread = counts.withColumn("i", F.explode(F.sequence(F.greatest(F.col("b") - reach, F.lit(0)), F.least(F.col("b") + reach, F.lit(bins - 1)))))
    z = (F.col("i") - F.col("b")) * step / h
    return spread.groupBy("i").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / (n * h * float(np.sqrt(2 * np.pi)))).alias("density")).withColumn("at", lo + (F.col("i") + 0.5) * step)


def rt_residual_bins(df: DataFrame, stats: DataFrame, bins: int = 50) -> DataFrame:
    """Per sample and retention-time bin: median residual to the reference mean."""
    lo, hi = df.agg(F.min("rt"), F.max("rt")).first()
    width = float(hi - lo) / bins or 1.0
    r = df.join(stats.select("feature", F.col("mean").alias("_m")), "feature")
    at = F.least(F.floor((F.col("rt") - lo) / width), F.lit(bins - 1)).cast("int")
    return r.groupBy("sample", at.alias("bin")).agg(F.median(F.col("x") - F.col("_m")).alias("residual"), F.count("*").alias("n"))


def rt_bin_cvs(df: DataFrame, bins: int = 8) -> DataFrame:
    """Per sample type and retention-time bin (the last one closed): median linear CV."""
    span = df.agg(F.min("rt").alias("lo"), F.max("rt").alias("hi"))
    d = df.join(span, F.lit(True))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("rt") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return feature_cvs(d.withColumn("bin", at), ["sample_type", "bin"]).groupBy("sample_type", "bin").agg(F.median("cv").alias("median_cv"), F.count("*").alias("n"))


def rt_bin_boxes(df: DataFrame, bins: int = 8, least: int = 6) -> DataFrame:
    """Per batch and retention-time bin with ``least`` values or more: quartiles."""
    span = df.agg(F.min("rt").alias("lo"), F.max("rt").alias("hi"))
    d = df.join(span, F.lit(True))
    at = F.coalesce(F.least(F.floor((F.col("rt") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1)), F.lit(0)).cast("int")
    q = d.groupBy("batch", at.alias("bin")).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("x").alias("n"))
    return q.where(F.col("n") >= least).select("batch", "bin", "n", F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"), F.get("q", 2).alias("q3"))


def wide(df: DataFrame, samples: list[str], key: str = "feature", value: str = "x") -> DataFrame:
    """One column per sample. The list is given, so no job looks for it."""
    return df.groupBy(key).pivot("sample", samples).agg(F.first(value, ignorenulls=True))


def long(df: DataFrame, samples: list[str], key: str = "feature", value: str = "x") -> DataFrame:
    return df.unpivot([key], samples, "sample", value)


def entities_by_median(df: DataFrame, key: str = "entity", value: str = "x") -> DataFrame:
    """Entities by median abundance, most abundant first, unseen last."""
    return df.groupBy(key).agg(F.median(value).alias("median")).orderBy(F.desc_nulls_last("median"), key)


def lookup(df: DataFrame, samples: list[str], names: list[str], key: str = "feature", value: str = "x") -> DataFrame:
    """The named rows of a wide matrix, melted to long."""
    return long(df.where(F.col(key).isin(names)).select(key, *samples), samples, key, value)


def stages(named: dict[str, DataFrame]) -> DataFrame:
    """(stage, sample_type, median_cv, n_features) and, per stage, the quartiles of all values: several stages of one experiment side by side.

    Each stage is written once; no group's values meet in one task.
    """
    parts = [df.select(F.lit(name).alias("stage"), "sample_type", "feature", "x") for name, df in named.items()]
    scratch = Scratch(parts[0].sparkSession, "stages")
    rows = scratch.table(reduce(DataFrame.unionByName, parts), "rows")
    boxes = quantiles(rows, "x", [0.25, 0.5, 0.75], ("stage",)).select("stage", *[F.get("q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    cvs = scratch.table(feature_cvs(rows, ["stage", "sample_type"]), "cvs")
    seen = cvs.groupBy("stage", "sample_type").agg(F.count("cv").alias("n_features"))
    middle = quantiles(cvs, "cv", [0.5], ("stage", "sample_type")).select("stage", "sample_type", F.get("q", 0).alias("median_cv"))
    return scratch.keep(seen.join(middle, ["stage", "sample_type"], "left").join(boxes, "stage", "left").select("sample_type", "median_cv", "n_features", "q1", "median", "q3", "stage"))


def missing_cells(df: DataFrame, samples: list[str]) -> DataFrame:
    """One row: features, cells seen, cells missing, share seen."""
    s = df.agg(F.countDistinct("feature").alias("features"), F.count("x").alias("seen"))
    cells = F.col("features") * len(samples)
    return s.withColumn("missing", cells - F.col("seen")).withColumn("share", F.try_divide(F.col("seen"), cells))
