"""Queries whose parameters are searched on the reference samples (their SQL unrolls the search, round by round), and rollups with several outputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import learn, outputs, search
from quantloom.operators import normalize as nrm
from quantloom.scratch import Scratch

from . import binding as b
from .binding import with_ctes
from .queries_more import SHAPES, _shapes
from .queries_rollup import _entity, _polished, polish_sql, rounded

QUERIES: dict = {}
REFERENCE, QC = ["S00", "S04", "S08"], ["S01", "S05", "S09"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _listed(points: np.ndarray) -> str:
    return "SELECT unnest(range(1, {} + 1)) AS k, unnest([{}]) AS p".format(len(points), ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in map(float, p)) + "]" for p in points))


VARIANCE = dict(
    sh=SHAPES,
    sq="SELECT feature, transition, sample, max(shape) AS shape, max(CAST(coeluting AS INT)) AS co FROM sh GROUP BY ALL",
    mm="SELECT m.feature, m.transition, m.sample, x, pow(2.0, x) AS lin, shape, co FROM m LEFT JOIN sq USING (feature, transition, sample) WHERE sample IN ('S00', 'S04', 'S08')",
    tr="SELECT feature, transition, i, s, c FROM (SELECT feature, transition, median(lin) AS i, coalesce(sum(lin * shape) / sum(CASE WHEN shape IS NOT NULL THEN lin END), 0.5) AS s, coalesce(sum(lin * co) / sum(CASE WHEN co IS NOT NULL THEN lin END), 0.5) > 0.5 AS c, count(*) OVER (PARTITION BY feature) AS n FROM mm GROUP BY feature, transition) WHERE n >= 3",
)


def variance_rate(candidates: str) -> str:
    """(k, p, f): the objective at each candidate."""
    i = "greatest(i, 1.0)"
    w = f"i * i / ((exp(p[1]) * {i} + exp(p[2]) * {i} * {i} + exp(p[3])) * (1 + exp(p[4]) * (pow(1 / greatest(s, 0.01), p[5]) - 1)) * CASE WHEN c THEN 1.0 ELSE exp(p[6]) END)"
    return f"SELECT k, p, coalesce(median(CASE WHEN sd > 1e-12 THEN sd / abs(mu) END), 1.0) AS f FROM (SELECT k, p, feature, stddev_pop(v) AS sd, avg(v) AS mu FROM (SELECT k, p, w.feature, sample, sum(w * x) / sum(w) AS v FROM (SELECT k, p, feature, transition, {w} AS w FROM tr CROSS JOIN {candidates}) w JOIN mm ON mm.feature = w.feature AND mm.transition = w.transition GROUP BY k, p, w.feature, sample) GROUP BY ALL) GROUP BY k, p"


def simplex_rounds(start: tuple[float, ...], rounds: int) -> dict[str, str]:
    """CTEs of a simplex search with reflection, expansion, two contractions and shrinking; s{rounds} is the last simplex."""
    n = len(start)
    point = lambda e: f"list_transform(range(1, {n + 1}), lambda i: {e})"
    ctes = {"c0": _listed(search.first_simplex(np.array(start))), "r0": variance_rate("c0"), "s0": "SELECT row_number() OVER (ORDER BY f, k) AS j, p, f FROM r0"}
    for r in range(rounds):
        ctes[f"h{r}"] = "SELECT " + ", ".join(f"any_value(p) FILTER (j = {j}) AS p{j}" for j in range(1, n + 2)) + f" FROM s{r}"
        centre = "(" + " + ".join(f"p{j}[i]" for j in range(1, n + 1)) + f") / {n}.0"
        worst = f"p{n + 1}[i]"
        offers = [f"2 * {centre} - {worst}", f"3 * {centre} - 2 * {worst}", f"1.5 * {centre} - 0.5 * {worst}", f"0.5 * {centre} + 0.5 * {worst}", *(f"p1[i] + 0.5 * (p{j}[i] - p1[i])" for j in range(2, n + 2))]
        ctes[f"c{r + 1}"] = " UNION ALL ".join(f"SELECT {k} AS k, {point(e)} AS p FROM h{r}" for k, e in enumerate(offers, 1))
        ctes[f"r{r + 1}"] = variance_rate(f"c{r + 1}")
        f = {k: f"any_value(f) FILTER (k = {k})" for k in range(1, 5)}
        ctes[f"d{r}"] = f"SELECT CASE WHEN f1 < b1 THEN CASE WHEN f2 < f1 THEN 2 ELSE 1 END WHEN f1 < bn THEN 1 WHEN f1 < bw THEN CASE WHEN f3 <= f1 THEN 3 ELSE 0 END WHEN f4 < bw THEN 4 ELSE 0 END AS take FROM (SELECT {f[1]} AS f1, {f[2]} AS f2, {f[3]} AS f3, {f[4]} AS f4 FROM r{r + 1}), (SELECT any_value(f) FILTER (j = 1) AS b1, any_value(f) FILTER (j = {n}) AS bn, any_value(f) FILTER (j = {n + 1}) AS bw FROM s{r})"
        ctes[f"s{r + 1}"] = f"SELECT row_number() OVER (ORDER BY f, o) AS j, p, f FROM (SELECT j AS o, p, f FROM s{r}, d{r} WHERE j = 1 OR (take > 0 AND j <= {n}) UNION ALL SELECT {n + 1}, p, f FROM r{r + 1}, d{r} WHERE k = take UNION ALL SELECT k - 3, p, f FROM r{r + 1}, d{r} WHERE take = 0 AND k > 4)"
    return ctes


def _materialized(sql: str) -> str:
    """Each CTE once: later rounds read earlier ones many times."""
    return sql.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _with_quality(spark, sf):
    q = _shapes(spark, sf).groupBy("feature", "transition", "sample").agg(F.max("shape").alias("shape"), F.max(F.col("coeluting").cast("int")).alias("coeluting"))
    return b.dense(spark, sf).join(q, ["feature", "transition", "sample"], "left")


@query(_materialized(with_ctes("SELECT CAST(k AS BIGINT) AS k, round(f, 9) AS cv FROM r0", "m", **VARIANCE, c0=_listed(search.first_simplex(np.array(learn.VARIANCE_START))), r0=variance_rate("c0"))))
def rup_variance_rating(spark, sf):
    """RUP-10: the objective at the seven points of the first simplex, one job."""
    rows = _with_quality(spark, sf).where(F.col("sample").isin(REFERENCE))
    points = list(search.first_simplex(np.array(learn.VARIANCE_START)))
    features = Scratch(spark, "rating").table(learn.variance_summary(rows), "features")
    found = [(k + 1, f) for k, f in enumerate(learn.rated(features, points, learn.variance_cost))]
    return rounded(spark.createDataFrame(found, "k long, cv double"), digits=9)


@query(_materialized(with_ctes("SELECT round(exp(p[1]), 6) AS alpha, round(exp(p[2]), 6) AS beta, round(exp(p[3]), 5) AS gamma, round(exp(p[4]), 6) AS delta, round(p[5], 6) AS shape_exponent, round(exp(p[6]), 6) AS coelution_penalty, round(f, 8) AS cv_after, (SELECT round(f, 8) FROM r0 WHERE k = 1) AS cv_before FROM s4 WHERE j = 1", "m", **VARIANCE, **simplex_rounds(learn.VARIANCE_START, 4))))
def rup_learned_variance(spark, sf):
    """RUP-10: six parameters after four rounds of the simplex search."""
    got = learn.learn_variance(_with_quality(spark, sf), REFERENCE, rounds=4)
    digits = dict.fromkeys(got.params, 6) | {"gamma": 5}
    row = {k: round(v, digits[k]) for k, v in got.params.items()} | {"cv_after": round(got.cv_after, 8), "cv_before": round(got.cv_before, 8)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


ADAPTIVE = dict(
    sh=SHAPES,
    sq="SELECT feature, transition, sample, max(shape) AS shape FROM sh GROUP BY ALL",
    ar="SELECT m.feature, CAST(m.transition AS DOUBLE) AS mz, m.transition, m.sample, pow(2.0, x) AS area, shape FROM m LEFT JOIN sq USING (feature, transition, sample)",
    en="SELECT feature FROM m GROUP BY feature HAVING count(DISTINCT transition) >= 3",
    sp="SELECT min(mz) AS lo, max(mz) AS hi FROM ar JOIN en USING (feature) WHERE mz > 0",
)


def adaptive_rate(candidates: str, samples: list[str]) -> str:
    named = ", ".join(f"'{s}'" for s in samples)
    traits = f"SELECT feature, transition, any_value(mz) AS mz, avg(CAST(coalesce(shape, 1.0) < 0.5 AS DOUBLE)) AS low FROM ar JOIN en USING (feature) WHERE sample IN ({named}) GROUP BY feature, transition"
    weights = f"SELECT k, p, feature, transition, w * count(*) OVER (PARTITION BY k, feature) / sum(w) OVER (PARTITION BY k, feature) AS w FROM (SELECT k, p, feature, transition, exp(p[1] * greatest(least((mz - lo) / (hi - lo), 1.0), 0.0) + p[2] * low) AS w FROM ({traits}), sp, {candidates})"
    sums = f"SELECT k, p, w.feature, sample, greatest(sum(w * area), 1.0) AS v FROM ({weights}) w JOIN ar ON ar.feature = w.feature AND ar.transition = w.transition WHERE sample IN ({named}) GROUP BY k, p, w.feature, sample"
    return f"SELECT k, p, median(CASE WHEN mu > 1 THEN sd / mu END) AS f FROM (SELECT k, p, feature, stddev_samp(v) AS sd, avg(v) AS mu FROM ({sums}) GROUP BY ALL) GROUP BY k, p"


def gradient_round(steps: int = 12, width: float = 1e-3) -> dict[str, str]:
    """One round from (0, 0) within [-1, 1] x [-1, 0]: probes, slope, steps; ``best`` has the point and its cost."""
    ahead = f"SELECT 5 + k AS k, [greatest(least(w[1] * pow(0.5, k), 1.0), -1.0), greatest(least(w[2] * pow(0.5, k), 0.0), -1.0)] AS p FROM (SELECT unnest(range({steps})) AS k, w FROM way)"
    return dict(
        c0=_listed(np.zeros((1, 2))), r0=adaptive_rate("c0", REFERENCE),
        c1=_listed(search.probes(np.zeros(2), ((-1, 1), (-1, 0)), width)), r1=adaptive_rate("c1", REFERENCE),
        sl=f"SELECT (any_value(f) FILTER (k = 1) - any_value(f) FILTER (k = 2)) / {2 * width} AS a, (any_value(f) FILTER (k = 3) - any_value(f) FILTER (k = 4)) / {width} AS b FROM r1",
        way="SELECT [-a / greatest(abs(a), abs(b)), -b / greatest(abs(a), abs(b))] AS w FROM sl", c2=ahead, r2=adaptive_rate("c2", REFERENCE),
        al="SELECT 0 AS k, p, f FROM r0 UNION ALL SELECT k, p, f FROM r1 UNION ALL SELECT k, p, f FROM r2", best="SELECT p, f FROM al ORDER BY f, k LIMIT 1",
        q0="SELECT 1 AS k, p FROM c0 UNION ALL SELECT 2, p FROM best", rq=adaptive_rate("q0", QC),
    )


GAIN = "(SELECT any_value(f) FILTER (k = 1) AS before, any_value(f) FILTER (k = 2) AS after FROM rq)"


@query(_materialized(with_ctes(f"SELECT round(p[1], 6) AS mz_scaled, round(p[2], 6) AS shape_low, round(r0.f, 8) AS reference_before, round(best.f, 8) AS reference_after, round(before, 8) AS qc_before, round(after, 8) AS qc_after, (r0.f - best.f) / r0.f >= 0.001 AND (before - after) / before >= 0.001 AS used FROM (SELECT f FROM r0) r0, best, {GAIN}", "m", **ADAPTIVE, **gradient_round())))
def rup_learned_adaptive(spark, sf):
    """RUP-08: betas of m/z and low shape after one round, checked on the qc samples."""
    cells = b.dense(spark, sf).select("feature", "transition", "sample", F.pow(F.lit(2.0), F.col("x")).alias("area"), F.col("transition").cast("double").alias("mz"))
    shape = _shapes(spark, sf).groupBy("feature", "transition", "sample").agg(F.max("shape").alias("shape"))
    got = learn.learn_adaptive(cells.join(shape, ["feature", "transition", "sample"], "left"), REFERENCE, QC, rounds=1)
    row = (*got.betas.values(), *got.reference_cv, *got.qc_cv)
    out = spark.createDataFrame([(*(round(v, 6) for v in row[:2]), *(round(v, 8) for v in row[2:]), got.use)], "mz_scaled double, shape_low double, reference_before double, reference_after double, qc_before double, qc_after double, used boolean")
    return out


WINDOWS = dict(
    vr="SELECT sample, pow(2.0, x) AS v, row_number() OVER (PARTITION BY sample ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY sample) AS n FROM v",
    vs="SELECT *, greatest(100, n // 20) AS w FROM vr",
    vw="SELECT sample, v, p, n, w, unnest(range(0, n - w, w // 4)) AS a FROM vs",
    vf="SELECT sample, 1 / median(v) AS start FROM vr GROUP BY sample",
)
FACTORS = (0.25, 1.0, 4.0)


@query(_materialized(with_ctes(
    f"SELECT sample, CAST(k AS BIGINT) AS k, round(stddev_pop(var) / avg(var), 8) AS cost FROM (SELECT vw.sample, k, a, var_pop(asinh(start * f * v)) AS var FROM vw JOIN vf USING (sample), (SELECT unnest({list(FACTORS)}) AS f, unnest(range({len(FACTORS)})) AS k) WHERE p >= a AND p < a + w GROUP BY ALL) GROUP BY ALL", "v", **WINDOWS)))
def nrm_vsn_evenness(spark, sf):
    """NRM-06: what the search rates, at three multiples of 1 / median."""
    v = Scratch(spark, "even").table(b.values(spark, sf).select("sample", "x"), "values")
    start = v.groupBy("sample").agg((1 / F.median(F.pow(F.lit(2.0), F.col("x")))).alias("start"))
    factors = start.select("sample", F.array(*[F.lit(f) * F.col("start") for f in FACTORS]).alias("factors"))
    return rounded(nrm.vsn_evenness(nrm.vsn_windows(v, Scratch(spark, "even")), factors), digits=8)


@query()
def nrm_vsn_optimized(spark, sf):
    """NRM-06: every sample with its own searched factor."""
    return rounded(nrm.vsn_normalize(b.values(spark, sf).select("feature", "sample", "x"), optimize=True))


def _written(rows, spark) -> str:
    path = Scratch(spark, "outputs").path("run")
    outputs.write_outputs(rows, path)
    return path


POLISH = "SELECT entity AS k, feature AS i, sample AS s, x FROM v"


@query(polish_sql(POLISH, _polished("entity", ""), "v"))
def out_polish_values(spark, sf):
    """SNK-05: values of a polish, from the write that also holds its residuals."""
    path = _written(outputs.rollup_outputs(_entity(spark, sf)), spark)
    return rounded(outputs.read_output(spark, path, "values"), digits=5)


@query(polish_sql(POLISH, "SELECT k AS entity, i AS feature, s AS sample, round(r, 5) AS residual, round(re, 5) AS row_effect, round(avg(r) OVER w, 5) AS residual_mean, round(stddev_pop(r) OVER w, 5) AS residual_std, round(median(abs(r - mid)) OVER w, 5) AS residual_mad, round(max(abs(r)) OVER w, 5) AS residual_max_abs FROM (SELECT *, median(r) OVER (PARTITION BY k, i) AS mid FROM {last}) WINDOW w AS (PARTITION BY k, i)", "v"))
def out_polish_residuals(spark, sf):
    """SNK-05, RUP-32: residuals with their rows' summaries."""
    path = _written(outputs.rollup_outputs(_entity(spark, sf)), spark)
    return rounded(outputs.read_output(spark, path, "residuals"), digits=5)


@query(with_ctes(
    "SELECT entity, feature, k AS selection_rank, 'median_abundance' AS selection_method, n AS n_rows, least(n, 3) AS n_selected FROM t WHERE k <= 3", "v",
    r="SELECT entity, feature, sample, round(x, 6) AS x FROM v",
    t="SELECT entity, feature, row_number() OVER (PARTITION BY entity ORDER BY median(x) DESC NULLS LAST, count(x) DESC, feature) AS k, count(*) OVER (PARTITION BY entity) AS n FROM r GROUP BY entity, feature"))
def out_topn_selections(spark, sf):
    """RUP-32: which features stand for each entity."""
    rows = _entity(spark, sf).withColumn("x", F.round("x", 6))
    return rounded(outputs.read_output(spark, _written(outputs.rollup_outputs(rows, method="topn"), spark), "selections"))


@query(with_ctes(
    "SELECT feature, transition, sample, round(1 / v / sum(1 / v) OVER (PARTITION BY feature, sample), 8) AS weight, count(*) OVER (PARTITION BY feature, sample) AS n_rows FROM q2", "m",
    q1="SELECT feature, transition, sample, x, (pow(2.0, x) + 0.01 * pow(2.0, x) * pow(2.0, x) + 100.0) / pow(pow(2.0, x) * ln(2.0), 2) AS v FROM m",
    q2="SELECT feature, transition, sample, x, least(v, 100.0 * min(v) OVER (PARTITION BY feature, sample)) AS v FROM q1"))
def out_quality_weights(spark, sf):
    """RUP-32: the weight of each transition in each sample."""
    m, samples = b.dense_rows(spark, sf)
    path = _written(outputs.rollup_outputs(m, "feature", "transition", "quality_weighted", samples=samples), spark)
    return rounded(outputs.read_output(spark, path, "weights", "feature", "transition"), digits=8)


@query(with_ctes(
    "SELECT feature, sample, round(sum(x / v) / sum(1 / v), 6) AS value, round(sqrt(1 / sum(1 / v)), 6) AS uncertainty, count(*) AS n_rows FROM q2 GROUP BY ALL", "m",
    q1="SELECT feature, transition, sample, x, (pow(2.0, x) + 0.01 * pow(2.0, x) * pow(2.0, x) + 100.0) / pow(pow(2.0, x) * ln(2.0), 2) AS v FROM m",
    q2="SELECT feature, sample, x, least(v, 100.0 * min(v) OVER (PARTITION BY feature, sample)) AS v FROM q1"))
def out_quality_values(spark, sf):
    """RUP-32: the values of the same write."""
    m, samples = b.dense_rows(spark, sf)
    path = _written(outputs.rollup_outputs(m, "feature", "transition", "quality_weighted", samples=samples), spark)
    return rounded(outputs.read_output(spark, path, "values", "feature", "transition"))
