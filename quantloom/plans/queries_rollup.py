"""Queries over sources, rollups and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import columns as names
from quantloom.operators import normalize as nrm
from quantloom.operators import rollup as rup
from quantloom.operators.kernels import median_polish_residuals
from quantloom.runtime import table

from . import binding as b
from .binding import with_ctes

QUERIES: dict = {}


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; integers as longs."""
    for c, t in df.dtypes:
        if t == "double" or c in cols:
            df = df.withColumn(c, F.round(c, digits))
        elif t in ("int", "smallint"):
            df = df.withColumn(c, F.col(c).cast("long"))
    return df


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


S = "log2(greatest(sum({w}pow(2.0, x)), 1.0))"


@query(with_ctes("SELECT feature, concat(transition, '_z', transition, '_', transition) AS transition_id, concat(sample, '__@__', batch) AS sample_id, sample AS replicate, sample_type, count(*) AS n, max(area) AS area FROM report GROUP BY ALL", "report"))
def src_transition_report(spark, sf):
    """SRC-03, PRJ-01..03: ids synthesised, replicate split off again."""
    r = b.report(spark, sf)
    t = F.col("transition").cast("string")
    r = r.withColumn("transition_id", names.transition_id(t, F.col("transition"), F.col("transition"))).withColumn("sample_id", names.sample_id(F.col("sample"), F.col("batch")))
    return r.groupBy("feature", "transition_id", "sample_id", names.replicate_of(F.col("sample_id")).alias("replicate"), "sample_type").agg(F.count("*").alias("n"), F.max("area").alias("area"))


@query(with_ctes("SELECT count(DISTINCT feature) AS features, count(DISTINCT concat(feature, '|', transition)) AS transitions, count(DISTINCT sample) AS samples, count(*) AS n FROM report", "report"))
def agg_corpus_counts(spark, sf):
    return b.report(spark, sf).agg(F.countDistinct("feature").alias("features"), F.countDistinct(F.concat_ws("|", F.col("feature").cast("string"), F.col("transition").cast("string"))).alias("transitions"), F.countDistinct("sample").alias("samples"), F.count("*").alias("n"))


@query(with_ctes("SELECT sample, batch, sample_type, count(*) AS n, count(DISTINCT feature) AS features FROM report GROUP BY ALL", "report"))
def agg_sample_counts(spark, sf):
    return b.report(spark, sf).groupBy("sample", "batch", "sample_type").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("features"))


@query("SELECT n_name AS name, CASE WHEN contains(n_name, '1') THEN 'reference' WHEN contains(n_name, '2') THEN 'qc' ELSE 'experimental' END AS kind FROM nation")
def flt_type_by_name(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select(n.alias("name"), names.type_by_name(n, ["1"], ["2"]).alias("kind"))


@query(with_ctes("SELECT feature, transition, sample, round(x, 6) AS x FROM m", "m"))
def matrix_imputed(spark, sf):
    return rounded(b.dense(spark, sf))


@query(with_ctes("SELECT m.feature, sample, round(log2(greatest(sum(pow(2.0, x)), 1.0)), 6) AS value, count(*) AS n_transitions FROM m JOIN (SELECT feature FROM cells GROUP BY feature HAVING count(DISTINCT transition) >= 3) k ON k.feature = m.feature GROUP BY ALL", "m"))
def rup_sum(spark, sf):
    c = b.cells(spark, sf)
    return rounded(rup.rollup_sum(rup.matrix(c, rup.sample_list(c), min_transitions=3)))


TOPN = dict(
    s="SELECT feature, transition, avg(pow(2.0, x)) AS mean FROM m GROUP BY ALL",
    r="SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(mean, 6) DESC, transition) AS k FROM s",
    t="SELECT feature, transition, {w} AS w, count(*) OVER (PARTITION BY feature) AS n FROM r WHERE k <= 3",
    u="SELECT feature, transition, w * n / sum(w) OVER (PARTITION BY feature) AS w, n FROM t",
)


def _topn(w):
    return with_ctes("SELECT m.feature, m.sample, round(log2(greatest(sum(u.w * pow(2.0, m.x)), 1.0)), 6) AS value, CAST(max(u.n) AS BIGINT) AS n_transitions FROM m JOIN u ON u.feature = m.feature AND u.transition = m.transition GROUP BY ALL", "m", **{k: q.format(w=w) for k, q in TOPN.items()})


def _topn_scores(m):
    return m.groupBy("feature", "transition").agg(F.round(F.avg(F.pow(F.lit(2.0), F.col("x"))), 6).alias("score"))


@query(_topn("sqrt(greatest(mean, 1.0))"))
def rup_topn_sqrt(spark, sf):
    m = b.dense(spark, sf)
    return rounded(rup.rollup_topn(m, 3, "sqrt", _topn_scores(m)))


@query(_topn("1.0"))
def rup_topn_equal(spark, sf):
    m = b.dense(spark, sf)
    return rounded(rup.rollup_topn(m, 3, "equal", _topn_scores(m)))


CONSENSUS = dict(
    c1="SELECT feature, transition, sample, x, x - median(x) OVER (PARTITION BY feature, transition) AS centred FROM m",
    c2="SELECT *, centred - median(centred) OVER (PARTITION BY feature, sample) AS residual FROM c1",
    c3="SELECT *, var_pop(residual) OVER (PARTITION BY feature, transition) AS variance FROM c2",
    c4="SELECT *, 1 / (variance + 0.1) * count(*) OVER (PARTITION BY feature, sample) / sum(1 / (variance + 0.1)) OVER (PARTITION BY feature, sample) AS weight FROM c3",
)


@query(with_ctes("SELECT feature, sample, round(log2(greatest(sum(weight * pow(2.0, x)), 1.0)), 6) AS value, round(stddev_pop(residual), 6) AS uncertainty, count(*) AS n_transitions FROM c4 GROUP BY ALL", "m", **CONSENSUS))
def rup_consensus(spark, sf):
    m, samples = b.dense_rows(spark, sf)
    return rounded(rup.rollup_consensus(m, samples=samples))


@query(with_ctes("SELECT feature, transition, sample, round(x, 5) AS x, round(residual, 5) AS residual, round(variance, 5) AS variance, round(weight, 5) AS weight FROM c4", "m", **CONSENSUS))
def rup_consensus_diagnostics(spark, sf):
    m, samples = b.dense_rows(spark, sf)
    return rounded(rup.consensus_cells(m, samples=samples), digits=5)


@query(with_ctes(
    "SELECT m.feature, m.sample, round(log2(greatest(sum(w.w * pow(2.0, m.x)), 1.0)), 6) AS value, count(*) AS n_transitions FROM m JOIN w ON w.feature = m.feature AND w.transition = m.transition GROUP BY ALL", "m",
    d="SELECT feature, transition, avg(x) AS ml, avg(pow(2.0, x)) AS lin FROM m GROUP BY ALL",
    e="SELECT feature, transition, ml - avg(ml) OVER (PARTITION BY feature) AS li, lin / max(lin) OVER (PARTITION BY feature) AS rel FROM d",
    z="SELECT feature, transition, exp(greatest(least(0.3 * li - 0.5 * rel, 50.0), -50.0)) AS w FROM e",
    w="SELECT feature, transition, w * count(*) OVER (PARTITION BY feature) / sum(w) OVER (PARTITION BY feature) AS w FROM z"))
def rup_adaptive(spark, sf):
    m = b.dense(spark, sf)
    return rounded(rup.rollup_weighted(m, rup.adaptive_weights(rup.transition_descriptors(m), {"log_intensity": 0.3, "relative": -0.5})))


@query(with_ctes(
    "SELECT feature, sample, round(sum(x / v) / sum(1 / v), 6) AS value, round(sqrt(1 / sum(1 / v)), 6) AS uncertainty, count(*) AS n_transitions FROM q2 GROUP BY ALL", "m",
    q1="SELECT feature, transition, sample, x, (pow(2.0, x) + 0.01 * pow(2.0, x) * pow(2.0, x) + 100.0) / pow(pow(2.0, x) * ln(2.0), 2) AS v FROM m",
    q2="SELECT feature, sample, x, least(v, 100.0 * min(v) OVER (PARTITION BY feature, sample)) AS v FROM q1"))
def rup_quality_weighted(spark, sf):
    return rounded(rup.rollup_quality_weighted(b.dense(spark, sf)))


def polish_sql(cells: str, select: str, *needs: str, sweeps: int = 20) -> str:
    """Median polish of dense matrices, one CTE per half sweep; ``cells`` gives k, i (row), s (column), x."""
    ctes = {"p0": f"SELECT k, i, s, x AS r, 0.0::DOUBLE AS re, 0.0::DOUBLE AS ce, 0.0::DOUBLE AS ov, false AS done FROM ({cells})"}
    for n in range(sweeps):
        ctes[f"h{n}"] = f"SELECT *, r - d AS r1, re + d AS re1, ce - c AS ce1, ov + c AS ov1 FROM (SELECT *, median(r) OVER (PARTITION BY k, i) AS d, median(ce) OVER (PARTITION BY k, i) AS c FROM p{n})"
        ctes[f"q{n}"] = f"SELECT *, r1 - e AS r2, ce1 + e AS ce2, re1 - c2 AS re2, ov1 + c2 AS ov2 FROM (SELECT *, median(r1) OVER (PARTITION BY k, s) AS e, median(re1) OVER (PARTITION BY k, s) AS c2 FROM h{n})"
        keep = ", ".join(f"CASE WHEN done THEN {c} ELSE {c}2 END AS {c}" for c in ("r", "re", "ce", "ov"))
        ctes[f"p{n + 1}"] = f"SELECT k, i, s, {keep}, done OR max(abs(r2 - r)) OVER (PARTITION BY k) < 1e-4 AS done FROM q{n}"
    sql = with_ctes(select.format(last=f"p{sweeps}"), *needs, **ctes)
    return sql.replace(" AS (SELECT *, r - d", " AS MATERIALIZED (SELECT *, r - d").replace(" AS (SELECT *, r1 - e", " AS MATERIALIZED (SELECT *, r1 - e").replace(" AS (SELECT k, i, s,", " AS MATERIALIZED (SELECT k, i, s,")


POLISHED = "SELECT k AS {{key}}, s AS sample, round(max(ov + ce){{plus}}, 5) AS value, round(max(u), 5) AS uncertainty, max(n) AS n_rows FROM (SELECT p.*, u.u, u.n FROM {last} p JOIN (SELECT k, sqrt(avg(v)) AS u, count(*) AS n FROM (SELECT k, i, var_pop(r) AS v FROM {last} GROUP BY ALL) GROUP BY ALL) u ON u.k = p.k) GROUP BY k, s"


def _polished(key: str, plus: str) -> str:
    return POLISHED.replace("{{key}}", key).replace("{{plus}}", plus)


@query(polish_sql("SELECT feature AS k, transition AS i, sample AS s, x FROM m", _polished("feature", " + log2(max(n))"), "m"))
def rup_median_polish(spark, sf):
    """RUP-01/02."""
    return rounded(rup.rollup_median_polish(b.dense(spark, sf)), digits=5)


def _entity(spark, sf):
    return b.values(spark, sf).select("entity", "feature", "sample", "x")


@query(with_ctes("SELECT entity, sample, round(log2(greatest(sum(pow(2.0, x)), 1.0)), 6) AS value FROM v GROUP BY ALL", "v"))
def ent_sum(spark, sf):
    return rounded(rup.entity_sum(_entity(spark, sf)))


@query(with_ctes("SELECT entity, sample, round(sum(x), 4) AS value FROM v GROUP BY ALL", "v"))
def ent_log_sum(spark, sf):
    return rounded(rup.entity_log_sum(_entity(spark, sf)), digits=4)


@query(with_ctes(
    "SELECT v.entity, v.sample, round(avg(v.x), 6) AS value FROM v JOIN t ON t.entity = v.entity AND t.feature = v.feature WHERE t.k <= 3 GROUP BY ALL", "v",
    t="SELECT entity, feature, row_number() OVER (PARTITION BY entity ORDER BY round(median(x), 9) DESC NULLS LAST, count(x) DESC, feature) AS k FROM v GROUP BY entity, feature"))
def ent_topn(spark, sf):
    return rounded(rup.entity_topn(_entity(spark, sf), 3))


@query(with_ctes("SELECT v.entity, v.sample, round(log2(sum(pow(2.0, x)) / n.n), 6) AS value FROM v JOIN (SELECT p_brand AS entity, count(DISTINCT p_size) AS n FROM part GROUP BY ALL) n ON n.entity = v.entity GROUP BY v.entity, v.sample, n.n", "v"))
def ent_ibaq(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.countDistinct("p_size").alias("n_theoretical"))
    return rounded(rup.entity_ibaq(_entity(spark, sf), n))


@query(with_ctes(
    "SELECT entity, s AS sample, round(profile - median(profile) OVER (PARTITION BY entity) + median(med) OVER (PARTITION BY entity), 6) AS value FROM p", "v",
    r="SELECT a.entity, a.sample AS s, b.sample AS t, median(a.x - b.x) AS r FROM v a JOIN v b ON a.entity = b.entity AND a.feature = b.feature AND a.sample <> b.sample GROUP BY ALL",
    o="SELECT entity, sample AS s, median(x) AS med, (SELECT count(DISTINCT sample) FROM v w WHERE w.entity = v.entity) AS n FROM v GROUP BY ALL",
    p="SELECT o.entity, o.s, o.med, coalesce(q.total, 0.0) / o.n AS profile FROM o LEFT JOIN (SELECT entity, s, sum(r) AS total FROM r GROUP BY ALL) q ON q.entity = o.entity AND q.s = o.s"))
def ent_max_ratio(spark, sf):
    return rounded(rup.entity_max_ratio(_entity(spark, sf)))


@query(with_ctes("SELECT entity, sample, count(x) AS n, round(stddev_samp(x), 6) AS sd, round(stddev_samp(x) / sqrt(count(x)), 6) AS uncertainty, concat_ws(';', CASE WHEN count(x) = 1 THEN 'single_feature' END, CASE WHEN count(x) = 2 THEN 'two_features' END) AS qc_flag FROM v GROUP BY ALL", "v"))
def ent_spread(spark, sf):
    return rounded(rup.entity_spread(_entity(spark, sf)))


@query(with_ctes(
    "SELECT k.entity, k.sample, round(CASE WHEN k.n = 1 THEN k.only WHEN k.n < 3 THEN k.summed ELSE a.value END, 6) AS value, k.n AS n_features, k.n < 3 AS low_confidence FROM k LEFT JOIN a ON a.entity = k.entity AND a.sample = k.sample", "v",
    e="SELECT concat(entity, CAST(CAST(rt AS INT) AS VARCHAR)) AS entity, feature, sample, x FROM v",
    n="SELECT entity, count(DISTINCT feature) AS n FROM e GROUP BY ALL",
    k="SELECT e.entity, e.sample, n.n, max(x) AS only, log2(greatest(sum(pow(2.0, x)), 1.0)) AS summed FROM e JOIN n ON n.entity = e.entity GROUP BY ALL",
    a="SELECT entity, sample, sum(x) AS value FROM e GROUP BY ALL"))
def ent_rules(spark, sf):
    """RUP-20: one row unchanged, fewer than three summed, else the method."""
    e = b.values(spark, sf).select(F.concat("entity", F.col("rt").cast("int").cast("string")).alias("entity"), "feature", "sample", "x")
    return rounded(rup.entity_rules(e, rup.entity_log_sum(e)))


@query(polish_sql("SELECT entity AS k, feature AS i, sample AS s, x FROM v", _polished("entity", ""), "v"))
def ent_median_polish(spark, sf):
    """RUP-21."""
    return rounded(rup.rollup_median_polish(_entity(spark, sf), "entity", "feature", log_count=False), digits=5)


@query(polish_sql("SELECT entity AS k, feature AS i, sample AS s, x FROM v", "SELECT k AS entity, i AS feature, s AS sample, round(r, 5) AS residual, round(re, 5) AS row_effect, round(ce, 5) AS column_effect, round(ov, 5) AS overall FROM {last}", "v"))
def ent_residuals(spark, sf):
    """SNK-05, RUP-32: the parts of every cell, long."""
    return rounded(median_polish_residuals(_entity(spark, sf), "entity", "feature"), digits=5)


@query(with_ctes(
    "SELECT entity, feature, round(CASE WHEN mad > 0 THEN row_mad / mad ELSE 0.0 END, 5) AS score, round(share, 5) AS share FROM (SELECT r.entity, r.feature, o.mad, median(abs(r.residual - rm.rm)) AS row_mad, avg(CAST(abs(r.residual) > 3 * o.mad AS DOUBLE)) AS share FROM r JOIN rm ON rm.entity = r.entity AND rm.feature = r.feature JOIN o ON o.entity = r.entity GROUP BY r.entity, r.feature, o.mad)", "v",
    r="SELECT entity, feature, sample, round(x - median(x) OVER (PARTITION BY entity, sample), 9) AS residual FROM v",
    c="SELECT entity, median(residual) AS m FROM r GROUP BY ALL",
    o="SELECT r.entity, median(abs(residual - c.m)) AS mad FROM r JOIN c ON c.entity = r.entity GROUP BY ALL",
    rm="SELECT entity, feature, median(residual) AS rm FROM r GROUP BY ALL"))
def ent_outlier_rows(spark, sf):
    from pyspark.sql import Window

    r = _entity(spark, sf).withColumn("residual", F.round(F.col("x") - F.median("x").over(Window.partitionBy("entity", "sample")), 9))
    return rounded(rup.outlier_rows(r).drop("flagged"), digits=5)


@query(with_ctes("SELECT v.feature, v.sample, round(v.x - (med.med - (SELECT median(med) FROM med)), 6) AS x FROM v JOIN med USING (sample)", "v", med="SELECT sample, median(x) AS med FROM v GROUP BY sample"))
def nrm_median(spark, sf):
    return rounded(nrm.median_normalize(b.values(spark, sf)).select("feature", "sample", "x"))


@query(with_ctes(
    "SELECT r.feature, r.sample, round((a.ref + c.ref) / 2, 5) AS x FROM r JOIN ref a ON a.k = CAST(floor(r.at) AS BIGINT) JOIN ref c ON c.k = CAST(ceil(r.at) AS BIGINT)", "v",
    w="SELECT feature, sample, round(x, 9) AS x FROM v",
    r="SELECT feature, sample, x, row_number() OVER (PARTITION BY sample ORDER BY x) AS k, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2 AS at FROM w",
    ref="SELECT k, avg(x) AS ref FROM r GROUP BY ALL"))
def nrm_quantile(spark, sf):
    v = b.values(spark, sf).select("feature", "sample", F.round("x", 9).alias("x"))
    return rounded(nrm.quantile_normalize(v), digits=5)


@query(with_ctes("SELECT v.feature, v.sample, round(asinh(pow(2.0, v.x) / med.med), 6) AS x FROM v JOIN med USING (sample)", "v", med="SELECT sample, median(pow(2.0, x)) AS med FROM v GROUP BY sample"))
def nrm_vsn(spark, sf):
    return rounded(nrm.vsn_normalize(b.values(spark, sf)).select("feature", "sample", "x"))


@query(with_ctes("SELECT feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, count(x) AS n, round(median(rt), 6) AS rt, round(coalesce(stddev_samp(pow(2.0, x)) / avg(pow(2.0, x)), 0.0), 6) AS cv FROM v WHERE sample_type = 'reference' GROUP BY ALL", "v"))
def nrm_reference_statistics(spark, sf):
    refs = [r[0] for r in b.samples(spark, sf).where("sample_type = 'reference'").select("sample").orderBy("sample").collect()]
    return rounded(nrm.reference_statistics(b.values(spark, sf), refs))


@query(with_ctes(
    "SELECT med.sample, round(med.med, 1) AS linear_median, round(q1 - 1.5 * (q3 - q1), 1) AS low_limit, round(0.1 * mid, 1) AS fold_limit, med.med < q1 - 1.5 * (q3 - q1) OR med.med < 0.1 * mid AS outlier FROM med, q", "v",
    med="SELECT sample, median(pow(2.0, x)) AS med FROM v GROUP BY sample",
    q="SELECT quantile_cont(med, 0.25) AS q1, quantile_cont(med, 0.75) AS q3, median(med) AS mid FROM med"))
def nrm_sample_outliers(spark, sf):
    return rounded(nrm.sample_outliers(b.values(spark, sf)), digits=1)


@query()
def nrm_rt_lowess(spark, sf):
    return rounded(nrm.rt_lowess_normalize(b.values(spark, sf)).select("feature", "sample", "x"))


@query()
def nrm_lowess_curves(spark, sf):
    return rounded(nrm.lowess_curves(b.values(spark, sf)))


def _refs(spark, sf):
    return [r[0] for r in b.samples(spark, sf).where("sample_type = 'reference'").select("sample").orderBy("sample").collect()]


#: Residuals of the reference samples of each batch at the features' median reference time.
RESIDUALS = dict(
    st="SELECT feature, avg(x) AS mean, median(rt) AS rt FROM v WHERE sample_type = 'reference' GROUP BY ALL",
    r="SELECT v.batch, st.rt, v.x - st.mean AS y FROM v JOIN st ON st.feature = v.feature WHERE v.sample_type = 'reference'",
)


@query(with_ctes(
    "SELECT feature, sample, round(x - (c.m[CAST(i + 1 AS BIGINT)] * (1 - (pos - i)) + c.m[CAST(i + 2 AS BIGINT)] * (pos - i)), 6) AS x FROM (SELECT *, least(floor(pos), 18) AS i FROM (SELECT v.feature, v.sample, v.batch, v.x, greatest(least((st.rt - s.lo) / s.w - 0.5, 19.0), 0.0) AS pos FROM v JOIN st ON st.feature = v.feature JOIN s ON s.batch = v.batch)) q JOIN c ON c.batch = q.batch", "v", **RESIDUALS,
    s="SELECT batch, min(rt) AS lo, (max(rt) - min(rt)) / 20 AS w FROM r GROUP BY ALL",
    bins="SELECT r.batch, CAST(floor((r.rt - s.lo) / s.w) AS BIGINT) AS k, median(y) AS m FROM r JOIN s ON s.batch = r.batch WHERE floor((r.rt - s.lo) / s.w) < 20 GROUP BY ALL",
    c="SELECT g.batch, list(coalesce(bins.m, 0.0) ORDER BY g.k) AS m FROM (SELECT batch, t.k FROM s, range(0, 20) t(k)) g LEFT JOIN bins ON bins.batch = g.batch AND bins.k = g.k GROUP BY ALL"))
def nrm_rt_binned(spark, sf):
    """NRM-09."""
    v = b.values(spark, sf)
    refs = _refs(spark, sf)
    return rounded(nrm.rt_binned_correction(v, nrm.reference_statistics(v, refs), refs).select("feature", "sample", "x"))


def _cubic_sql() -> dict[str, str]:
    """CTEs that solve each batch's normal equations of a cubic by elimination."""
    n = range(4)
    steps = {"g0": "SELECT batch, " + ", ".join([f"sum(pow(t, {i + j})) AS a{i}{j}" for i in n for j in n] + [f"sum(pow(t, {i}) * y) AS b{i}" for i in n]) + " FROM tt GROUP BY ALL"}
    for p in range(3):
        f = lambda i: f"a{i}{p} / a{p}{p}"  # noqa: E731, B023
        cols = [f"a{i}{j} - {f(i)} * a{p}{j} AS a{i}{j}" if i > p else f"a{i}{j}" for i in n for j in n] + [f"b{i} - {f(i)} * b{p} AS b{i}" if i > p else f"b{i}" for i in n]
        steps[f"g{p + 1}"] = f"SELECT batch, {', '.join(cols)} FROM g{p}"
    steps["co"] = "SELECT batch, c3, c2, c1, (b0 - a01 * c1 - a02 * c2 - a03 * c3) / a00 AS c0 FROM (SELECT *, (b1 - a12 * c2 - a13 * c3) / a11 AS c1 FROM (SELECT *, (b2 - a23 * c3) / a22 AS c2 FROM (SELECT *, b3 / a33 AS c3 FROM g3)))"
    return steps


@query(with_ctes(
    "SELECT feature, sample, round(x - (c0 + t * (c1 + t * (c2 + t * c3))), 5) AS x FROM (SELECT v.*, 2 * (st.rt - lo) / (hi - lo) - 1 AS t FROM v JOIN st ON st.feature = v.feature, sp) q JOIN co ON co.batch = q.batch", "v", **RESIDUALS,
    sp="SELECT min(rt) AS lo, max(rt) AS hi FROM st", tt="SELECT batch, 2 * (rt - lo) / (hi - lo) - 1 AS t, y FROM r, sp", **_cubic_sql()))
def nrm_rt_spline(spark, sf):
    """NRM-08: here the cubic already meets the smoothing rule; knots are tested on made data."""
    v = b.values(spark, sf)
    refs = _refs(spark, sf)
    return rounded(nrm.rt_spline_correction(v, nrm.reference_statistics(v, refs), refs).select("feature", "sample", "x"), digits=5)
