"""Queries over peak quality, library fits, and the remaining metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import compare as cmp
from quantloom.operators import joins
from quantloom.operators import library as lib
from quantloom.operators import normalize as nrm
from quantloom.operators import qc
from quantloom.operators import rollup as rup
from quantloom.runtime import table
from quantloom.scratch import Scratch

from . import binding as b
from .binding import with_ctes
from .queries_rollup import CONSENSUS, rounded

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _quality(spark, sf) -> DataFrame:
    """(feature, transition, sample, area, shape, coeluting, rt): one row per line, with peak quality."""
    l = table(spark, sf, "lineitem")
    name = F.when(F.col("l_linenumber") == 7, "precursor").otherwise(F.col("l_linenumber").cast("string"))
    return l.select(F.col("l_partkey").alias("feature"), name.alias("transition"), (F.col("l_suppkey") % 12).alias("sample"), F.col("l_extendedprice").alias("area"), F.when(F.col("l_quantity") > 3, 1 - F.col("l_discount") * 8).alias("shape"), (F.col("l_linestatus") == "O").alias("coeluting"), F.when(F.col("l_quantity") > 2, F.col("l_tax") * 100).alias("rt"))


Q = "SELECT l_partkey AS feature, CASE WHEN l_linenumber = 7 THEN 'precursor' ELSE CAST(l_linenumber AS VARCHAR) END AS transition, l_extendedprice AS area, CASE WHEN l_quantity > 3 THEN 1 - l_discount * 8 END AS shape, l_linestatus = 'O' AS coeluting, CASE WHEN l_quantity > 2 THEN l_tax * 100 END AS rt FROM lineitem"


@query(with_ctes("SELECT feature, round(avg(rt), 6) AS mean_rt FROM q WHERE transition <> 'precursor' GROUP BY ALL", q=Q))
def agg_mean_times(spark, sf):
    """AGG-11."""
    return rounded(rup.mean_times(_quality(spark, sf)))


@query(with_ctes("SELECT feature, transition, round(coalesce(sum(area * shape) / sum(CASE WHEN shape IS NOT NULL THEN area END), 0.5), 6) AS shape, round(coalesce(sum(area * CAST(coeluting AS INT)) / sum(area), 0.5), 6) AS coeluting FROM q GROUP BY ALL", q=Q))
def agg_quality_means(spark, sf):
    """AGG-12."""
    q = _quality(spark, sf)
    return rounded(rup.quality_means(q, "shape").join(rup.quality_means(q, "coeluting"), ["feature", "transition"]))


@query(with_ctes(
    "SELECT entity, feature, round(avg(residual), 5) AS residual_mean, round(stddev_pop(residual), 5) AS residual_sd, round(median(abs(residual - m)), 5) AS residual_mad, round(max(abs(residual)), 5) AS residual_max_abs FROM (SELECT *, median(residual) OVER (PARTITION BY entity, feature) AS m FROM r) GROUP BY ALL", "v",
    r="SELECT entity, feature, sample, x - median(x) OVER (PARTITION BY entity, sample) AS residual FROM v"))
def agg_residual_summary(spark, sf):
    """AGG-13."""
    v = b.values(spark, sf)
    mid = v.groupBy("entity", "sample").agg(F.median("x").alias("mid"))
    r = v.join(mid, ["entity", "sample"]).select("entity", "feature", "sample", (F.col("x") - F.col("mid")).alias("residual"))
    return rounded(rup.residual_summary(r), digits=5)


SHAPES = "SELECT l_partkey AS feature, l_linenumber AS transition, concat('S', lpad(CAST(l_suppkey % 12 AS VARCHAR), 2, '0')) AS sample, CASE WHEN l_quantity > 3 THEN 1 - l_discount * 8 END AS shape, l_linestatus = 'O' AS coeluting FROM lineitem"


def _shapes(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_partkey").alias("feature"), F.col("l_linenumber").alias("transition"), F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0")).alias("sample"), F.when(F.col("l_quantity") > 3, 1 - F.col("l_discount") * 8).alias("shape"), (F.col("l_linestatus") == "O").alias("coeluting"))


@query(with_ctes(
    "SELECT m.feature, m.sample, round(log2(greatest(sum(pow(2.0, m.x)), 1.0)), 6) AS value, CAST(max(t.n) AS BIGINT) AS n_transitions FROM m JOIN t ON t.feature = m.feature AND t.transition = m.transition GROUP BY ALL", "m",
    sh=SHAPES,
    sc="SELECT feature, transition, coalesce(round(median(shape), 9), 0.0) AS score FROM sh GROUP BY ALL",
    t="SELECT *, count(*) OVER (PARTITION BY feature) AS n FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, transition) AS k FROM sc) WHERE k <= 3"))
def rup_topn_shape(spark, sf):
    """RUP-04: chosen by median shape correlation."""
    scores = rup.shape_scores(_shapes(spark, sf)).withColumn("score", F.round("score", 9))
    return rounded(rup.rollup_topn(b.dense(spark, sf), 3, "equal", scores))


@query(with_ctes(
    "SELECT m.feature, m.sample, round(log2(greatest(sum(w.w * pow(2.0, m.x)), 1.0)), 6) AS value, count(*) AS n_transitions FROM m JOIN w ON w.feature = m.feature AND w.transition = m.transition GROUP BY ALL", "m",
    sh=SHAPES,
    d="SELECT feature, transition, avg(x) AS ml, avg(pow(2.0, x)) AS lin FROM m GROUP BY ALL",
    s="SELECT feature, transition, median(shape) AS md, max(shape) AS mx, avg(CAST(coalesce(shape, 1.0) < 0.5 AS DOUBLE)) AS low FROM sh GROUP BY ALL",
    e="SELECT d.feature, d.transition, ml - avg(ml) OVER (PARTITION BY d.feature) AS li, coalesce((d.transition - min(d.transition) OVER (PARTITION BY d.feature)) / nullif(CAST(max(d.transition) OVER (PARTITION BY d.feature) - min(d.transition) OVER (PARTITION BY d.feature) AS DOUBLE), 0.0), 0.5) AS mz, md, mx, low FROM d JOIN s ON s.feature = d.feature AND s.transition = d.transition",
    z="SELECT feature, transition, exp(greatest(least(0.3 * li + 0.4 * mz + 0.7 * coalesce(md, 0.0) + 0.2 * coalesce(mx, 0.0) - 0.5 * low, 50.0), -50.0)) AS w FROM e",
    w="SELECT feature, transition, w * count(*) OVER (PARTITION BY feature) / sum(w) OVER (PARTITION BY feature) AS w FROM z"))
def rup_adaptive_shape(spark, sf):
    """RUP-07: all descriptors."""
    m = b.dense(spark, sf)
    mz = m.select("feature", "transition").distinct().withColumn("mz", F.col("transition").cast("double"))
    d = rup.transition_descriptors(m, mz).join(rup.shape_descriptors(_shapes(spark, sf)), ["feature", "transition"])
    betas = {"log_intensity": 0.3, "mz_scaled": 0.4, "shape_median": 0.7, "shape_max": 0.2, "shape_low": -0.5}
    return rounded(rup.rollup_weighted(m, rup.adaptive_weights(d, betas)))


@query(with_ctes(
    "SELECT feature, sample, round(sum(x / v) / sum(1 / v), 6) AS value, round(sqrt(1 / sum(1 / v)), 6) AS uncertainty, count(*) AS n_transitions FROM q2 GROUP BY ALL", "m",
    sh=SHAPES,
    s="SELECT l_partkey AS feature, l_linenumber AS transition, coalesce(sum(l_extendedprice * CASE WHEN l_quantity > 3 THEN 1 - l_discount * 8 END) / sum(CASE WHEN l_quantity > 3 THEN l_extendedprice END), 0.5) AS shape, coalesce(sum(l_extendedprice * CAST(l_linestatus = 'O' AS INT)) / sum(l_extendedprice), 0.5) >= 0.5 AS co FROM lineitem GROUP BY ALL",
    q1="SELECT m.feature, m.transition, sample, x, (pow(2.0, x) + 0.01 * pow(2.0, x) * pow(2.0, x) + 100.0) * (1 + 1.0 * (pow(1 / greatest(s.shape, 0.01), 2.0) - 1)) * CASE WHEN s.co THEN 1.0 ELSE 10.0 END / pow(pow(2.0, x) * ln(2.0), 2) AS v FROM m JOIN s ON s.feature = m.feature AND s.transition = m.transition",
    q2="SELECT feature, sample, x, least(v, 100.0 * min(v) OVER (PARTITION BY feature, sample)) AS v FROM q1"))
def rup_quality_weighted_shape(spark, sf):
    """RUP-09: with shape and co-elution penalties."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_linenumber").alias("transition"), F.col("l_extendedprice").alias("area"), F.when(F.col("l_quantity") > 3, 1 - F.col("l_discount") * 8).alias("shape"), (F.col("l_linestatus") == "O").alias("coeluting"))
    q = rup.quality_means(l, "shape").join(rup.quality_means(l, "coeluting").withColumn("coeluting", F.col("coeluting") >= 0.5), ["feature", "transition"])
    return rounded(rup.rollup_quality_weighted(b.dense(spark, sf).join(q, ["feature", "transition"])))


@query(with_ctes(
    "SELECT 'sum' AS method, m.feature, m.sample, round(CASE WHEN k.n < 7 THEN median(x) ELSE log2(greatest(sum(pow(2.0, x)), 1.0)) END, 6) AS value, k.n AS n_transitions FROM m JOIN k ON k.feature = m.feature GROUP BY m.feature, m.sample, k.n UNION ALL SELECT 'consensus', c4.feature, sample, round(CASE WHEN k.n < 7 THEN median(x) ELSE log2(greatest(sum(weight * pow(2.0, x)), 1.0)) END, 6), k.n FROM c4 JOIN k ON k.feature = c4.feature GROUP BY c4.feature, sample, k.n UNION ALL SELECT 'quality_weighted', q2.feature, sample, round(CASE WHEN k.n < 7 THEN median(x) ELSE sum(x / v) / sum(1 / v) END, 6), k.n FROM q2 JOIN k ON k.feature = q2.feature GROUP BY q2.feature, sample, k.n", "m",
    k="SELECT feature, count(DISTINCT transition) AS n FROM m GROUP BY ALL", **CONSENSUS,
    q1="SELECT feature, transition, sample, x, (pow(2.0, x) + 0.01 * pow(2.0, x) * pow(2.0, x) + 100.0) / pow(pow(2.0, x) * ln(2.0), 2) AS v FROM m",
    q2="SELECT feature, sample, x, least(v, 100.0 * min(v) OVER (PARTITION BY feature, sample)) AS v FROM q1"))
def rup_dispatch(spark, sf):
    """RUP-12, RUP-13: by name; features of few transitions give their median."""
    m = Scratch(spark, "dispatch").table(b.dense(spark, sf), "matrix")
    made = [rup.rollup_transitions(m, method, min_transitions=7).select(F.lit(method).alias("method"), "feature", "sample", "value", "n_transitions") for method in ("sum", "consensus", "quality_weighted")]
    return rounded(reduce(DataFrame.unionByName, made))


def _fit_sql(method: str, rounds: int = 5) -> str:
    """The trimmed fit as CTEs, one per round; at the end scale, R2 and verdict of each precursor and sample."""
    polish = method == "median_polish"
    ctes = dict(
        l="SELECT feature, transition, avg(area) AS e FROM cells GROUP BY ALL",
        t="SELECT feature, sum(e) AS total, count(*) FILTER (e > 0) AS ok FROM l GROUP BY ALL",
        g="SELECT k.feature, k.transition, s.sample, l.e, coalesce(c.area, 0.0) AS o FROM (SELECT DISTINCT feature, transition FROM cells) k JOIN (SELECT DISTINCT feature, sample FROM cells) s ON s.feature = k.feature JOIN l ON l.feature = k.feature AND l.transition = k.transition LEFT JOIN cells c ON c.feature = k.feature AND c.transition = k.transition AND c.sample = s.sample",
        s0=f"SELECT *, e > 0{' AND o > 0' if polish else ''} AS u FROM g")
    scale = "exp(median(ln(o) - ln(e)) FILTER (u))" if polish else "greatest(coalesce(sum(o * e) FILTER (u) / sum(e * e) FILTER (u), 0.0), 0.0)"
    for i in range(rounds + 1):
        ctes[f"f{i}"] = f"SELECT feature, sample, {scale} AS scale, count(*) FILTER (u) AS n FROM s{i} GROUP BY ALL"
        if i < rounds:
            ctes[f"s{i + 1}"] = f"SELECT feature, transition, sample, e, o, u AND NOT (rk = 1 AND ex > 1.0 AND n > 3) AS u FROM (SELECT *, row_number() OVER (PARTITION BY feature, sample ORDER BY ex DESC, CAST(transition AS VARCHAR)) AS rk FROM (SELECT s{i}.*, f{i}.n, CASE WHEN u AND e * scale > 0 THEN (o - e * scale) / (e * scale) ELSE -1e300 END AS ex FROM s{i} JOIN f{i} ON f{i}.feature = s{i}.feature AND f{i}.sample = s{i}.sample))"
    z = f"s{rounds}"
    ctes["r"] = f"SELECT z.feature, z.sample, max(scale) AS scale, max(n) AS n, coalesce(sum((o - e * scale) * (o - e * scale)) FILTER (u), 0.0) AS rest, coalesce(var_pop(o) FILTER (u) * count(*) FILTER (u), 0.0) AS total, sum(o) AS seen, sum(greatest(o, 0.0)) AS plain FROM {z} z JOIN f{rounds} f ON f.feature = z.feature AND f.sample = z.sample GROUP BY ALL"
    bare = "n < 3" if polish else "n < 3 AND seen > 0"
    ctes["w"] = f"SELECT r.*, t.ok, t.total AS lib, CASE WHEN t.ok < 3 OR {bare} THEN NULL WHEN r.total > 1e-9 THEN 1 - rest / r.total ELSE 0.0 END AS r2 FROM r JOIN t ON t.feature = r.feature"
    return with_ctes(f"SELECT CAST(feature AS VARCHAR) AS key, sample, round(CASE WHEN ok < 3 THEN CASE WHEN plain > 0 THEN log2(plain) END WHEN NOT ({bare}) AND scale * lib > 0 THEN log2(scale * lib) END, 5) AS value, round(r2, 4) AS r2, CASE WHEN ok < 3 THEN 0 ELSE n END AS n_used, CASE WHEN r2 IS NULL THEN NULL WHEN r2 < 0.5 THEN 'poor_fit' WHEN ok - n > ok // 2 THEN 'many_outliers' END AS warning FROM w", "cells", **ctes)


def _observed(spark, sf):
    """(key, ion, sample, area, expected, total): the report against the mean profile of its features as a library."""
    c = b.cells(spark, sf).select(F.col("feature").cast("string").alias("key"), F.col("transition").cast("string").alias("ion"), "sample", "area")
    library = c.groupBy("key", "ion").agg(F.avg("area").alias("expected"))
    total = library.groupBy("key").agg(F.sum("expected").alias("total"))
    return c.join(library, ["key", "ion"]).join(total, "key")


def _fitted(spark, sf, method):
    f = lib.library_rollup(_observed(spark, sf), method)
    return f.select("key", "sample", F.round("value", 5).alias("value"), F.round("r2", 4).alias("r2"), F.col("n_used").cast("long").alias("n_used"), "warning")


@query(_fit_sql("median_polish"))
def lib_rollup(spark, sf):
    """LIB-04, LIB-06, LIB-09, RUP-11: trimmed median fits with their verdicts."""
    return _fitted(spark, sf, "median_polish")


@query(_fit_sql("least_squares"))
def lib_rollup_least_squares(spark, sf):
    """LIB-05, LIB-06."""
    return _fitted(spark, sf, "least_squares")


@query(with_ctes("SELECT feature, sample, round(log2(sum(pow(2.0, value))), 6) AS value FROM (SELECT feature % 100 AS feature, sample, log2(area) AS value FROM cells WHERE area > 0) GROUP BY ALL", "cells"))
def lib_sum_charges(spark, sf):
    """RUP-11: charge states summed on the linear scale."""
    c = b.cells(spark, sf).where("area > 0").select("feature", "sample", F.log2("area").alias("value"))
    return rounded(lib.sum_charges(c, F.col("feature") % 100))


@query("SELECT p_partkey AS feature, concat(replace(upper(p_name), 'L', 'I'), '_', p_size) AS collapsed, concat(regexp_replace(regexp_replace(upper(p_name) || '[+16]', '\\[[^\\]]*\\]', '', 'g'), '[^A-Z]', '', 'g'), '_', p_size) AS stripped FROM part")
def lib_keys(spark, sf):
    """LIB-01."""
    p, up = table(spark, sf, "part"), F.upper("p_name")
    return p.select(F.col("p_partkey").alias("feature"), lib.library_key(up, F.col("p_size"), collapse=True).alias("collapsed"), lib.stripped_key(F.concat(up, F.lit("[+16]")), F.col("p_size")).alias("stripped"))


@query("SELECT l, CASE WHEN m THEN substr(l, 1, 1) END AS kind, CASE WHEN m THEN CAST(regexp_extract(l, '^[abcxyz](\\d+)', 1) AS BIGINT) END AS number, CASE WHEN m THEN CASE WHEN contains(l, '^') THEN CAST(regexp_extract(l, '\\^(\\d+)', 1) AS BIGINT) WHEN contains(l, '+') THEN length(l) - length(replace(l, '+', '')) ELSE 1 END END AS charge, CASE WHEN m AND contains(l, '-') THEN split_part(l, '-', 2) END AS loss FROM (SELECT *, regexp_matches(l, '^[abcxyz]\\d+') AS m FROM (SELECT DISTINCT concat(substr('abcxyzp', CAST(l_linenumber AS BIGINT), 1), l_suppkey % 30, CASE l_partkey % 4 WHEN 0 THEN '^2' WHEN 1 THEN '++' ELSE '' END, CASE l_orderkey % 3 WHEN 0 THEN '-H2O' ELSE '' END) AS l FROM lineitem))")
def lib_parse_ion(spark, sf):
    """LIB-02: series, number, charge by caret or plus signs, neutral loss."""
    mark = F.when(F.col("l_partkey") % 4 == 0, "^2").when(F.col("l_partkey") % 4 == 1, "++").otherwise("")
    l = table(spark, sf, "lineitem").select(F.concat(F.expr("substring('abcxyzp', l_linenumber, 1)"), F.col("l_suppkey") % 30, mark, F.when(F.col("l_orderkey") % 3 == 0, "-H2O").otherwise("")).alias("l")).distinct()
    ion = lib.parse_ion(F.col("l"))
    return l.select("l", ion["kind"].alias("kind"), ion["number"].cast("long").alias("number"), ion["charge"].cast("long").alias("charge"), ion["loss"].alias("loss"))


MATCH = dict(
    lb="SELECT DISTINCT concat('k', s_nationkey) AS key, concat('i', s_suppkey % 9) AS ion, s_acctbal AS lib_mz, CAST(s_suppkey AS DOUBLE) AS intensity FROM supplier",
    ob="SELECT DISTINCT concat('k', c_nationkey) AS key, concat('i', c_custkey % 11) AS ion, c_acctbal AS mz FROM customer",
    ex="SELECT key, ion, max(intensity) AS intensity FROM lb GROUP BY ALL",
    nr="SELECT ob.key, ob.ion, ob.mz, arg_min(lb.intensity, printf('%020.8f%020.8f', abs(ob.mz - lb.lib_mz), lb.lib_mz + 1e6)) AS intensity FROM ob JOIN lb ON lb.key = ob.key AND abs(ob.mz - lb.lib_mz) <= 60 GROUP BY ALL",
    mt="SELECT ob.*, coalesce(ex.intensity, nr.intensity) AS expected FROM ob LEFT JOIN ex ON ex.key = ob.key AND ex.ion = ob.ion LEFT JOIN nr ON nr.key = ob.key AND nr.ion = ob.ion AND nr.mz = ob.mz",
)


def _matches(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    library = s.select(F.concat(F.lit("k"), "s_nationkey").alias("key"), F.concat(F.lit("i"), F.col("s_suppkey") % 9).alias("ion"), F.col("s_acctbal").alias("mz"), F.col("s_suppkey").cast("double").alias("intensity"))
    observed = c.select(F.concat(F.lit("k"), "c_nationkey").alias("key"), F.concat(F.lit("i"), F.col("c_custkey") % 11).alias("ion"), F.col("c_acctbal").alias("mz")).distinct()
    return lib.match_fragments(observed, library, 60.0)


@query(with_ctes("SELECT key, ion, mz, expected FROM mt", **MATCH))
def lib_match(spark, sf):
    """LIB-03, JN-12, JN-15: the same ion, else the nearest m/z."""
    return _matches(spark, sf).select("key", "ion", "mz", "expected")


@query(with_ctes("SELECT count(*) AS keys, CAST(sum(CAST(h > 0 AS BIGINT)) AS BIGINT) AS matched, round(sum(h) / sum(n), 6) AS share FROM (SELECT key, count(DISTINCT ion) AS n, count(DISTINCT CASE WHEN expected > 0 THEN ion END) AS h FROM mt GROUP BY ALL)", **MATCH))
def lib_match_statistics(spark, sf):
    """LIB-10."""
    return rounded(lib.match_statistics(_matches(spark, sf)))


@query("SELECT p_partkey AS k, coalesce(a.v, b.v, c.v) AS v FROM part LEFT JOIN (SELECT p_name AS n, min(p_partkey) AS v FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL) a ON a.n = p_name LEFT JOIN (SELECT replace(upper(p_name), 'I', 'L') AS n, min(p_partkey) AS v FROM part WHERE p_partkey % 5 = 1 GROUP BY ALL) b ON b.n = replace(upper(p_name), 'I', 'L') LEFT JOIN (SELECT p_type AS n, min(p_partkey) AS v FROM part GROUP BY ALL) c ON c.n = p_type")
def jn_keyed_fallback(spark, sf):
    """JN-14: exact, then normalised, then a coarser key."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type")
    look = lambda d, c: d.select(c.alias("n"), F.col("k").alias("v"))
    plain = F.translate(F.upper("p_name"), "I", "L")
    tables = [(look(p.where("k % 5 = 0"), F.col("p_name")), F.col("p_name"), "n"), (look(p.where("k % 5 = 1"), plain), plain, "n"), (look(p, F.col("p_type")), F.col("p_type"), "n")]
    return joins.keyed_fallback(p, tables, "v").select("k", "v")


@query(with_ctes(
    "SELECT a.sample AS s, b.sample AS t, round(sum(a.y * b.y), 2) AS g FROM y a JOIN y b ON a.feature = b.feature GROUP BY ALL", "v",
    h="SELECT feature, sample, x FROM v WHERE CAST(substr(sample, 2) AS INT) >= feature % 11",
    k="SELECT k.feature, s.sample, coalesce(h.x, k.mid) AS x FROM (SELECT feature, median(x) AS mid FROM h GROUP BY feature HAVING count(*) >= 0.5 * (SELECT count(DISTINCT sample) FROM h)) k CROSS JOIN (SELECT DISTINCT sample FROM h) s LEFT JOIN h ON h.feature = k.feature AND h.sample = s.sample",
    y="SELECT feature, sample, x - avg(x) OVER (PARTITION BY feature) AS y FROM k"))
def qc_gram(spark, sf):
    """QC-04: the distributed part of the components; the rest is the eigenvectors of samples x samples."""
    names, g = qc.gram(qc.filled(b.values(spark, sf).where("CAST(substr(sample, 2) AS INT) >= feature % 11").select("feature", "sample", "x")))
    return spark.createDataFrame([(s, t, round(float(g[i, j]), 2)) for i, s in enumerate(names) for j, t in enumerate(names)], "s string, t string, g double")


@query(with_ctes(
    "SELECT i, round(sum(n * exp(-z * z / 2)) / (max(h.n_all) * max(h.h) * sqrt(2 * pi())), 6) AS density, round(max(h.lo) + (i + 0.5) * max(h.step), 6) AS at FROM (SELECT c.n, t.i, (t.i - c.b) * h.step / h.h AS z FROM c, h, range(0, 512) t(i) WHERE abs(t.i - c.b) <= ceil(4 * h.h / h.step)) q, h GROUP BY i", "v",
    s="SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34 AS iq, count(x) AS n_all FROM v",
    b="SELECT *, 0.9 * least(sd, iq) * pow(n_all, -0.2) AS h FROM s",
    h="SELECT n_all, h, lo - 3 * h AS lo, (hi - lo + 6 * h) / 512 AS step FROM b",
    c="SELECT CAST(floor((x - h.lo) / h.step) AS BIGINT) AS b, count(*) AS n FROM v, h GROUP BY ALL"))
def qc_density_curve(spark, sf):
    """QC-10."""
    return rounded(qc.density_curve(b.values(spark, sf)))


STAGE = "SELECT '{0}' AS stage, sample_type, round(median(cv), 6) AS median_cv, count(cv) AS n_features, (SELECT round(quantile_cont({1}, 0.25), 6) FROM w) AS q1, (SELECT round(median({1}), 6) FROM w) AS median, (SELECT round(quantile_cont({1}, 0.75), 6) FROM w) AS q3 FROM (SELECT sample_type, feature, stddev_samp(pow(2.0, {1})) / avg(pow(2.0, {1})) AS cv FROM w GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL"


@query(with_ctes(" UNION ALL ".join(STAGE.format(n, c) for n, c in (("raw", "x"), ("normalised", "y"), ("centred", "z"))), "v", med="SELECT sample, median(x) AS med FROM v GROUP BY sample", w="SELECT v.feature, v.sample, sample_type, x, x - (med - (SELECT median(med) FROM med)) AS y, x - med AS z FROM v JOIN med ON med.sample = v.sample"))
def qc_stages(spark, sf):
    """QC-08: three stages side by side."""
    v = Scratch(spark, "raw").table(b.values(spark, sf).select("feature", "sample", "sample_type", "x"), "values")
    centred = v.join(nrm.sample_medians(v), "sample").withColumn("x", F.col("x") - F.col("med"))
    return rounded(qc.stages({"raw": v, "normalised": nrm.median_normalize(v), "centred": centred}))


@query(with_ctes("SELECT feature, sample, round(x, 6) AS x FROM v WHERE feature IN (3, 17, 999, 1500)", "v"))
def qc_lookup(spark, sf):
    """QC-16: a lookup by ids is the feature here."""
    names = [f"S{i:02d}" for i in range(12)]
    return rounded(qc.lookup(qc.wide(b.values(spark, sf), names), names, [3, 17, 999, 1500]).where("x IS NOT NULL"))


CRITERIA = {"most_improved": "cv_a - cv_b", "most_worsened": "cv_b - cv_a", "highest_cv": "greatest(cv_a, cv_b)", "largest_difference": "abs(cv_a - cv_b)"}


@query(with_ctes(
    " UNION ALL ".join(f"(SELECT '{n}' AS criterion, feature, round({e}, 6) AS score FROM pairs ORDER BY round({e}, 9) DESC, feature LIMIT 15)" for n, e in CRITERIA.items()), "v",
    med="SELECT sample, median(x) AS med FROM v GROUP BY sample",
    w="SELECT feature, v.sample, sample_type, x AS xa, x - (med - (SELECT median(med) FROM med)) AS xb FROM v JOIN med ON med.sample = v.sample",
    pairs="SELECT feature, round(stddev_samp(pow(2.0, xa)) / avg(pow(2.0, xa)), 9) AS cv_a, round(stddev_samp(pow(2.0, xb)) / avg(pow(2.0, xb)), 9) AS cv_b FROM w WHERE sample_type = 'qc' GROUP BY ALL HAVING count(*) >= 2"))
def cmp_criteria(spark, sf):
    """CMP-02, CMP-03, CMP-06: top-k reports by every criterion; the limit is the feature."""
    v = b.values(spark, sf)
    pairs = cmp.compare_cvs(v, nrm.median_normalize(v), "qc").withColumns({c: F.round(c, 9) for c in ("cv_a", "cv_b")})
    parts = [cmp.top(pairs, n, 15, digits=9).select(F.lit(n).alias("criterion"), "feature", F.round("score", 6).alias("score")) for n in CRITERIA]
    return reduce(DataFrame.unionByName, parts)


@query(with_ctes("SELECT feature, sample, round(x, 6) AS x FROM v", "v"))
def nrm_none(spark, sf):
    """NRM-07, NRM-11."""
    return rounded(nrm.normalize(b.values(spark, sf), "none").select("feature", "sample", "x"))


@query(with_ctes("SELECT v.feature, v.sample, round(v.x - (med.med - (SELECT median(med) FROM med)), 6) AS x FROM v JOIN med USING (sample)", "v", med="SELECT sample, median(x) AS med FROM v GROUP BY sample"))
def nrm_unknown(spark, sf):
    """NRM-07: an unknown name falls back to the median."""
    return rounded(nrm.normalize(b.values(spark, sf), "of no known kind").select("feature", "sample", "x"))
