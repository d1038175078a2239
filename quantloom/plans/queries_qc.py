"""Queries over quality metrics, density, comparison, sorts and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import compare as cmp
from quantloom.operators import density as den
from quantloom.operators import normalize as nrm
from quantloom.operators import qc
from quantloom.runtime import table
from quantloom.scratch import Scratch
from quantloom.streaming import ingest

from . import binding as b
from .binding import with_ctes
from .queries_rollup import rounded

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


CV = "SELECT sample_type, feature, stddev_samp(pow(2.0, x)) / avg(pow(2.0, x)) AS cv FROM v GROUP BY ALL HAVING count(x) >= 2"


@query(with_ctes("SELECT sample_type, round(median(cv), 6) AS median_cv, count(cv) AS n_features FROM c GROUP BY ALL", "v", c=CV))
def qc_median_cv(spark, sf):
    return rounded(qc.median_cvs(b.values(spark, sf)))


@query(with_ctes("SELECT sample_type, round(median(cv), 6) AS median, round(avg(cv), 6) AS mean, round(avg(CAST(cv < 0.2 AS DOUBLE)), 6) AS under_limit, round(avg(CAST(cv < 0.1 AS DOUBLE)), 6) AS under_tenth FROM c GROUP BY ALL", "v", c=CV))
def qc_cv_summary(spark, sf):
    return rounded(qc.cv_summary(qc.feature_cvs(b.values(spark, sf))))


@query(with_ctes("SELECT sample_type, CAST(least(floor(round(cv, 9) / 0.04), 49) AS BIGINT) AS bin, count(*) AS n FROM c WHERE round(cv, 9) BETWEEN 0.0 AND 2.0 GROUP BY ALL", "v", c=CV))
def qc_cv_histogram(spark, sf):
    return rounded(qc.histogram(qc.feature_cvs(b.values(spark, sf)).withColumn("cv", F.round("cv", 9)), "sample_type", "cv", 50, 0.0, 2.0))


@query(with_ctes("SELECT a.sample AS s, b.sample AS t, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM v a JOIN v b ON a.feature = b.feature GROUP BY ALL", "v"))
def qc_correlation(spark, sf):
    return rounded(qc.correlations(b.values(spark, sf)))


@query(with_ctes(
    "SELECT a.sample AS s, b.sample AS t, round(corr(a.k, b.k), 6) AS r, count(*) AS n FROM k a JOIN k b ON a.feature = b.feature GROUP BY ALL", "v",
    w="SELECT feature, sample, round(x, 9) AS x FROM v",
    k="SELECT feature, sample, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2 AS k FROM w"))
def qc_correlation_spearman(spark, sf):
    return rounded(qc.correlations(b.values(spark, sf).withColumn("x", F.round("x", 9)), "spearman"))


def _component(source: str, name: str) -> dict[str, str]:
    """CTE ``name`` (v, l): leading eigenvector and value of the matrix in ``source`` (m), by squaring it 40 times."""
    trace = "list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))"
    scaled = "list_transform({m}, lambda r: list_transform(r, lambda x: x / {t}))"
    square = "list_transform(a, lambda r: list_transform(a, lambda q: list_dot_product(r, q)))"
    pick = "list_position(list_transform(range(1, len(a) + 1), lambda i: a[i][i]), list_max(list_transform(range(1, len(a) + 1), lambda i: a[i][i])))"
    return {
        f"{name}_p(k, a)": f"SELECT 0, {scaled.format(m='m', t=trace.format(m='m'))} FROM {source} UNION ALL SELECT k + 1, {scaled.format(m='b', t=trace.format(m='b'))} FROM (SELECT k, {square} AS b FROM {name}_p WHERE k < 40)",
        f"{name}_v": f"SELECT list_transform(a[j], lambda x: x / sqrt(a[j][j])) AS v FROM (SELECT a, {pick} AS j FROM {name}_p WHERE k = 40)",
        name: f"SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {name}_v, {source}",
    }


def _scores(source: str, name: str) -> dict[str, str]:
    """CTE ``name`` (sample, pc1, pc2, share1, share2): sizes of the scores on the first two components of (feature, sample, x)."""
    n = name
    return {
        f"{n}_c": f"SELECT feature, sample, x - avg(x) OVER (PARTITION BY feature) AS x FROM {source}",
        f"{n}_r": f"SELECT s, list(g ORDER BY t) AS r FROM (SELECT a.sample AS s, b.sample AS t, sum(a.x * b.x) AS g FROM {n}_c a JOIN {n}_c b ON a.feature = b.feature GROUP BY ALL) GROUP BY s",
        f"{n}_m": f"SELECT list(r ORDER BY s) AS m, list(s ORDER BY s) AS names FROM {n}_r",
        **_component(f"{n}_m", f"{n}_1"),
        f"{n}_d": f"SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM {n}_m, {n}_1",
        **_component(f"{n}_d", f"{n}_2"),
        n: f"SELECT unnest(names) AS sample, unnest(list_transform(a.v, lambda x: x * sqrt(a.l))) AS pc1, unnest(list_transform(b.v, lambda x: x * sqrt(b.l))) AS pc2, a.l / list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS share1, b.l / list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS share2 FROM {n}_m, {n}_1 a, {n}_2 b",
    }


@query(with_ctes("SELECT sample, round(abs(pc1), 4) AS pc1, round(abs(pc2), 4) AS pc2, round(share1, 4) AS share1, round(share2, 4) AS share2 FROM z", "v", recursive=True, **_scores("v", "z")))
def qc_pca(spark, sf):
    p = qc.pca(b.values(spark, sf))
    return rounded(p.withColumns({c: F.abs(c) for c in ("pc1", "pc2")}), digits=4)


def _distance(name: str) -> str:
    mean = lambda c, k: f"(SELECT avg({c}) FROM {name} JOIN samples USING (sample) WHERE sample_type = '{k}')"
    return f"sqrt(pow({mean('pc1', 'reference')} - {mean('pc1', 'qc')}, 2) + pow({mean('pc2', 'reference')} - {mean('pc2', 'qc')}, 2))"


@query(with_ctes(
    f"SELECT round(rb, 6) AS reference_before, round(ra, 6) AS reference_after, round(qb, 6) AS qc_before, round(qa, 6) AS qc_after, round({_distance('zb')}, 4) AS distance_before, round({_distance('za')}, 4) AS distance_after, (qb - qa) / qb > 0 AS qc_improved, {_distance('za')} / {_distance('zb')} > 0.5 AS distance_kept, NOT coalesce(CASE WHEN (rb - ra) / rb > 0 THEN ((rb - ra) / rb) / nullif((qb - qa) / qb, 0) END >= 2, false) AS not_overfitted FROM cv", "v", recursive=True,
    me="SELECT sample, median(x) AS med FROM v GROUP BY sample",
    w="SELECT feature, v.sample, sample_type, x - (med - (SELECT median(med) FROM me)) AS x FROM v JOIN me ON me.sample = v.sample",
    pb="SELECT sample_type AS k, feature, stddev_samp(pow(2.0, x)) / avg(pow(2.0, x)) AS c FROM v GROUP BY ALL HAVING count(*) >= 2",
    pa="SELECT sample_type AS k, feature, stddev_samp(pow(2.0, x)) / avg(pow(2.0, x)) AS c FROM w GROUP BY ALL HAVING count(*) >= 2",
    cv="SELECT (SELECT median(c) FROM pb WHERE k = 'reference') AS rb, (SELECT median(c) FROM pa WHERE k = 'reference') AS ra, (SELECT median(c) FROM pb WHERE k = 'qc') AS qb, (SELECT median(c) FROM pa WHERE k = 'qc') AS qa",
    vt="SELECT feature, sample, x FROM v WHERE sample_type IN ('reference', 'qc')", wt="SELECT feature, sample, x FROM w WHERE sample_type IN ('reference', 'qc')",
    **_scores("vt", "zb"), **_scores("wt", "za")))
def qc_validate(spark, sf):
    """QC-02, QC-03: the verdict on a median normalisation, with the distance of the sample types' centroids."""
    before = Scratch(spark, "validate").table(b.values(spark, sf), "before")
    after = Scratch(spark, "validate").table(nrm.median_normalize(before), "after")
    got = qc.validate(before, after)
    types = {r["sample"]: r["sample_type"] for r in before.select("sample", "sample_type").distinct().collect()}
    ref, quality = ([s for s, k in types.items() if k == kind] for kind in ("reference", "qc"))
    near = [qc.centroid_distance(d, ref, quality) for d in (before, after)]
    cv = [got[f"cv_{when}"].get(kind) for kind in ("reference", "qc") for when in ("before", "after")]
    row = (*(round(v, 6) for v in cv), *(round(v, 4) for v in near), *(bool(got[k]) for k in ("qc_improved", "distance_kept", "not_overfitted")))
    return spark.createDataFrame([row], "reference_before double, reference_after double, qc_before double, qc_after double, distance_before double, distance_after double, qc_improved boolean, distance_kept boolean, not_overfitted boolean")


@query()
def qc_cluster_order(spark, sf):
    pairs = [(r["s"], r["t"], r["r"]) for r in qc.correlations(b.values(spark, sf)).collect()]
    return spark.createDataFrame([(i, s) for i, s in enumerate(qc.cluster_order(pairs))], "position int, sample string")


@query(with_ctes("SELECT sample, count(x) AS n, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high FROM v GROUP BY ALL", "v"))
def qc_five_numbers(spark, sf):
    return rounded(qc.five_numbers(b.values(spark, sf)))


RT = "CAST(coalesce(least(floor((rt - (SELECT min(rt) FROM v)) / nullif(((SELECT max(rt) FROM v) - (SELECT min(rt) FROM v)) / {n}, 0)), {m}), 0) AS BIGINT)"


@query(with_ctes(
    "SELECT sample_type, bin, round(median(cv), 6) AS median_cv, count(*) AS n FROM c GROUP BY ALL", "v",
    c=f"SELECT sample_type, {RT.format(n=8, m=7)} AS bin, feature, stddev_samp(pow(2.0, x)) / avg(pow(2.0, x)) AS cv FROM v GROUP BY ALL HAVING count(x) >= 2"))
def qc_rt_bin_cv(spark, sf):
    return rounded(qc.rt_bin_cvs(b.values(spark, sf)))


@query(with_ctes(f"SELECT batch, {RT.format(n=8, m=7)} AS bin, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3 FROM v GROUP BY ALL HAVING count(x) >= 6", "v"))
def qc_rt_bin_boxes(spark, sf):
    return rounded(qc.rt_bin_boxes(b.values(spark, sf)))


@query(with_ctes(
    "SELECT v.sample, CAST(least(floor((rt - (SELECT min(rt) FROM v)) / (((SELECT max(rt) FROM v) - (SELECT min(rt) FROM v)) / 50)), 49) AS BIGINT) AS bin, round(median(x - m), 6) AS residual, count(*) AS n FROM v JOIN r ON r.feature = v.feature GROUP BY ALL", "v",
    r="SELECT feature, avg(x) AS m FROM v WHERE sample_type = 'reference' GROUP BY ALL"))
def qc_rt_residuals(spark, sf):
    v = b.values(spark, sf)
    refs = [r[0] for r in b.samples(spark, sf).where("sample_type = 'reference'").select("sample").orderBy("sample").collect()]
    return rounded(qc.rt_residual_bins(v, nrm.reference_statistics(v, refs)))


@query(with_ctes("SELECT feature, " + ", ".join(f"round(max(x) FILTER (sample = 'S{i:02d}'), 6) AS S{i:02d}" for i in range(12)) + " FROM v GROUP BY ALL", "v"))
def qc_wide(spark, sf):
    """SNK-01, QC-15: one column for each run; the list is known, so no job looks for it."""
    return rounded(qc.wide(b.values(spark, sf), [f"S{i:02d}" for i in range(12)]))


@query(with_ctes("SELECT feature, sample, round(x, 6) AS x FROM v", "v"))
def qc_long(spark, sf):
    names = [f"S{i:02d}" for i in range(12)]
    return rounded(qc.long(qc.wide(b.values(spark, sf), names), names).where("x IS NOT NULL"))


@query(with_ctes("SELECT entity, round(median(x), 6) AS median FROM v GROUP BY ALL ORDER BY median DESC NULLS LAST, entity", "v"))
def qc_entities_by_median(spark, sf):
    return rounded(qc.entities_by_median(b.values(spark, sf)))


@query(with_ctes("SELECT count(DISTINCT feature) AS features, count(area) AS seen, count(DISTINCT feature) * 12 - count(area) AS missing, round(count(area) / (count(DISTINCT feature) * 12.0), 6) AS share FROM (SELECT feature, sample, max(area) AS area FROM cells GROUP BY ALL)", "cells"))
def qc_missing_cells(spark, sf):
    c = b.cells(spark, sf).groupBy("feature", "sample").agg(F.max("area").alias("x"))
    return rounded(qc.missing_cells(c, [f"S{i:02d}" for i in range(12)]))


@query(with_ctes("SELECT entity, mean, log10, rank FROM (SELECT entity, round(mean, 1) AS mean, round(log10(mean), 6) AS log10, row_number() OVER (ORDER BY mean DESC, entity) AS rank FROM (SELECT entity, avg(pow(2.0, x)) AS mean FROM v GROUP BY ALL))", "v"))
def den_dynamic_range(spark, sf):
    d = den.dynamic_range(b.values(spark, sf).withColumn("value", F.pow(F.lit(2.0), F.col("x"))))
    return d.select("entity", F.round("mean", 1).alias("mean"), F.round("log10", 6).alias("log10"), F.col("rank").cast("long").alias("rank"))


@query("WITH t AS (SELECT DISTINCT p_name AS entry, upper(p_name) AS t FROM part), l AS (SELECT upper(s_name) AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS list, s_suppkey % 2 AS priority FROM supplier UNION ALL SELECT DISTINCT upper(p_name), p_brand, p_size FROM part WHERE p_size < 10) SELECT t.entry, arg_min(l.list, printf('%05d%s', l.priority, l.list)) AS list FROM t JOIN l ON l.t = t.t OR l.t = regexp_replace(t.t, '-\\d+$', '') OR l.t = regexp_replace(t.t, '_[A-Z0-9]+$', '') GROUP BY ALL")
def den_protein_lists(spark, sf):
    s = table(spark, sf, "supplier")
    p = table(spark, sf, "part")
    lists = s.select(F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("list"), (F.col("s_suppkey") % 2).cast("int").alias("priority"), F.col("s_name").alias("member"))
    lists = lists.union(p.where("p_size < 10").select(F.col("p_brand"), F.col("p_size").cast("int"), "p_name"))
    return den.match_lists(p.select(F.col("p_name").alias("entry")).distinct(), lists)


PRE = "SELECT feature, charge, mz, min(start) AS start, max(stop) AS stop FROM peaks WHERE stop >= start GROUP BY ALL"


@query(with_ctes("SELECT feature, charge, mz, start, stop FROM p", "peaks", p=PRE))
def den_precursors(spark, sf):
    return rounded(den.precursors(b.peaks(spark, sf)))


@query(with_ctes(
    "SELECT CAST(greatest(least(floor((mz - q.m0) / 2.0), floor((q.m1 - q.m0) / 2.0)), 0) AS BIGINT) AS mz_bin, r AS rt_bin, count(*) AS n FROM p, q, range(0, 4000) t(r) WHERE r BETWEEN greatest(least(floor((start - q.t0) / 0.1), floor((q.t1 - q.t0) / 0.1)), 0) AND greatest(least(floor((stop - q.t0) / 0.1), floor((q.t1 - q.t0) / 0.1)), 0) GROUP BY ALL", "peaks", p=PRE,
    q="SELECT min(mz) AS m0, max(mz) AS m1, min(start) AS t0, max(stop) AS t1 FROM p"))
def den_uniform(spark, sf):
    return rounded(den.uniform_density(den.precursors(b.peaks(spark, sf))))


SCHEME = "SELECT CAST(i AS BIGINT) AS window, 400.4319 + i * 3.001365 AS lo, 400.4319 + i * 3.001365 + 3.001364 AS hi FROM range(0, 167) t(i)"
SCHEME = SCHEME.replace("400.4319", "CAST(400.4319 AS DOUBLE)").replace("3.001365", "CAST(3.001365 AS DOUBLE)").replace("3.001364", "CAST(3.001364 AS DOUBLE)")


@query(with_ctes(
    "SELECT w.window, r AS rt_bin, count(*) AS n FROM p JOIN w ON p.mz >= w.lo AND p.mz < w.hi, q, range(0, 4000) t(r) WHERE r BETWEEN greatest(least(floor((start - q.t0) / 0.1), floor((q.t1 - q.t0) / 0.1)), 0) AND greatest(least(floor((stop - q.t0) / 0.1), floor((q.t1 - q.t0) / 0.1)), 0) GROUP BY ALL", "peaks", p=PRE, w=SCHEME,
    q="SELECT min(start) AS t0, max(stop) AS t1 FROM p"))
def den_scheme(spark, sf):
    return rounded(den.scheme_density(den.precursors(b.peaks(spark, sf)), den.default_scheme(spark)))


@query(with_ctes("SELECT (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM w WHERE p.mz >= w.lo AND p.mz < w.hi)) AS covered, round((SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM w WHERE p.mz >= w.lo AND p.mz < w.hi)) / (SELECT count(*) FROM p), 6) AS share", "peaks", p=PRE, w=SCHEME))
def den_coverage(spark, sf):
    return rounded(den.coverage(den.precursors(b.peaks(spark, sf)), den.default_scheme(spark)))


@query("SELECT CAST(i AS BIGINT) AS row, arg_min(w.p_partkey, w.p_size + w.p_partkey / 1e6) AS window FROM range(0, 4000) t(i) JOIN part w ON (i + 0.5) * 0.5 >= w.p_retailprice AND (i + 0.5) * 0.5 < w.p_retailprice + w.p_size + w.p_partkey / 1e6 GROUP BY ALL")
def den_display_grid(spark, sf):
    """DEN-07: the narrowest window at each row of a display, for a scheme as large as the table of parts."""
    width = F.col("p_size") + F.col("p_partkey") / 1e6
    scheme = table(spark, sf, "part").select(F.col("p_partkey").alias("window"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + width).alias("hi"))
    return rounded(den.display_grid(scheme, 4000, 0.0, 2000.0))


DENS = "SELECT user_id % 40 AS window, CAST(floor(value / 10) AS BIGINT) AS rt_bin, count(*) AS n FROM events GROUP BY ALL"


@query(f"WITH d AS ({DENS}) SELECT n AS load, count(*) AS cells FROM d GROUP BY ALL UNION ALL SELECT 0, 40 * 2000 - count(*) FROM d HAVING 40 * 2000 - count(*) > 0")
def den_load_histogram(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("window"), F.floor(F.col("value") / 10).alias("rt_bin")).agg(F.count("*").alias("n"))
    return den.load_histogram(e, 40, 2000)


@query(f"WITH d AS ({DENS}) SELECT rt_bin, round(sum(n) / 40.0, 6) AS mean, CASE WHEN count(*) < 40 THEN 0 ELSE min(n) END AS low, max(n) AS high FROM d GROUP BY ALL")
def den_load_over_time(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("window"), F.floor(F.col("value") / 10).alias("rt_bin")).agg(F.count("*").alias("n"))
    return rounded(den.load_over_time(e, 40))


CMP = dict(
    w="SELECT feature, sample, sample_type, x AS xa, x - (med - (SELECT median(med) FROM med)) AS xb FROM v JOIN med USING (sample)",
    pairs="SELECT feature, stddev_samp(pow(2.0, xa)) / avg(pow(2.0, xa)) AS cv_a, stddev_samp(pow(2.0, xb)) / avg(pow(2.0, xb)) AS cv_b FROM w WHERE sample_type = 'qc' GROUP BY ALL HAVING count(*) >= 2",
)
MED = "SELECT sample, median(x) AS med FROM v GROUP BY sample"


def _pairs(spark, sf):
    v = b.values(spark, sf)
    return cmp.compare_cvs(v, nrm.median_normalize(v), "qc")


@query(with_ctes("SELECT feature, round(cv_a, 6) AS cv_a, round(cv_b, 6) AS cv_b, round(cv_b - cv_a, 6) AS difference FROM pairs", "v", med=MED, **CMP))
def cmp_pairs(spark, sf):
    return rounded(_pairs(spark, sf))


@query(with_ctes("SELECT feature, round(cv_a, 6) AS cv_a, round(cv_b, 6) AS cv_b, round(cv_a - cv_b, 6) AS score FROM pairs ORDER BY cv_a - cv_b DESC, feature LIMIT 20", "v", med=MED, **CMP))
def cmp_top_improved(spark, sf):
    """A top-k report; the limit is the feature."""
    return rounded(cmp.top(_pairs(spark, sf), "most_improved", 20).drop("difference"))


@query(with_ctes("SELECT count(*) AS features, count(*) FILTER (cv_b - cv_a < -0.01) AS improved, count(*) FILTER (cv_b - cv_a > 0.01) AS worsened, count(*) FILTER (abs(cv_b - cv_a) <= 0.01) AS unchanged, round(median(cv_a), 6) AS median_a, round(median(cv_b), 6) AS median_b FROM pairs", "v", med=MED, **CMP))
def cmp_summary(spark, sf):
    return rounded(cmp.summary(_pairs(spark, sf)))


@query("SELECT user_id, event_type, ts, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events")
def win_running(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select("user_id", "event_type", "ts", "value", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.row_number().over(w).cast("long").alias("k"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid")
def str_sessions(spark, sf):
    """Session windows over events; the same plan runs on a stream (streaming.ingest)."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = ingest.sessions(e)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_windowed_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
