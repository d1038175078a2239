"""Queries over sources, sinks, names and metadata: files are written from the given tables and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom import pipeline
from quantloom.functions import columns as names
from quantloom.operators import density as den
from quantloom.operators import parsimony as par
from quantloom.operators import qc
from quantloom.operators import rollup as rup
from quantloom.runtime import table
from quantloom.scratch import Scratch
from quantloom.sources import formats, reports, spectral
from quantloom.streaming import ingest

from . import binding as b
from .binding import with_ctes
from .queries_groups import PAR
from .queries_rollup import rounded

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def written(spark, df, suffix: str, sep: str = ",") -> str:
    """The rows as text files with a header, in a new folder of the shared directory."""
    path = Scratch(spark, "queries").path(f"report{suffix}")
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def report_files(spark, sf) -> dict[str, str]:
    """One csv report per return flag, from one pass."""
    path = Scratch(spark, "queries").path("reports")
    b.exported(spark, sf).write.partitionBy("document").option("header", True).csv(path)
    return {f: f"{path}/document={f}" for f in "ANR"}


def lines(spark, rows: list[str], suffix: str) -> str:
    path = Scratch(spark, "queries").path(f"lines{suffix}")
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


TYPED = {"Peptide Modified Sequence": "feature", "Fragment Ion": "ion", "Precursor Charge": "charge", "Replicate Name": "replicate", "Area": "area", "Retention Time": "rt", "Shape Correlation": "shape", "Detection Q Value": "q"}
READ = "SELECT feature, ion, charge, replicate, round(area, 6) AS area, round(rt, 6) AS rt, round(shape, 6) AS shape, round(q, 6) AS q FROM exported"


def _typed(df):
    return rounded(df.select(*[F.col(f"`{h}`").alias(n) for h, n in TYPED.items()]))


@query(with_ctes(READ, "exported"))
def src_csv(spark, sf):
    """SRC-01: numbers, and nulls for what is none."""
    return _typed(reports.read_report(spark, written(spark, b.exported(spark, sf).drop("document"), ".csv")))


@query(with_ctes(READ, "exported"))
def src_tsv(spark, sf):
    """SRC-02."""
    return _typed(reports.read_report(spark, written(spark, b.exported(spark, sf).drop("document"), ".tsv", "\t")))


@query(with_ctes("SELECT feature, replicate, concat(replicate, '__@__', document) AS sample_id, document AS source, document AS batch, charge, area IS NULL AS missing, count(*) AS n, round(sum(area), 2) AS area FROM exported GROUP BY ALL", "exported"))
def src_merge_sorted(spark, sf):
    """SRC-05..07, 09, 10, PRJ-01: three reports merged, written range-partitioned and sorted, and read back."""
    merged = reports.merge_reports([(n, reports.read_report(spark, p)) for n, p in report_files(spark, sf).items()])
    path = Scratch(spark, "queries").path("merged.parquet")
    reports.write_sorted(merged, path, "Peptide Modified Sequence")
    m = reports.read_report(spark, path)
    keys = [F.col("`Peptide Modified Sequence`").alias("feature"), F.col("`Replicate Name`").alias("replicate"), F.col("`Sample ID`").alias("sample_id"), F.col("`Source Document`").alias("source"), F.col("Batch").alias("batch"), F.col("`Precursor Charge`").cast("long").alias("charge"), F.col("Area").isNull().alias("missing")]
    return m.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("Area"), 2).alias("area"))


@query(with_ctes("SELECT concat(feature, '_', charge) AS precursor_id, replicate, document AS source_document, round(area, 6) AS abundance, 'fragment' AS abundance_type FROM exported", "exported"))
def src_load_report(spark, sf):
    """SRC-11: each report under its own name."""
    found = [reports.load_report(reports.read_report(spark, path), name) for name, path in report_files(spark, sf).items()]
    r = reduce(DataFrame.unionByName, found)
    return rounded(r.select("precursor_id", F.col("`Replicate Name`").alias("replicate"), "source_document", "abundance", "abundance_type"))


@query(with_ctes("SELECT DISTINCT replicate AS sample FROM exported", "exported"))
def src_distinct_samples(spark, sf):
    """SRC-23."""
    e = b.exported(spark, sf).withColumn("sample", F.col("`Replicate Name`"))
    return spark.createDataFrame([(s,) for s in rup.sample_list(e)], "sample string")


def _meta_files(spark, sf) -> list[str]:
    """The sample table as two files with different headers and vendor types."""
    s = b.samples(spark, sf)
    vendor = F.when(F.col("sample_type") == "reference", "Standard").when(F.col("sample_type") == "qc", "Quality Control").otherwise("Unknown")
    one = s.where("batch <> 'B2'").select(F.col("sample").alias("Replicate Name"), vendor.alias("Sample Type"), F.col("batch").alias("Batch Name"))
    two = s.where("batch <> 'B0'").select(F.concat(F.lit(" "), F.col("sample")).alias("sample"), "sample_type", "batch")
    return [written(spark, one, "-1.csv"), written(spark, two, "-2.tsv", "\t")]


@query(with_ctes("SELECT sample, sample_type, batch FROM samples", "samples"))
def src_metadata(spark, sf):
    """SRC-14, SRC-15, FLT-09: headers and types of two forms; equal rows of both files count once."""
    return reports.load_metadata(spark, _meta_files(spark, sf))


@query(with_ctes("SELECT e.replicate AS sample, e.document, s.sample_type, count(*) AS n FROM exported e JOIN samples s ON s.sample = e.replicate GROUP BY ALL", "exported", "samples"))
def src_metadata_documents(spark, sf):
    """SRC-16: keys qualified by document first, then the plain name."""
    meta = reports.load_metadata(spark, _meta_files(spark, sf), documents=["A", "N"])
    rows = b.exported(spark, sf).select(F.col("`Replicate Name`").alias("sample"), "document")
    return reports.with_metadata(rows, meta).groupBy("sample", "document", "sample_type").agg(F.count("*").alias("n"))


META_JOIN = "SELECT r.sample || CASE WHEN r.transition % 2 = 0 THEN '__@__' || r.batch ELSE '' END AS sample, {} AS sample_type, {} AS batch, count(*) AS n FROM report r LEFT JOIN samples s ON s.sample = r.sample AND s.sample <> 'S03' GROUP BY ALL"


def _named_rows(spark, sf):
    return b.report(spark, sf).select(F.concat("sample", F.when(F.col("transition") % 2 == 0, F.concat(F.lit("__@__"), F.col("batch"))).otherwise("")).alias("sample"))


@query(with_ctes(META_JOIN.format("coalesce(s.sample_type, 'experimental')", "s.batch"), "report", "samples"))
def jn_sample_metadata(spark, sf):
    """JN-01, JN-02: by the sample id, else by its replicate part; unknown samples stay."""
    joined = reports.with_metadata(_named_rows(spark, sf), b.samples(spark, sf).where("sample <> 'S03'"))
    return joined.groupBy("sample", "sample_type", "batch").agg(F.count("*").alias("n"))


@query(with_ctes("SELECT 'data/' || r.sample || '.raw' AS sample, s.sample_type, s.batch, count(*) AS n FROM report r JOIN samples s ON s.sample = r.sample GROUP BY ALL", "report", "samples"))
def jn_metadata_plain(spark, sf):
    """JN-03: names retried without folder, extension, batch suffix and underscores."""
    rows = b.report(spark, sf).select(F.concat(F.lit("data/"), F.col("sample"), F.lit(".raw")).alias("sample"))
    meta = b.samples(spark, sf).withColumn("sample", F.concat("sample", F.lit("_"), F.when(F.col("batch") == "B1", "_@_B1").otherwise("")))
    return reports.with_metadata(rows, meta, normalised=True).groupBy("sample", "sample_type", "batch").agg(F.count("*").alias("n"))


@query(with_ctes("SELECT 'data' AS side, sample FROM (SELECT DISTINCT sample FROM report) WHERE sample IN ('S01', 'S07') UNION ALL SELECT 'metadata', 'S99'", "report"))
def jn_unmatched(spark, sf):
    """JN-10: both differences."""
    meta = b.samples(spark, sf).where("sample NOT IN ('S01', 'S07')").select("sample").unionByName(spark.createDataFrame([("S99",)], "sample string"))
    data, other = reports.unmatched(b.report(spark, sf), meta)
    return data.select(F.lit("data").alias("side"), "sample").unionByName(other.select(F.lit("metadata").alias("side"), "sample"))


@query(with_ctes("SELECT r.feature, r.sample, s.sample_type, s.batch, o.k AS run_order, r.n FROM (SELECT feature, sample, count(*) AS n FROM report GROUP BY ALL) r JOIN samples s ON s.sample = r.sample JOIN (SELECT sample, row_number() OVER (PARTITION BY batch ORDER BY sample DESC) AS k FROM samples) o ON o.sample = r.sample", "report", "samples"))
def src_unified(spark, sf):
    """SRC-12, SRC-13: metadata and run order joined, written by batch, loaded again."""
    rows = b.report(spark, sf).groupBy("feature", "sample").agg(F.count("*").alias("n"))
    meta = b.samples(spark, sf).withColumn("acquired", F.lit("2020-01-01").cast("date") - F.substring("sample", 2, 2).cast("int"))
    path = Scratch(spark, "queries").path("unified")
    reports.write_unified(rows, meta, path)
    return rounded(reports.load_unified(spark, path).withColumn("batch", F.col("batch").cast("string")))


@query("SELECT sample, transition, n FROM (SELECT l_suppkey AS sample, l_linenumber AS transition, count(*) AS n FROM lineitem GROUP BY ALL)")
def src_ingest(spark, sf):
    """SRC-04: a folder of files taken incrementally into one table; a second call takes nothing twice."""
    scratch = Scratch(spark, "queries")
    source, target, mark = (scratch.path(n) for n in ("in", "out", "mark"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").cast("long").alias("transition"))
    rows.repartition(3).write.option("header", True).csv(source)
    for _ in range(2):
        ingest.ingest_new(spark, source, target, mark, "sample long, transition long", "csv")
    return spark.read.parquet(target).groupBy("sample", "transition").agg(F.count("*").alias("n"))


@query("SELECT upper(substr(n_name, 1, 1)) || n_nationkey AS entity, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS gene, upper(regexp_replace(string_agg(b.text, '' ORDER BY b.item_id), '[^A-Za-z]', '', 'g')) AS sequence FROM nation JOIN benchmark b ON b.item_id % 25 = n_nationkey GROUP BY ALL")
def src_fasta(spark, sf):
    """SRC-17: wrapped sequences, two forms of header, the first record of an accession wins."""
    seq = table(spark, sf, "benchmark").groupBy((F.col("item_id") % 25).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda r: F.regexp_replace(r["text"], "[^A-Za-z]", "")), "\n").alias("s"))
    n = table(spark, sf, "nation").withColumn("id", F.concat(F.upper(F.substring("n_name", 1, 1)), "n_nationkey"))
    head = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(">sp|"), "id", F.lit("|E_X Some name OS=Y GN="), "n_name", F.lit(" PE=1"))).otherwise(F.concat(F.lit(">"), "id", F.lit(" plain")))
    rows = n.join(seq, F.col("n_nationkey") == F.col("k")).select("n_nationkey", F.concat(head, F.lit("\n"), "s").alias("value"))
    records = [r["value"] for r in rows.orderBy("n_nationkey").collect()]
    twice = [">" + records[0].split("|")[1] + " again\nWWW"] if "|" in records[0].split("\n")[0] else []
    return formats.read_fasta(spark, lines(spark, records + twice, ".fasta")).select("entity", "gene", "sequence")


@query(with_ctes("SELECT key, count(*) AS n, round(sum(intensity), 4) AS total, min(entity) AS entity, round(min(mz), 4) AS first_mz FROM l GROUP BY ALL", l="SELECT concat('P', l_partkey, '_', l_suppkey % 3 + 1) AS key, l_extendedprice / 100 AS mz, l_quantity AS intensity, concat('E', l_partkey % 5) AS entity FROM lineitem WHERE l_linenumber <> 6"))
def src_library_tsv(spark, sf):
    """SRC-19, SRC-20, FLT-06, AGG-07: a library without its decoys, one list of fragments per precursor."""
    l = table(spark, sf, "lineitem")
    out = l.select(F.concat(F.lit("P"), "l_partkey").alias("ModifiedPeptide"), (F.col("l_suppkey") % 3 + 1).alias("PrecursorCharge"), (F.col("l_extendedprice") / 100).alias("FragmentMz"), F.col("l_quantity").alias("RelativeIntensity"), F.lit("y").alias("FragmentType"), F.col("l_linenumber").alias("FragmentNumber"), F.lit(1).alias("FragmentCharge"), F.concat(F.lit("E"), F.col("l_partkey") % 5).alias("ProteinID"), F.when(F.col("l_linenumber") == 6, "1").when(F.col("l_linenumber") == 5, F.lit(None)).otherwise("0").alias("Decoy"))
    s = formats.spectra(formats.read_library(spark, written(spark, out, ".tsv", "\t")))
    return s.select("key", F.size("fragments").cast("long").alias("n"), F.round("total", 4).alias("total"), "entity", F.round(F.get("fragments", 0)["mz"], 4).alias("first_mz"))


@query("SELECT key, count(*) AS n, round(sum(intensity), 6) AS total, round(min(mz), 4) AS first_mz, max(intensity) AS top, CAST(nullif(min(rt), 0) AS DOUBLE) AS rt FROM (SELECT concat('P', l_partkey, '_', l_partkey % 3 + 1) AS key, l_extendedprice / 100 AS mz, l_quantity / max(l_quantity) OVER (PARTITION BY l_partkey) AS intensity, l_partkey % 50 AS rt FROM lineitem) GROUP BY ALL")
def src_library_sqlite(spark, sf):
    """SRC-18: a library file written from all lines and read back in ranges of ids."""
    l = table(spark, sf, "lineitem")
    peaks = l.select(F.concat(F.lit("P"), "l_partkey").alias("feature"), (F.col("l_partkey") % 3 + 1).cast("int").alias("charge"), (F.col("l_partkey") % 50).cast("double").alias("rt"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    scratch = Scratch(spark, "library")
    path = f"{scratch.root}-{uuid.uuid4().hex}.blib"
    spectral.write_library_sqlite(peaks, path)
    got = scratch.table(spectral.read_library_sqlite(spark, path, spectra_per_task=500), "peaks")
    scratch.remove(path)
    return got.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 6).alias("total"), F.round(F.min("mz"), 4).alias("first_mz"), F.max("intensity").alias("top"), F.min("rt").alias("rt"))


@query("SELECT s_suppkey AS window, round(s_acctbal - 1.5, 4) AS lo, round(s_acctbal + 2.5, 4) AS hi, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS rt_lo FROM supplier")
def src_isolation_xml(spark, sf):
    """SRC-25, DEN-09: schemes of batches written to a catalogue of XML texts and read back."""
    s = table(spark, sf, "supplier")
    w = s.select(F.col("s_suppkey").cast("int").alias("window"), (F.col("s_acctbal") - 1.5).alias("lo"), (F.col("s_acctbal") + 2.5).alias("hi"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("double")).alias("rt_lo"), F.lit(None).cast("double").alias("rt_hi"))
    path = Scratch(spark, "queries").path("catalogue")
    formats.write_catalogue(spark, {"B1": ("one", w), "B2": ("two", w.limit(0))}, path)
    name, got = formats.read_catalogue(spark, path)["B1"]
    first = s.agg(F.min("s_suppkey")).first()[0]
    return got.select((F.col("window") + first).cast("long").alias("window"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.col("rt_lo").cast("int").alias("rt_lo"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS window, round(s_acctbal - 2.0, 4) AS lo, round(s_acctbal + 2.0, 4) AS hi, CAST(s_nationkey AS DOUBLE) AS rt_lo FROM supplier WHERE s_suppkey % 4 <> 1")
def src_inclusion_list(spark, sf):
    """SRC-26: centre and width; rows without a centre are no windows."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.format_string("x,%s,4.0,%s", F.when(F.col("s_suppkey") % 4 != 1, F.col("s_acctbal").cast("string")).otherwise(""), F.col("s_nationkey").cast("string")).alias("v")).orderBy("s_suppkey").collect()
    w = formats.read_inclusion_list(spark, "\n".join(["Compound,m/z,Isolation Window (m/z),t start (min)".replace("Isolation Window (m/z)", "Window width"), *[r["v"] for r in rows]]))
    return w.select(F.col("window").cast("long").alias("window"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "rt_lo")


@query("SELECT DISTINCT 'mine' AS list, 3 AS priority, s_name AS member FROM supplier WHERE s_suppkey % 5 <> 0")
def src_members(spark, sf):
    """SRC-27: first fields, without comments and repeats."""
    rows = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("# "), "s_name")).otherwise(F.concat(F.lit('"'), "s_name", F.lit('",'), F.col("s_nationkey").cast("string")))).collect()
    m = formats.read_members(spark, lines(spark, [r[0] for r in rows] * 2, ".txt"), "mine", 3)
    return rounded(m)


WIDE = "SELECT '{0}' AS form, CAST(feature AS BIGINT) AS feature, round(max(x) FILTER (sample = 'S00'), 6) AS S00, round(max(x) FILTER (sample = 'S11'), 6) AS S11 FROM v GROUP BY feature"


@query(with_ctes(" UNION ALL ".join(WIDE.format(f) for f in ("parquet", "csv", "tsv")), "v"))
def snk_matrix(spark, sf):
    """SNK-01, SNK-03: one wide matrix in three forms, read back."""
    wide = Scratch(spark, "queries").table(qc.wide(b.values(spark, sf), [f"S{i:02d}" for i in range(12)]), "wide")
    out = None
    for form in ("parquet", "csv", "tsv"):
        path = Scratch(spark, "queries").path(f"matrix.{form}")
        reports.write_matrix(wide, path, form)
        back = spark.read.parquet(path) if form == "parquet" else spark.read.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
        part = back.select(F.lit(form).alias("form"), F.col("feature").cast("long").alias("feature"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("S00", "S11")])
        out = part if out is None else out.unionByName(part)
    return out


@query(with_ctes(
    "SELECT g.group_id, g.leader, m.members, coalesce(s.subsumed, '') AS subsumed, r.nu + r.nr AS n, r.nu, r.nr, r.uniq, r.razor FROM g JOIN m ON m.leader = g.leader LEFT JOIN s ON s.leader = g.leader JOIN r ON r.leader = g.leader WHERE r.nu + r.nr > 0", "edges", **PAR,
    g="SELECT leader, printf('PG%04d', row_number() OVER (ORDER BY leader)) AS group_id FROM (SELECT DISTINCT leader FROM leaders)",
    m="SELECT leader, string_agg(entity, ';' ORDER BY entity) AS members FROM leaders GROUP BY ALL",
    s="SELECT l.leader, string_agg(sub.entity, ';' ORDER BY sub.entity) AS subsumed FROM sub JOIN leaders l ON l.entity = sub.by GROUP BY ALL",
    r="SELECT leader, count(*) FILTER (role = 'unique') AS nu, count(*) FILTER (role = 'razor') AS nr, coalesce(string_agg(CAST(feature AS VARCHAR), ';' ORDER BY CAST(feature AS VARCHAR)) FILTER (role = 'unique'), '') AS uniq, coalesce(string_agg(CAST(feature AS VARCHAR), ';' ORDER BY CAST(feature AS VARCHAR)) FILTER (role = 'razor'), '') AS razor FROM roles GROUP BY ALL"))
def snk_groups(spark, sf):
    """SNK-04: the exported group table, written as csv and read back."""
    path = Scratch(spark, "queries").path("groups.csv")
    t = reports.group_table(par.groups(b.edges(spark, sf)))
    assert len(t.columns) == 15
    reports.write_matrix(t, path, "csv")
    back, text = spark.read.option("header", True).csv(path), lambda c: F.coalesce(F.col(c), F.lit(""))
    num = lambda c: F.col(c).cast("long")
    return back.select(F.col("GroupID").alias("group_id"), F.col("LeadingProtein").alias("leader"), text("MemberProteins").alias("members"), text("SubsumedProteins").alias("subsumed"), num("NPeptides").alias("n"), num("NUniquePeptides").alias("nu"), num("NRazorPeptides").alias("nr"), text("UniquePeptides").alias("uniq"), text("RazorPeptides").alias("razor"))


@query(with_ctes("SELECT sample || '__@__' || batch AS sample_id, sample, sample_type, batch FROM samples", "samples"))
def snk_sample_table(spark, sf):
    """SNK-07."""
    s = b.report(spark, sf).withColumn("sample", names.sample_id(F.col("sample"), F.col("batch")))
    path = Scratch(spark, "queries").path("sample_metadata.csv")
    reports.write_matrix(reports.sample_table(s), path, "csv")
    return spark.read.option("header", True).csv(path)


@query(with_ctes("SELECT feature, ion, count(*) AS n FROM exported WHERE ion <> 'precursor' GROUP BY ALL", "exported"))
def flt_fragments(spark, sf):
    """FLT-01."""
    e = b.exported(spark, sf).select(F.col("`Peptide Modified Sequence`").alias("feature"), F.col("`Fragment Ion`").alias("ion"))
    return names.without_precursor_ions(e).groupBy("feature", "ion").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS feature, l_linenumber AS charge, l_extendedprice / 100 AS mz, min(l_discount) AS start, max(l_discount + l_tax) AS stop FROM lineitem WHERE l_quantity / 1000 <= 0.02 AND l_quantity > 1 GROUP BY ALL")
def flt_q_values(spark, sf):
    """FLT-05, FLT-12: text q values, cut; unreadable ones are out."""
    q = F.when(F.col("l_quantity") > 1, (F.col("l_quantity") / 1000).cast("string")).otherwise("#N/A")
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_linenumber").cast("long").alias("charge"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_discount").alias("start"), (F.col("l_discount") + F.col("l_tax")).alias("stop"), q.alias("q"))
    return den.precursors(l, max_q=0.02)


@query(with_ctes("SELECT feature, accession, n FROM (SELECT feature, accession, count(*) AS n FROM (SELECT feature, CASE WHEN charge = 1 THEN accession WHEN charge = 2 THEN 'x prtc y' ELSE 'P4' END AS accession FROM exported) GROUP BY ALL) WHERE regexp_matches(lower(accession), 'prtc|eno1_yeast|p00924|enolase')", "exported"))
def flt_internal_standards(spark, sf):
    """FLT-07."""
    z = F.col("`Precursor Charge`")
    e = b.exported(spark, sf).select(F.col("`Peptide Modified Sequence`").alias("feature"), F.when(z == "1", F.col("`Protein Accession`")).when(z == "2", "x prtc y").otherwise("P4").alias("accession"))
    return names.internal_standards(e, "accession").groupBy("feature", "accession").agg(F.count("*").alias("n"))


@query(with_ctes("SELECT true AS valid, count(*) AS rows, count(DISTINCT feature) AS features, count(DISTINCT replicate) AS replicates FROM exported", "exported"))
def flt_validate(spark, sf):
    """FLT-10, FLT-11."""
    e = b.exported(spark, sf)
    names.refuse_own_output(e)
    v = names.validate(e)
    return spark.createDataFrame([(v["valid"], v["rows"], v["features"], v["replicates"])], "valid boolean, rows long, features long, replicates long")


@query("SELECT event_type AS kind, 'experimental' AS mapped FROM events GROUP BY ALL UNION ALL SELECT k, m FROM (VALUES ('Standard', 'reference'), ('QUALITY CONTROL', 'qc'), (' blank ', 'blank'), ('Solvent', 'blank'), ('Double Blank', 'blank'), ('Unknown', 'experimental')) t(k, m)")
def flt_vendor_types(spark, sf):
    """FLT-09."""
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    kinds = kinds.unionByName(spark.createDataFrame([(k,) for k in ("Standard", "QUALITY CONTROL", " blank ", "Solvent", "Double Blank", "Unknown")], "kind string"))
    return kinds.select("kind", names.vendor_type(F.col("kind")).alias("mapped"))


@query(with_ctes("SELECT feature, sample, round(x, 6) AS x FROM (SELECT feature, sample, CASE WHEN feature % 9 > 0 AND (feature % 2 = 0 OR sample <> 'S03') THEN x END AS x FROM v) WHERE feature % 9 > 0", "v"))
def flt_seen_features(spark, sf):
    """FLT-03."""
    v = b.values(spark, sf).select("feature", "sample", F.expr("CASE WHEN feature % 9 > 0 AND (feature % 2 = 0 OR sample <> 'S03') THEN x END").alias("x"))
    return rounded(pipeline.seen_features(v))


@query(with_ctes(
    "SELECT k.feature, s.sample, round(coalesce(h.x, k.mid), 6) AS x FROM (SELECT feature, median(x) AS mid FROM h GROUP BY feature HAVING count(*) >= 0.5 * (SELECT count(DISTINCT sample) FROM h)) k CROSS JOIN (SELECT DISTINCT sample FROM h) s LEFT JOIN h ON h.feature = k.feature AND h.sample = s.sample", "v",
    h="SELECT feature, sample, x FROM v WHERE CAST(substr(sample, 2) AS INT) >= feature % 11"))
def flt_half_density(spark, sf):
    """FLT-13: features seen in half of the samples, gaps filled by their median."""
    return rounded(qc.filled(b.values(spark, sf).where("CAST(substr(sample, 2) AS INT) >= feature % 11").select("feature", "sample", "x")))


@query("SELECT p_partkey AS k, nullif(trim(split_part(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END, ';', 1)), '') AS protein, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END), '') END AS accession, CASE WHEN p_size % 5 = 0 THEN p_type END AS gene FROM part")
def prj_identities(spark, sf):
    """PRJ-05, DEN-02: identity from the first filled candidate column."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.col("p_name"), F.lit("; other"))).alias("leading_name"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")).alias("leading_protein"), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(";x"))).alias("leading_uniprot_id"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("leading_gene_name"))
    return den.identities(p).select("k", "protein", "accession", "gene")


@query("SELECT s_suppkey AS k, [s_name, n_name] AS parts, s_name AS first FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT -1, [], NULL")
def prj_groups(spark, sf):
    """DEN-02: cells of joined groups, split."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("k"), F.concat(F.lit(";"), "s_name", F.lit(" ; ;"), "n_name", F.lit(" ")).alias("v"))
    s = s.unionByName(spark.createDataFrame([(-1, None)], "k long, v string"))
    return s.select("k", den.split_groups(F.col("v")).alias("parts"), den.first_group(F.col("v")).alias("first"))


RUN = dict(
    xc="SELECT feature, concat(ion, '_z', charge, '_1') AS transition, concat(replicate, '__@__', document) AS sample, max(area) AS area FROM exported WHERE ion <> 'precursor' AND area IS NOT NULL GROUP BY ALL",
    xl="SELECT feature, greatest(0.5 * quantile_cont(area, 0.01), 1.0) AS low FROM xc WHERE area > 0 GROUP BY feature",
    xm="SELECT t.feature, t.transition, s.sample, log2(CASE WHEN c.area > 0 THEN c.area ELSE coalesce(l.low, 1.0) END) AS x FROM (SELECT DISTINCT feature, transition FROM xc WHERE feature IN (SELECT feature FROM xc GROUP BY feature HAVING count(DISTINCT transition) >= 3)) t CROSS JOIN (SELECT DISTINCT sample FROM xc) s LEFT JOIN xc c ON c.feature = t.feature AND c.transition = t.transition AND c.sample = s.sample LEFT JOIN xl l ON l.feature = t.feature",
    xf="SELECT feature, sample, log2(greatest(sum(pow(2.0, x)), 1.0)) AS x FROM xm GROUP BY ALL",
    xmed="SELECT sample, median(x) AS med FROM xf GROUP BY ALL",
    xn="SELECT xf.feature, xf.sample, x - (med - (SELECT median(med) FROM xmed)) AS x FROM xf JOIN xmed ON xmed.sample = xf.sample",
    edges="SELECT DISTINCT feature, trim(unnest(string_split(accession, ';'))) AS entity FROM exported",
)
RUN_ROLES = dict(
    xp="SELECT r.leader AS entity, xn.feature, xn.sample, xn.x FROM xn JOIN roles r ON r.feature = xn.feature",
    xk="SELECT entity, count(DISTINCT feature) AS n FROM xp GROUP BY ALL",
    xe="SELECT xp.entity, sample, CASE WHEN max(xk.n) = 1 THEN max(x) ELSE log2(greatest(sum(pow(2.0, x)), 1.0)) END AS x FROM xp JOIN xk ON xk.entity = xp.entity GROUP BY ALL",
    xem="SELECT sample, median(x) AS med FROM xe GROUP BY ALL",
)


@query(with_ctes("SELECT xe.entity, xe.sample, round(x - (med - (SELECT median(med) FROM xem)), 5) AS x FROM xe JOIN xem ON xem.sample = xe.sample", "exported", **RUN, **PAR, **RUN_ROLES))
def run_reports(spark, sf):
    """RUP-30, RUP-12, RUP-20: report files to entity abundances by configuration (sums, medians, no correction)."""
    e = b.exported(spark, sf).groupBy("document", "Peptide Modified Sequence", "Fragment Ion", "Precursor Charge", "Product Charge", "Replicate Name").agg(F.max(F.expr("try_cast(Area AS DOUBLE)")).alias("Area"), F.array_join(F.array_sort(F.collect_set("Protein Accession")), ";").alias("Protein Accession"))
    scratch = Scratch(spark, "exported")
    e = scratch.table(e, "rows")  # for three files
    files = {f: written(spark, e.where(F.col("document") == f).drop("document"), f"-{f}.csv") for f in "ANR"}
    scratch.drop(e)
    meta = b.samples(spark, sf)
    off = {"enabled": False}
    config = {"global_normalization": {"method": "median"}, "batch_correction": off, "protein_rollup": {"method": "sum"}, "protein_correction": off}
    _, entities, _ = pipeline.run_reports(spark, files, meta, config)
    return rounded(entities.select("entity", "sample", "x"), digits=5)
