"""Other inputs: FASTA, spectral libraries (TSV, SQLite), isolation schemes, name lists."""

from __future__ import annotations

import csv
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spectral


def fasta_accession(header: Column) -> Column:
    triple = F.regexp_extract(header, r"^(?:sp|tr)\|([^|\s]+)\|", 1)
    gi = F.regexp_extract(header, r"^gi\|\d+\|\w+\|([^|\s]+)", 1)
    return F.coalesce(F.nullif(triple, F.lit("")), F.nullif(gi, F.lit("")), F.regexp_extract(header, r"^(\S+)", 1))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(entity, name, gene, description, sequence); plain or gzipped; the first record of an accession wins."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")  # a ">" inside a header does not begin a record
    raw = records.select(F.regexp_replace("value", r"^\s*>", "").alias("value"), F.monotonically_increasing_id().alias("row"))
    header, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"[\s*]", "")
    parsed = raw.select("row", F.trim(header).alias("h"), F.upper(body).alias("sequence"))
    gene = F.nullif(F.regexp_extract("h", r"\bGN=(\S+)", 1), F.lit(""))
    name = F.nullif(F.regexp_extract("h", r"^(?:sp|tr)\|[^|]+\|(\S+)", 1), F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace("h", r"^\S+\s*", ""), r"\s(?:OS|OX|GN|PE|SV)=.*$", ""))
    rows = parsed.select(fasta_accession(F.col("h")).alias("entity"), F.struct("row", name.alias("name"), gene.alias("gene"), text.alias("description"), "sequence").alias("r"))
    return rows.groupBy("entity").agg(F.min("r").alias("r")).select("entity", "r.name", "r.gene", "r.description", "r.sequence")


def read_library_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(key, ion, mz, intensity, feature, charge, rt, entity) without decoys."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    num = lambda c: F.col(c).try_cast("double")
    if "Decoy" in df.columns:
        df = df.where("try_cast(Decoy AS INT) = 0 OR Decoy IS NULL")
    ion = F.concat(F.col("FragmentType"), F.col("FragmentNumber"), F.when(F.col("FragmentCharge").try_cast("int") > 1, F.concat(F.lit("^"), F.col("FragmentCharge"))).otherwise(""))
    rt = num("Tr_recalibrated") if "Tr_recalibrated" in df.columns else F.lit(None).cast("double")
    entity = F.col("ProteinID") if "ProteinID" in df.columns else F.lit(None).cast("string")
    return df.select(F.concat_ws("_", "ModifiedPeptide", "PrecursorCharge").alias("key"), ion.alias("ion"), num("FragmentMz").alias("mz"), num("RelativeIntensity").alias("intensity"), F.col("ModifiedPeptide").alias("feature"), F.col("PrecursorCharge").try_cast("int").alias("charge"), rt.alias("rt"), entity.alias("entity"))


def spectra(library: DataFrame) -> DataFrame:
    """One row per key with its fragments as a list, by m/z."""
    return library.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("mz", "ion", "intensity"))).alias("fragments"), F.sum("intensity").alias("total"), F.min("entity").alias("entity"))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".blib", ".sqlite", ".db")):
        return spectral.read_library_sqlite(spark, path)
    return read_library_tsv(spark, path)


WINDOWS = "window int, lo double, hi double, rt_lo double, rt_hi double"


def read_isolation_xml(spark: SparkSession, text: str) -> DataFrame:
    """Windows of an isolation scheme; margins widen them on both sides."""
    rows = []
    for i, w in enumerate(ET.fromstring(text).iter("isolation_window")):
        get = lambda k: float(w.get(k)) if w.get(k) is not None else None
        margin = get("margin") or 0.0
        rows.append((i, get("start") - margin, get("end") + margin, get("rt_start"), get("rt_stop")))
    return spark.createDataFrame(rows, WINDOWS)


def read_inclusion_list(spark: SparkSession, text: str) -> DataFrame:
    """Windows of a vendor inclusion list: centre and width, optional start and stop times."""
    rows = list(csv.DictReader(text.splitlines()))
    key = lambda r, *parts: next((r[k] for k in r if k and all(p in k.lower() for p in parts)), None)
    num = lambda v: float(v) if v not in (None, "") else None
    out = []
    for r in rows:
        centre, width = num(key(r, "m/z")), num(key(r, "window") or key(r, "width"))
        if centre is not None and width is not None:
            out.append((len(out), centre - width / 2, centre + width / 2, num(key(r, "start")), num(key(r, "stop") or key(r, "end"))))
    return spark.createDataFrame(out, WINDOWS)


def write_isolation_xml(windows: DataFrame, name: str) -> str:
    """A scheme (a few hundred rows) as XML text."""
    root = ET.Element("isolation_scheme", name=name)
    for r in windows.orderBy("window").collect():
        attrs = {"start": repr(r["lo"]), "end": repr(r["hi"])}
        attrs |= {k: repr(r[c]) for k, c in (("rt_start", "rt_lo"), ("rt_stop", "rt_hi")) if r[c] is not None}
        ET.SubElement(root, "isolation_window", attrs)
    return ET.tostring(root, encoding="unicode")


def read_members(spark: SparkSession, path: str, name: str, priority: int) -> DataFrame:
    """(list, priority, member) of a text or csv file: the first field of each line, comments and repeats left out."""
    first = F.trim(F.regexp_replace(F.split(F.col("value"), r"[,\t]")[0], '"', ""))
    lines = spark.read.text(path).select(first.alias("member")).where("member <> '' AND member NOT LIKE '#%'").dropDuplicates(["member"])
    return lines.select(F.lit(name).alias("list"), F.lit(priority).alias("priority"), "member")


def write_catalogue(spark: SparkSession, schemes: dict[str, tuple[str, DataFrame]], path: str) -> None:
    """Schemes of batches, (batch, name, xml), as one small table: batch -> (scheme name, windows)."""
    rows = [(batch, name, write_isolation_xml(windows, name)) for batch, (name, windows) in sorted(schemes.items())]
    spark.createDataFrame(rows, "batch string, name string, xml string").coalesce(1).write.mode("overwrite").parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> dict[str, tuple[str, DataFrame]]:
    return {r["batch"]: (r["name"], read_isolation_xml(spark, r["xml"])) for r in spark.read.parquet(path).collect()}
