"""Reports: reading, merging, sorting; sample metadata; fingerprints; sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import find, precursor_id, sample_id, vendor_type


#: Logical columns of a report that hold numbers; text that is none reads as null.
NUMBERS = {"charge": "int", "product_charge": "int", **dict.fromkeys(("mz", "product_mz", "area", "rt", "start", "stop", "shape", "q"), "double")}
MISSING = ("#N/A", "")


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop: local files, HDFS and object stores alike."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def has_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds Parquet files, at its top or in partitions."""
    fs, p = _path(spark, path)
    listing = fs.listFiles(p, True)
    while listing.hasNext():
        if listing.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def read_report(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files or folders; csv; tab-separated (.tsv, .txt).

    Text files are read by their header as text. Cells of known numeric columns that
    are no number become null, like ``#N/A`` and empty cells anywhere; no row is
    lost for a bad cell. ``columns`` gives the headers where the file has none.
    """
    bare = path.rstrip("/").lower()
    if bare.endswith(".parquet") or (is_folder(spark, path) and has_parquet(spark, path)):
        return spark.read.parquet(path)
    reader = spark.read.option("sep", "\t" if bare.endswith((".tsv", ".txt")) else ",").option("header", columns is None).option("escape", '"')
    df = reader.csv(path)
    if columns is not None:
        df = df.toDF(*columns)
    known = {c: kind for logical, kind in NUMBERS.items() if (c := find(df.columns, logical))}
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    clean = lambda c: F.when(~F.trim(q(c)).isin(*MISSING), q(c))
    return df.select(*[(F.trim(clean(c)).try_cast(known[c]) if c in known else clean(c)).alias(c) for c in df.columns])


def load_report(df: DataFrame, name: str) -> DataFrame:
    """A report with source document, precursor_id, abundance and abundance_type: fragments if any were measured, else the precursor scan."""
    col = lambda k: F.col(f"`{find(df.columns, k)}`")
    have = [(c, kind) for header, kind in (("Total Area Fragment", "fragment"), ("Area", "fragment"), ("Total Area Ms1", "ms1")) if (c := next((x for x in df.columns if x.lower() == header.lower()), None))]
    seen = df.agg(*[F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"n{i}") for i, (c, _) in enumerate(have)]).first() if have else ()
    found = next(((c, kind) for (c, kind), n in zip(have, seen) if n), None)
    if found is None:
        raise ValueError("the report has no areas")
    ids = precursor_id(col("feature"), col("charge"))
    out = df if "precursor_id" in df.columns else df.withColumn("precursor_id", F.when(col("feature").isNotNull(), ids))
    return out.withColumns({"source_document": F.lit(name), "abundance": F.expr(f"try_cast(`{found[0]}` AS DOUBLE)"), "abundance_type": F.lit(found[1])})


def add_origin(df: DataFrame, name: str) -> DataFrame:
    """Batch, Source Document and Sample ID where the report lacks them."""
    replicate = find(df.columns, "replicate")
    if "Source Document" not in df.columns:
        df = df.withColumn("Source Document", F.lit(name))
    if find(df.columns, "batch") is None:
        df = df.withColumn("Batch", F.lit(name))
    if "Sample ID" not in df.columns:
        df = df.withColumn("Sample ID", sample_id(F.col(f"`{replicate}`"), F.col(f"`{find(df.columns, 'batch')}`").cast("string")))
    return df


def merge_reports(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of reports with the first one's schema; a column that only some of them have is an error."""
    frames = [add_origin(df, name) for name, df in parts]
    first = frames[0]
    for df in frames[1:]:
        if set(df.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(first.columns))}")
    cast = lambda df: df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in first.schema])
    return reduce(DataFrame.unionByName, [first, *map(cast, frames[1:])])


def write_sorted(df: DataFrame, path: str, key: str, rows_per_file: int = 1_000_000) -> None:
    """Range-partitioned by key and sorted inside partitions: globally sorted files with tight key statistics."""
    df.repartitionByRange(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`")).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def long_cells(df: DataFrame) -> DataFrame:
    """(feature, transition, sample, batch, area, rt, shape, coeluting, q, row) from a merged report with any known headers."""
    c = {k: find(df.columns, k) for k in ("feature", "ion", "charge", "product_charge", "area", "rt", "batch", "shape", "coeluting", "q")}
    col = lambda k: F.col(f"`{c[k]}`") if c[k] else F.lit(None)
    number = lambda k: (F.expr(f"try_cast(`{c[k]}` AS DOUBLE)") if c[k] else F.lit(None).cast("double")).alias(k)
    ids = [F.coalesce(col(k).cast("string"), F.lit("")) for k in ("ion", "charge", "product_charge")]
    together = F.lower(F.trim(col("coeluting").cast("string"))).isin("true", "1", "yes")
    return df.select(col("feature").alias("feature"), F.concat(ids[0], F.lit("_z"), ids[1], F.lit("_"), ids[2]).alias("transition"), F.col("`Sample ID`").alias("sample"), col("batch").cast("string").alias("batch"), number("area"), number("rt"), number("shape"), together.alias("coeluting"), number("q"), F.monotonically_increasing_id().alias("row"))


def load_metadata(spark: SparkSession, paths: list[str], documents: list[str] | None = None) -> DataFrame:
    """(sample, sample_type, batch[, document]) from csv or tsv files with any known headers.

    Repeated rows count once; conflicting rows of a sample are an error. With
    ``documents``, one label per file, samples of equal names in different files stay
    apart and only conflicts inside a file are errors.
    """
    if documents is not None and len(documents) != len(paths):
        raise ValueError("one document label is needed for each file")
    parts = []
    for i, path in enumerate(paths):
        df = read_report(spark, path)
        name = find(df.columns, "sample") or find(df.columns, "replicate")
        kind, batch = find(df.columns, "sample_type"), find(df.columns, "batch")
        if name is None:
            raise ValueError(f"{path} names no samples")
        known = F.lower(F.trim(F.col(f"`{kind}`").cast("string"))) if kind else F.lit("experimental")
        own = F.when(known.isin("experimental", "qc", "reference", "blank"), known).otherwise(vendor_type(known))
        cells = [F.trim(F.col(f"`{name}`").cast("string")).alias("sample"), own.alias("sample_type"), (F.trim(F.col(f"`{batch}`").cast("string")) if batch else F.lit(None).cast("string")).alias("batch")]
        parts.append(df.select(*cells, *([F.lit(documents[i]).alias("document")] if documents else [])).where("sample <> ''"))
    merged = reduce(DataFrame.unionByName, parts).distinct()
    keys = ["sample", *(["document"] if documents else [])]
    twice = [r["sample"] for r in merged.groupBy(*keys).count().where("count > 1").orderBy("sample").limit(5).collect()]
    if twice:
        raise ValueError(f"samples with conflicting rows: {', '.join(twice)}")
    return merged


def plain_key(name: Column) -> Column:
    """A sample name without file extension, without what follows ``_@_``, and without underscores at its end."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"^(.+)\.[^.]*$", "$1")
    return F.regexp_replace(F.split_part(stem, F.lit("_@_"), F.lit(1)), "_+$", "")


def with_metadata(df: DataFrame, meta: DataFrame, normalised: bool = False) -> DataFrame:
    """Join on the sample id, else on the replicate part of it, else (``normalised``) on the plain key. The sample table has a row per run.

    With a ``document`` column in both, the row of the sample's own document comes
    first. Unknown samples are experimental; a batch of the data stays where the
    metadata has none.
    """
    replicate = F.split_part(F.col("sample"), F.lit("__@__"), F.lit(1))
    keys = [("sample", F.col("sample"), F.col("sample")), ("replicate", replicate, F.col("sample"))]
    if normalised:
        keys.append(("plain", plain_key(replicate), plain_key(F.col("sample"))))
    if "document" in meta.columns and "document" in df.columns:
        both = lambda s: F.concat_ws("\u0001", s, F.col("document"))
        keys.insert(0, ("qualified", both(replicate), both(F.col("sample"))))
    j, kinds, batches = df, [], []
    for name, left, right in keys:
        one = meta.groupBy(right.alias(f"_r_{name}")).agg(F.min_by("sample_type", "sample").alias(f"_t_{name}"), F.min_by("batch", "sample").alias(f"_b_{name}"))
        j = j.withColumn(f"_l_{name}", left).join(one, F.col(f"_l_{name}") == F.col(f"_r_{name}"), "left")
        kinds.append(F.col(f"_t_{name}"))
        batches.append(F.col(f"_b_{name}"))
    own = [F.col("batch")] if "batch" in df.columns else []
    j = j.withColumns({"sample_type": F.coalesce(*kinds, F.lit("experimental")), "batch": F.coalesce(*batches, *own)})
    return j.select(*df.columns, "sample_type", *([] if own else ["batch"]))


def sample_table(df: DataFrame) -> DataFrame:
    """(sample_id, sample, sample_type, batch), one row per sample, in order; the content of ``sample_metadata.csv``."""
    d = df.select("sample", "sample_type", "batch").distinct()
    return d.select(F.col("sample").alias("sample_id"), F.split_part("sample", F.lit("__@__"), F.lit(1)).alias("sample"), "sample_type", "batch").orderBy("sample_id")


def write_unified(df: DataFrame, meta: DataFrame, path: str, by_batch: bool = True) -> None:
    """Rows with their metadata and, where acquisition times are known, the run order inside their batch; by batch folders if asked."""
    out = with_metadata(df, run_order(meta) if "acquired" in meta.columns else meta)
    if "acquired" in meta.columns:
        out = out.join(run_order(meta).select("sample", "run_order"), "sample", "left")
    writer = out.repartition("batch", "sample").write.mode("overwrite").option("compression", "zstd") if by_batch else out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("batch") if by_batch else writer).parquet(path)


def load_unified(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unmatched(df: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of the data without metadata, and of the metadata without data."""
    a, b = df.select("sample").distinct(), meta.select("sample").distinct()
    return a.join(b, "sample", "left_anti"), b.join(a, "sample", "left_anti")


def run_order(meta: DataFrame, time: str = "acquired") -> DataFrame:
    from pyspark.sql import Window

    return meta.withColumn("run_order", F.row_number().over(Window.partitionBy("batch").orderBy(time, "sample")))


def fingerprint(spark: SparkSession, paths: list[str], content: bool = False) -> list[dict]:
    """Path, size, time and (if asked) MD5 of source files on any file system; files are hashed in tasks."""
    out = []
    for path in sorted(paths):
        fs, p = _path(spark, path)
        status = fs.getFileStatus(p)
        entry = {"path": status.getPath().toString(), "size": int(fs.getContentSummary(p).getLength()), "mtime": int(status.getModificationTime()) // 1000}
        if content:
            sums = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
            entry["md5"] = sums.agg(F.md5(F.array_join(F.array_sort(F.collect_list("md5")), ",").cast("binary")).alias("m")).first()["m"] if is_folder(spark, path) else sums.first()["md5"]
        out.append(entry)
    return out


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    return None if not fs.exists(p) else "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_fingerprint(spark: SparkSession, paths: list[str], sidecar: str, content: bool = False) -> None:
    _write_text(spark, sidecar, json.dumps(fingerprint(spark, paths, content), sort_keys=True))


def up_to_date(spark: SparkSession, paths: list[str], sidecar: str) -> bool:
    """Whether the sources are what the sidecar file says."""
    known = _read_text(spark, sidecar)
    if known is None:
        return False
    was = json.loads(known)
    return was == fingerprint(spark, paths, any("md5" in e for e in was))


def write_matrix(wide: DataFrame, path: str, form: str = "parquet") -> None:
    """Feature x sample table as parquet, csv or tsv."""
    if form == "parquet":
        wide.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif form in ("csv", "tsv"):
        wide.write.mode("overwrite").option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
    else:
        raise ValueError(form)


def group_table(groups: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """The groups as exported: 15 columns, every list sorted and joined by semicolons.

    ``named`` (entity, accession, gene, name, description) describes entities; what
    it lacks is an empty cell.
    """
    join = lambda c: F.concat_ws(";", F.array_sort(F.transform(c, lambda x: x.cast("string"))))
    about = ("accession", "gene", "name", "description")
    if named is not None:
        groups = groups.join(named.select(F.col("entity").alias("leader"), *about), "leader", "left")
    told = {c: F.coalesce(F.col(c), F.lit("")) if named is not None else F.lit("") for c in about}
    return groups.select(
        F.col("group_id").alias("GroupID"), F.col("leader").alias("LeadingProtein"), told["accession"].alias("LeadingUniProtID"), told["gene"].alias("LeadingGeneName"), told["name"].alias("LeadingName"), told["description"].alias("LeadingDescription"),
        join("members").alias("MemberProteins"), join("subsumed").alias("SubsumedProteins"), F.col("n_features").alias("NPeptides"), F.col("n_unique").alias("NUniquePeptides"), F.col("n_razor").alias("NRazorPeptides"), F.col("n_all").alias("NAllMappedPeptides"),
        join("unique_features").alias("UniquePeptides"), join("razor_features").alias("RazorPeptides"), join(F.array_union("unique_features", "razor_features")).alias("AllPeptides"))


def read_group_table(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, leader, members, features) of an exported group table."""
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("GroupID").alias("group_id"), F.col("LeadingProtein").alias("leader"), split("MemberProteins").alias("members"), split("AllPeptides").alias("features"))


def consensus_diagnostics(cells: DataFrame) -> DataFrame:
    """Consensus cells by size of residual, largest first."""
    return cells.withColumn("abs_residual", F.abs("residual")).orderBy(F.desc("abs_residual"), "feature", "transition", "sample")


def write_provenance(spark: SparkSession, path: str, config: dict, inputs: list[str], counts: dict, log: list[str]) -> None:
    _write_text(spark, path, json.dumps({"parameters": config, "inputs": fingerprint(spark, inputs), "counts": counts, "steps": log}, indent=2, sort_keys=True))


def read_provenance(spark: SparkSession, path: str) -> dict:
    return json.loads(_read_text(spark, path))["parameters"]


def hash_sample(df: DataFrame, key: str, one_in: int = 10) -> DataFrame:
    """All rows of about one in ``one_in`` keys, the same ones in every table (a sampling operator)."""
    return df.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(one_in)) == 0)
