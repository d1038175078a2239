"""Dynamic range, precursor density over mass and time, isolation schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quantloom.functions.columns import once

from .joins import range_join
from .ordering import numbered

#: The default scheme: number of windows, first start, step, width.
DEFAULT_SCHEME = (167, 400.4319, 3.001365, 3.001364)


def dynamic_range(df: DataFrame, key: str = "entity") -> DataFrame:
    """Mean of positive linear values, its log10 and its rank (1 is the most abundant; ties by name)."""
    v = F.when(F.col("value") > 0, F.col("value"))
    s = df.groupBy(key).agg(F.avg(v).alias("mean")).where("mean IS NOT NULL").withColumn("log10", F.log10("mean"))
    return numbered(s, F.desc("mean"), F.col(key), name="rank")


def sample_columns(df: DataFrame, metadata: list[str]) -> list[str]:
    """Columns of a wide matrix that hold samples: numeric and not among the metadata names (any case)."""
    known = {c.lower() for c in metadata}
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name.lower() not in known]


def split_groups(value: Column) -> Column:
    """Array of the trimmed, not blank parts of a ``;``-joined cell; empty for null or blank."""
    parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def first_group(value: Column) -> Column:
    """The trimmed first part that is not empty; null if that is blank."""
    return F.nullif(F.trim(F.get(F.filter(F.split(value, ";"), lambda p: p != ""), 0)), F.lit(""))


def identities(df: DataFrame) -> DataFrame:
    """Adds label, accession, gene and protein of a matrix row: the gene, else the accession, else the name is shown.

    Of the columns leading_name, leading_protein, protein_group, leading_uniprot_id
    and leading_gene_name those that exist are used.
    """
    have = lambda *cs: F.coalesce(*[first_group(F.col(c)) for c in cs if c in df.columns], F.lit(None).cast("string"))
    name = have("leading_name", "leading_protein", "protein_group")
    accession, gene = have("leading_uniprot_id", "leading_protein"), have("leading_gene_name")
    return df.withColumns({"accession": accession, "gene": gene, "protein": name}).withColumn("label", F.coalesce("gene", "accession", "protein"))


def match_lists(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(entry, list): the first list (by priority) that holds one of an entry's tokens.

    Tokens are the ``;``-separated names, also without isoform (``-2``) and species
    (``_YEAST``) suffixes, in upper case.
    """
    t = entries.select("entry", F.explode(F.split("entry", ";")).alias("t")).withColumn("t", F.upper(F.trim("t")))
    forms = F.array_distinct(F.array(F.col("t"), F.regexp_replace("t", r"-\d+$", ""), F.regexp_replace("t", r"_[A-Z0-9]+$", "")))
    t = t.select("entry", F.explode(forms).alias("t")).where("t <> ''")
    hit = t.join(lists.select(F.upper(F.trim("member")).alias("t"), "list", "priority"), "t")
    return hit.groupBy("entry").agg(F.min_by("list", F.struct("priority", "list")).alias("list"))


def precursors(df: DataFrame, max_q: float | None = None) -> DataFrame:
    """One row per (feature, charge, mz) with the widest time span; only finite and ordered spans; q values cut if asked."""
    d = df
    if max_q is not None:
        d = d.where(F.expr("try_cast(q AS DOUBLE)") <= max_q)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = d.where(finite("mz") & finite("start") & finite("stop") & (F.col("stop") >= F.col("start")))
    return d.groupBy("feature", "charge", "mz").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def spans_to_counts(df: DataFrame, keys: list[str], rt_lo: float, width: float, n_bins: int) -> DataFrame:
    """(keys, rt_bin, n): in how many spans [start, stop] of its key each time bin lies, where in any.

    Every span is one step up and one step down; running sums per key over the bins
    where something changes give the counts, so the work does not grow with the
    length of spans.
    """
    at = lambda c: F.greatest(F.least(F.floor((F.col(c) - rt_lo) / width), F.lit(n_bins - 1)), F.lit(0)).cast("int")
    steps = df.select(*keys, F.explode(F.array(F.struct(at("start").alias("rt_bin"), F.lit(1).alias("d")), F.struct((at("stop") + 1).alias("rt_bin"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*keys, F.col("s.rt_bin").alias("rt_bin")).agg(F.sum("s.d").alias("d"))
    by = Window.partitionBy(*keys).orderBy("rt_bin")  # at most n_bins + 1 rows a key
    runs = steps.withColumns({"n": F.sum("d").over(by), "_next": F.lead("rt_bin").over(by)}).where("n > 0")
    return runs.withColumn("rt_bin", F.explode(F.sequence(F.col("rt_bin"), F.col("_next") - 1))).select(*keys, "rt_bin", "n")


def grid_width(lo: float, hi: float, width: float, most: int = 4000) -> tuple[float, int]:
    """Bin width and count; bins grow until ``most`` are enough."""
    n = max(1, int((hi - lo) / width) + 1)
    return (width, n) if n <= most else ((hi - lo) / most or 1.0, most)


def uniform_density(df: DataFrame, mz_width: float = 2.0, rt_width: float = 0.1) -> DataFrame:
    """(mz_bin, rt_bin, n): each precursor counts in every time bin that its peak spans."""
    row = df.agg(F.min("mz"), F.max("mz"), F.min("start"), F.max("stop")).first()
    if row[0] is None:
        return df.sparkSession.createDataFrame([], "mz_bin int, rt_bin int, n long")
    mz_w, mz_n = grid_width(row[0], row[1], mz_width)
    rt_w, rt_n = grid_width(row[2], row[3], rt_width)
    mz_bin = F.greatest(F.least(F.floor((F.col("mz") - row[0]) / mz_w), F.lit(mz_n - 1)), F.lit(0)).cast("int")
    return spans_to_counts(df.withColumn("mz_bin", mz_bin), ["mz_bin"], row[2], rt_w, rt_n)


def default_scheme(spark, n: int = DEFAULT_SCHEME[0], start: float = DEFAULT_SCHEME[1], step: float = DEFAULT_SCHEME[2], width: float = DEFAULT_SCHEME[3]) -> DataFrame:
    """(window, lo, hi, rt_lo, rt_hi) of equally spaced windows that are always on."""
    none = F.lit(None).cast("double")
    return spark.range(n).select(F.col("id").cast("int").alias("window"), (F.lit(start) + F.col("id") * step).alias("lo"), (F.lit(start) + F.col("id") * step + width).alias("hi"), none.alias("rt_lo"), none.alias("rt_hi"))


def covering(df: DataFrame, scheme: DataFrame, width: float = 4.0) -> DataFrame:
    """Precursors with every window that covers their m/z and is on while they elute."""
    j = range_join(df, scheme, "mz", "lo", "hi", width)
    return j.where("(rt_hi IS NULL OR start <= rt_hi) AND (rt_lo IS NULL OR stop >= rt_lo)")


def scheme_density(df: DataFrame, scheme: DataFrame, rt_width: float = 0.1) -> DataFrame:
    """(window, rt_bin, n) over covering windows, only in time bins in which the window is on."""
    row = df.agg(F.min("start"), F.max("stop")).first()
    if row[0] is None:
        return df.sparkSession.createDataFrame([], "window int, rt_bin int, n long")
    w, n = grid_width(row[0], row[1], rt_width)
    c = spans_to_counts(covering(df, scheme), ["window", "rt_lo", "rt_hi"], row[0], w, n)
    lo, hi = row[0] + F.col("rt_bin") * w, row[0] + (F.col("rt_bin") + 1) * w
    on = (F.col("rt_lo").isNull() | (hi > F.col("rt_lo"))) & (F.col("rt_hi").isNull() | (lo < F.col("rt_hi")))
    return c.where(on).select("window", "rt_bin", "n")


def coverage(df: DataFrame, scheme: DataFrame) -> DataFrame:
    """One row: precursors, covered ones, share."""
    keyed = df.withColumn("_id", F.monotonically_increasing_id())
    inside = covering(keyed, scheme).select("_id").distinct().agg(F.count("*").alias("covered"))
    return df.agg(F.count("*").alias("total")).join(inside, F.lit(True)).withColumn("share", F.try_divide(F.col("covered"), F.col("total")))


def load_histogram(density: DataFrame, n_windows: int, n_rt: int) -> DataFrame:
    """(load, cells): how many acquired cells hold how many precursors; empty cells count as load 0."""
    seen = density.groupBy(F.col("n").alias("load")).agg(F.count("*").alias("cells"))
    empty = density.agg((F.lit(n_windows * n_rt) - F.count("*")).alias("cells")).select(F.lit(0).cast("long").alias("load"), "cells")
    return seen.unionByName(empty.where("cells > 0"))


def load_over_time(density: DataFrame, n_windows: int) -> DataFrame:
    """(rt_bin, mean, low, high) over all windows, empty ones included."""
    s = density.groupBy("rt_bin").agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("high"), F.count("*").alias("used"))
    return s.select("rt_bin", (F.col("total") / n_windows).alias("mean"), F.when(F.col("used") < n_windows, 0).otherwise(F.col("least")).alias("low"), "high")


def display_grid(scheme: DataFrame, rows: int, lo: float, hi: float) -> DataFrame:
    """(row, window): the narrowest window that covers the centre of each display row.

    No pair of row and window is made: the run of rows that a window covers is two blocks of 2^k rows, which
    overlap. Each block keeps its narrowest window, so what is left depends on the display, not on the scheme.
    """
    step = (hi - lo) / rows
    centre = lambda i: F.lit(lo) + (i + 0.5) * step
    bounded = lambda i, least: F.greatest(F.least(i, F.lit(rows)), F.lit(least)).cast("long")

    def first(edge: Column) -> Column:
        """The first row whose centre is not below the edge; its neighbours' centres are compared, as the estimate is rounded."""
        guess = bounded(F.floor((edge - lo) / step - 0.5), -1)
        return once(guess, lambda g: bounded(g - 1 + sum(((centre(g + d) < edge).cast("long") for d in (-1, 0, 1)), F.lit(0)), 0))

    def cut(edges: Column) -> Column:
        a, b = edges[0], edges[1]
        two = lambda size: F.array_distinct(F.array(F.struct(a.alias("a"), size.alias("size")), F.struct((b - size).alias("a"), size.alias("size"))))
        size = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(b - a)) - 1)  # the largest power of two that is not longer than the run
        return F.when(a < b, once(size, two))

    edges = F.transform(F.array(F.col("lo").cast("double"), F.col("hi").cast("double")), first)
    blocks = scheme.where(F.col("hi") > F.col("lo")).select("window", (F.col("hi") - F.col("lo")).alias("width"), F.explode(once(edges, cut)).alias("_k")).select("window", "width", "_k.a", "_k.size")

    def narrowest(df: DataFrame, *key: str) -> DataFrame:
        """The smallest window of the least width: two aggregations of plain numbers, which are hashed and not sorted."""
        least = df.groupBy(*key).agg(F.min("width").alias("width"))
        return df.join(F.broadcast(least), [*key, "width"]).groupBy(*key, "width").agg(F.min("window").alias("window"))  # at most 2 * rows * log2(rows) keys

    covered = narrowest(blocks, "a", "size").withColumn("row", F.explode(F.expr("sequence(a, a + size - 1)")))
    return narrowest(covered, "row").select(F.col("row").cast("int").alias("row"), "window")
