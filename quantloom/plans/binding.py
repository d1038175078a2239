"""The driver's tables seen as measurement data.

lineitem is the report (part = feature, line number = transition, supplier modulo
12 = run, extended price = area), part.p_size the retention time, part.p_brand
the entity of a feature. Four runs form a batch: one reference, one qc, two
experimental. For grouping, orders are the entities and the parts on their lines
the features; every third order has a twin with equal features, every other third
order a fragment with the features of its first two lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.rollup import matrix, matrix_rows, rollup_sum, sample_list
from quantloom.runtime import table


def report(spark: SparkSession, sf: str) -> DataFrame:
    run = F.col("l_suppkey") % 12
    kind = F.when(run % 4 == 0, "reference").when(run % 4 == 1, "qc").otherwise("experimental")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("feature"), F.col("l_linenumber").alias("transition"), F.concat(F.lit("S"), F.lpad(run.cast("string"), 2, "0")).alias("sample"),
        F.concat(F.lit("B"), F.floor(run / 4).cast("string")).alias("batch"), kind.alias("sample_type"), F.col("l_extendedprice").alias("area"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark, sf).groupBy("feature", "transition", "sample").agg(F.max("area").alias("area"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark, sf).select("sample", "batch", "sample_type").distinct()


def dense(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return matrix(c, sample_list(c))


def dense_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """The rows of the same matrix, and its samples."""
    c = cells(spark, sf)
    samples = sample_list(c)
    return matrix_rows(c, samples), samples


def values(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, sample, x, rt, batch, sample_type, entity): summed log2 values with attributes."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.col("p_size").cast("double").alias("rt"), F.col("p_brand").alias("entity"))
    v = rollup_sum(dense(spark, sf)).select("feature", "sample", F.col("value").alias("x"))
    return v.join(part, "feature").join(F.broadcast(samples(spark, sf)), "sample")  # one row per run: bounded by the cohort


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, entity) of all lines: orders with their parts, twins and fragments. A part that an order has twice is there twice."""
    key = F.lpad(F.col("l_orderkey").cast("string"), 9, "0")
    twin = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("T"), key))
    part = F.when((F.col("l_orderkey") % 3 == 1) & (F.col("l_linenumber") <= 2), F.concat(F.lit("U"), key))
    names = F.array_compact(F.array(F.concat(F.lit("O"), key), twin, part))
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.explode(names).alias("entity"))


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """The report as an export writes it: its headers, text cells, ``#N/A`` for what was not measured.

    Line 7 is the precursor ion; every 11th order has no area.
    """
    n, run = F.col("l_linenumber"), F.col("l_suppkey") % 12
    ion = F.when(n == 7, "precursor").when(n % 2 == 0, F.concat(F.lit("y"), n)).otherwise(F.concat(F.lit("b"), n))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("#N/A"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("sp|Q"), F.col("l_suppkey"), F.lit("|ENO1_YEAST;P"), F.col("l_partkey") % 7).alias("Protein Accession"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("Peptide Modified Sequence"), ion.alias("Fragment Ion"), (n % 3 + 1).cast("string").alias("Precursor Charge"),
        F.lit("1").alias("Product Charge"), F.concat(F.lit("S"), F.lpad(run.cast("string"), 2, "0")).alias("Replicate Name"),
        text(F.when(F.col("l_orderkey") % 11 > 0, F.col("l_extendedprice"))).alias("Area"), text(F.col("l_tax") * 100).alias("Retention Time"),
        text(F.when(F.col("l_quantity") > 3, 1 - F.col("l_discount") * 8)).alias("Shape Correlation"), F.when(F.col("l_linestatus") == "O", "True").otherwise("False").alias("Coeluting"),
        text(F.when(F.col("l_quantity") > 1, F.col("l_quantity") / 1000)).alias("Detection Q Value"), F.col("l_returnflag").alias("document"))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, charge, mz, start, stop) for density."""
    l = table(spark, sf, "lineitem")
    start = F.round(F.col("l_discount") * 100, 4)
    return l.select(F.col("l_partkey").alias("feature"), F.col("l_linenumber").alias("charge"), F.round(F.col("l_extendedprice") / 100, 4).alias("mz"), start.alias("start"), F.round(start + F.col("l_quantity") / 10, 4).alias("stop"))


#: The same in DuckDB SQL; each name is a CTE that later ones may use.
CTES = {
    "report": "SELECT l_partkey AS feature, l_linenumber AS transition, concat('S', lpad(CAST(l_suppkey % 12 AS VARCHAR), 2, '0')) AS sample, concat('B', CAST((l_suppkey % 12) // 4 AS VARCHAR)) AS batch, CASE WHEN l_suppkey % 12 % 4 = 0 THEN 'reference' WHEN l_suppkey % 12 % 4 = 1 THEN 'qc' ELSE 'experimental' END AS sample_type, l_extendedprice AS area FROM lineitem",
    "cells": "SELECT feature, transition, sample, max(area) AS area FROM report GROUP BY ALL",
    "samples": "SELECT DISTINCT sample, batch, sample_type FROM report",
    "low": "SELECT feature, greatest(0.5 * quantile_cont(area, 0.01), 1.0) AS low FROM cells WHERE area > 0 GROUP BY feature",
    "m": "SELECT t.feature, t.transition, s.sample, log2(CASE WHEN c.area > 0 THEN c.area ELSE coalesce(l.low, 1.0) END) AS x FROM (SELECT DISTINCT feature, transition FROM cells) t CROSS JOIN (SELECT DISTINCT sample FROM cells) s LEFT JOIN cells c ON c.feature = t.feature AND c.transition = t.transition AND c.sample = s.sample LEFT JOIN low l ON l.feature = t.feature",
    "v": "SELECT r.feature, r.sample, r.x, CAST(p.p_size AS DOUBLE) AS rt, p.p_brand AS entity, s.batch, s.sample_type FROM (SELECT feature, sample, log2(greatest(sum(pow(2.0, x)), 1.0)) AS x FROM m GROUP BY ALL) r JOIN part p ON p.p_partkey = r.feature JOIN samples s ON s.sample = r.sample",
    "edges": "SELECT DISTINCT l_partkey AS feature, unnest(list_filter([concat('O', lpad(CAST(l_orderkey AS VARCHAR), 9, '0')), CASE WHEN l_orderkey % 3 = 0 THEN concat('T', lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) END, CASE WHEN l_orderkey % 3 = 1 AND l_linenumber <= 2 THEN concat('U', lpad(CAST(l_orderkey AS VARCHAR), 9, '0')) END], lambda e: e IS NOT NULL)) AS entity FROM lineitem",
    "exported": "SELECT concat('sp|Q', l_suppkey, '|ENO1_YEAST;P', l_partkey % 7) AS accession, concat('P', l_partkey) AS feature, CASE WHEN l_linenumber = 7 THEN 'precursor' WHEN l_linenumber % 2 = 0 THEN concat('y', l_linenumber) ELSE concat('b', l_linenumber) END AS ion, l_linenumber % 3 + 1 AS charge, concat('S', lpad(CAST(l_suppkey % 12 AS VARCHAR), 2, '0')) AS replicate, CASE WHEN l_orderkey % 11 > 0 THEN l_extendedprice END AS area, l_tax * 100 AS rt, CASE WHEN l_quantity > 3 THEN 1 - l_discount * 8 END AS shape, l_linestatus = 'O' AS coeluting, CASE WHEN l_quantity > 1 THEN l_quantity / 1000 END AS q, l_returnflag AS document FROM lineitem",
    "peaks": "SELECT l_partkey AS feature, l_linenumber AS charge, round(l_extendedprice / 100, 4) AS mz, round(l_discount * 100, 4) AS start, round(round(l_discount * 100, 4) + l_quantity / 10, 4) AS stop FROM lineitem",
}
NEEDS = {"report": [], "cells": ["report"], "samples": ["report"], "low": ["cells"], "m": ["low"], "v": ["m", "samples"], "edges": [], "exported": [], "peaks": []}


def with_ctes(sql: str, *names: str, recursive: bool = False, **more: str) -> str:
    """``sql`` after the named CTEs, what they need, and further ones given in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for k in NEEDS[n]:
            add(k)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {sql}" if parts else sql
