"""Registered queries: name -> callable and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import normalize, qc

from . import binding, queries_groups, queries_learn, queries_more, queries_qc, queries_rollup, queries_sources

Query = Callable[[SparkSession, str], DataFrame]
ALL = queries_rollup.QUERIES | queries_groups.QUERIES | queries_qc.QUERIES | queries_sources.QUERIES | queries_more.QUERIES | queries_learn.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed, median-normalised abundance of each feature and sample, with the CV of its sample type."""
    v = normalize.median_normalize(binding.values(spark, sf_dir)).select("feature", "sample", "sample_type", "x")
    return v.join(qc.feature_cvs(v), ["feature", "sample_type"])


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
