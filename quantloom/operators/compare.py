"""Comparison of two rollups of the same features by their CVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qc import feature_cvs

CRITERIA = ("most_improved", "most_worsened", "highest_cv", "largest_difference")


def ranking_score(cv_a: Column, cv_b: Column, criterion: str = "most_improved") -> Column:
    """Higher ranks first; an undefined score is minus infinity. a is the baseline, b the other method."""
    score = {"most_improved": cv_a - cv_b, "most_worsened": cv_b - cv_a, "highest_cv": F.greatest(cv_a, cv_b), "largest_difference": F.abs(cv_a - cv_b)}[criterion]
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float("-inf")))


def compare_cvs(a: DataFrame, b: DataFrame, sample_type: str | None = None) -> DataFrame:
    """(feature, cv_a, cv_b, difference) of two long tables (feature, sample, sample_type, x)."""
    pick = (lambda d: d.where(F.col("sample_type") == sample_type)) if sample_type else (lambda d: d)
    cvs = [feature_cvs(pick(d), []).withColumnRenamed("cv", f"cv_{n}") for d, n in ((a, "a"), (b, "b"))]
    return cvs[0].join(cvs[1], "feature").withColumn("difference", F.col("cv_b") - F.col("cv_a"))


def top(pairs: DataFrame, criterion: str = "most_improved", n: int = 20, digits: int | None = None) -> DataFrame:
    """The first n by score, then feature. With ``digits`` scores that agree when rounded are equal: rounding noise does not order features."""
    score = ranking_score(F.col("cv_a"), F.col("cv_b"), criterion)
    scored = pairs.withColumn("score", score if digits is None else F.round(score, digits))
    return scored.orderBy(F.desc("score"), "feature").limit(n)


def summary(pairs: DataFrame, slack: float = 0.01) -> DataFrame:
    """One row: features, improved, worsened and unchanged beyond ``slack``, median CVs."""
    n = lambda c: F.sum(c.cast("long"))
    d = F.col("difference")
    return pairs.agg(F.count("*").alias("features"), n(d < -slack).alias("improved"), n(d > slack).alias("worsened"), n(F.abs(d) <= slack).alias("unchanged"), F.median("cv_a").alias("median_a"), F.median("cv_b").alias("median_b"))
