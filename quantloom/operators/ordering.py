"""Global positions without a window over everything."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch


def sorted_parts(df: DataFrame, *order: str, scratch: Scratch) -> DataFrame:
    """Rows range-partitioned in ``order`` and written once, with their partition ``_p``: what a partition's window
    lacks of the earlier ones is added from one row for each partition."""
    return scratch.table(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "parts")


def numbered(df: DataFrame, *order, within: tuple[str, ...] = (), name: str = "position", scratch: Scratch | None = None) -> DataFrame:
    """Adds the row's place, from 1, in the total order of ``order`` (columns or sort expressions).

    Rows are range-partitioned and sorted; only the partitions' sizes meet in one
    place. The sorted rows are written once, so that places do not change when a
    task is repeated. ``within``: columns whose groups count anew; they must lead
    ``order``. A group may span any number of partitions: only its share of each
    partition is counted, and rows meet these counts by partition and group.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % (1 << 33)})
    rows = (scratch or Scratch(df.sparkSession, "numbered")).table(placed, "sorted")
    if not within:
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
        starts = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        return rows.join(starts, "_p").withColumn(name, F.col("_start") + F.col("_i") + 1).drop("_p", "_i", "_start")
    before = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition that the group touches
    shares = rows.groupBy("_p", *within).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    starts = shares.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    met = (F.col("_p") == F.col("_q")) & reduce(and_, (F.col(c).eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)))
    return rows.join(starts, met).withColumn(name, F.col("_start") + F.col("_i") + 1).drop("_p", "_i", "_q", "_start", *[f"_w{k}" for k in range(len(within))])


#: The quantile sketch may be off by one in so many of a group's values.
ACCURACY = 10_000


def quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q, n): exact quantiles (interpolated between neighbours) of each group, and how many values it has; nulls and NaN do not count.

    For few groups of any length; ``df`` is read twice. Spark's exact percentile holds all values of a group
    in one task. Here a sketch brackets each quantile; then values outside the brackets are only counted,
    and those inside (two in ``ACCURACY`` on each side) keep their counts, which gives the exact places.
    """
    v = F.col(value).cast("double")
    named = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    ends = sorted({min(max(p + d / ACCURACY, 0.0), 1.0) for p in probs for d in (-2, 2)})
    bounds = named.groupBy(*by).agg(F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_e"))
    pairs = [(ends.index(min(max(p - 2 / ACCURACY, 0.0), 1.0)), ends.index(min(max(p + 2 / ACCURACY, 0.0), 1.0))) for p in probs]
    bounds = bounds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_e")
    met = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)), F.lit(True))
    inside = reduce(lambda a, b: a | b, (F.col("_v").between(F.get("_e", i), F.get("_e", j)) for i, j in pairs))
    gap = sum(((F.col("_v") > F.get("_e", i)).cast("int") for i in range(len(ends))), F.lit(0))
    counted = named.join(F.broadcast(bounds), met).groupBy(*by, gap.alias("_gap"), F.when(inside, F.col("_v")).alias("_in")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    before = Window.partitionBy(*by).orderBy("_min")
    counted = counted.withColumns({"_to": F.sum("_c").over(before), "_n": F.sum("_c").over(Window.partitionBy(*by))}).withColumn("_from", F.col("_to") - F.col("_c"))
    lost = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")

    def at(place):
        here = F.when(F.col("_min") == F.col("_max"), F.col("_min")).when(place == F.col("_from"), F.col("_min")).when(place == F.col("_to") - 1, F.col("_max")).otherwise(lost)
        return F.max(F.when((place >= F.col("_from")) & (place < F.col("_to")), here))

    found = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        found += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    got = counted.groupBy(*by).agg(*found, F.max("_n").alias("n"))
    return got.select(*by, F.array(*[F.col(f"_l{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_h{i}") * F.col(f"_w{i}") for i in range(len(probs))]).alias("q"), "n")
