"""Joins that Spark would plan as nested loops, rewritten as equi-joins on buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from .ordering import sorted_parts

#: 64-bit words of the bit set that tells which pieces of a length may begin a needle: 256 KiB.
FILTER_WORDS = 1 << 15
#: Lengths that seeds may have; letters of a text's block; letters that a piece carries.
SEEDS, BLOCK, NEAR = (1, 2, 3, 4, 6, 8, 12, 16), 1024, 64


def range_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows with lo <= point < hi. Intervals are dealt to every bucket of ``width`` that they touch; points to one.

    Choose the width near a typical interval: wider makes buckets fuller, narrower
    repeats intervals.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    spread = intervals.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(b(lo), b(hi))))
    return points.withColumn("_b", b(point)).join(spread, "_b").where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_b")


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of closed intervals that overlap; each pair is found once, in the first bucket that both touch."""
    f = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    x = a.withColumn("_b", F.explode(F.sequence(f(a_range[0]), f(a_range[1]))))
    y = b.withColumn("_b", F.explode(F.sequence(f(b_range[0]), f(b_range[1]))))
    first = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / F.lit(float(width)))
    meet = (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(b_range[0]) <= F.col(a_range[1]))
    return x.join(y, "_b").where(meet & (F.col("_b") == first)).drop("_b")


def range_counts(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str) -> DataFrame:
    """``intervals`` with ``n``, the number of points lo <= point < hi, from running counts over the sorted values: no pair is made."""
    marks = intervals.select(F.explode(F.array(F.col(lo).cast("double"), F.col(hi).cast("double"))).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumns({"_side": F.lit(0), "_c": F.lit(0).cast("long")})
    seen = points.select(F.col(point).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count("*").alias("_c")).select("_v", F.lit(1).alias("_side"), "_c")
    rows = sorted_parts(marks.unionByName(seen), "_v", "_side", scratch=Scratch(points.sparkSession, "ranges"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = rows.groupBy("_p").agg(F.sum("_c").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    here = F.sum("_c").over(Window.partitionBy("_p").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = rows.withColumn("_here", here).where("_side = 0").join(F.broadcast(starts), "_p").select("_v", (F.col("_start") + F.col("_here")).alias("_below"))
    at = lambda c, n: below.select(F.col("_v").alias(c), F.col("_below").alias(n))
    wide = intervals.withColumns({"_lo": F.col(lo).cast("double"), "_hi": F.col(hi).cast("double")})
    return wide.join(at("_lo", "_a"), "_lo", "left").join(at("_hi", "_b"), "_hi", "left").select(*intervals.columns, F.greatest(F.coalesce(F.col("_b") - F.col("_a"), F.lit(0)), F.lit(0)).alias("n"))


def nearest_within(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, keys: list[str], row: list[str], keep: list[str], digits: int | None = None) -> DataFrame:
    """Each left row (identified by ``row``) with the nearest right row within the tolerance, else nulls.

    Equal distances (with ``digits``: when rounded) take the smaller value, equal values the least ``keep``,
    which names the right columns returned. Both sides' distinct values are sorted together; a left
    value's neighbours are the last right value before it and the first one after it, so no pairs are made.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    held = right.where(real(right_value)).groupBy(*keys, F.col(right_value).alias("_v")).agg(F.min(F.struct(*keep)).alias("_k"))
    held = held.select(*keys, F.col("_v").cast("double").alias("_v"), F.struct(F.col("_v").alias("v"), F.col("_k").alias("k")).alias("_r"))
    asked = left.where(real(left_value)).select(*keys, F.col(left_value).cast("double").alias("_v")).distinct().withColumn("_r", F.lit(None).cast(held.schema["_r"].dataType))
    rows = sorted_parts(held.unionByName(asked), *keys, "_v", scratch=Scratch(left.sparkSession, "nearest"))
    parts = rows.groupBy("_p", *keys).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_v"))).alias("_first"), F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_v"))).alias("_last"))
    ahead = lambda c, *order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_p", *keys, ahead("_last", "_p").alias("_earlier"), ahead("_first", F.desc("_p")).alias("_later"))  # as many rows as keys meet partitions
    near = lambda *order: F.last("_r", ignorenulls=True).over(Window.partitionBy("_p", *keys).orderBy(*order))
    met = rows.withColumns({"_before": near("_v"), "_after": near(F.desc("_v"))}).where("_r IS NULL").join(parts, ["_p", *keys])
    met = met.select(*keys, "_v", F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))
    exact = lambda c: F.abs(F.col("_v") - F.col(c)["v"])
    gap = lambda c: exact(c) if digits is None else F.round(exact(c), digits)
    inside = [F.when(exact(c) <= tolerance, F.struct(gap(c).alias("g"), F.col(c)["v"].alias("v"), F.col(c).alias("r"))) for c in ("_before", "_after")]
    best = met.select(*keys, F.col("_v").alias("_x"), F.least(*inside)["r"].alias("_m"))
    joined = left.withColumn("_x", F.col(left_value).cast("double")).join(best, [*keys, "_x"], "left")
    return joined.select(*left.columns, F.col("_m.v").alias(right_value), *[F.col(f"_m.k.{c}").alias(c) for c in keep])


def keyed_fallback(left: DataFrame, tables: list[tuple[DataFrame, Column | str, str]], value: str) -> DataFrame:
    """First hit over several keys: each (lookup, expression of left's key, lookup key) is tried in turn."""
    df = left
    for i, (lookup, expr, key) in enumerate(tables):
        one = lookup.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        df = df.withColumn(f"_e{i}", F.expr(expr) if isinstance(expr, str) else expr).join(one, F.col(f"_e{i}") == F.col(f"_k{i}"), "left")
    return df.select(*left.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tables))]).alias(value))


def substring_join(needles: DataFrame, haystack: DataFrame, needle: str, text: str, key: list[str]) -> DataFrame:
    """(needle, key..., at): every place (from 1) of every needle in the texts of ``haystack``, named by ``key``.

    Needles fall into length classes, each with its own seed length (the longest of
    ``SEEDS`` that its needles have); a class of short needles does not shorten the
    seeds of the others. Texts are taken in blocks of ``BLOCK`` letters. A place
    becomes a row only if its piece may be a seed: the seeds of a length are a hashed
    bit set of fixed size, which is broadcast. Pieces carry the key and the ``NEAR``
    letters from the place on, in which most needles are confirmed; longer needles are
    compared with the text in full.
    """
    wanted = needles.select(F.col(needle).alias("_w")).where(F.length("_w") > 0).distinct()
    size = reduce(lambda c, k: F.when(F.length("_w") >= k, k).otherwise(c), SEEDS[1:], F.lit(SEEDS[0]))
    wanted = wanted.withColumn("_k", size).withColumn("_piece", F.expr("substring(_w, 1, _k)"))
    bit, word = "pmod(xxhash64({p}), 64)", f"CAST(pmod(xxhash64({{p}}), {FILTER_WORDS * 64}) div 64 AS INT)"
    mask = f"shiftleft(1L, CAST({bit} AS INT))"
    words = wanted.groupBy("_k", F.expr(word.format(p="_piece")).alias("_i")).agg(F.bit_or(F.expr(mask.format(p="_piece"))).alias("_b"))
    filters = words.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_b"))).alias("_m"))
    filters = filters.select("_k", F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_f"))
    texts = haystack.select(*key, F.col(text).alias("_t")).where(F.length(text) > 0)
    blocks = texts.withColumn("_start", F.explode(F.expr(f"sequence(1, length(_t), {BLOCK})"))).select(*key, "_start", F.expr(f"substring(_t, _start, {BLOCK + NEAR - 1})").alias("_t"))
    rows = blocks.join(F.broadcast(filters), F.length("_t") >= F.col("_k"))  # a row for each seed length: as many as SEEDS at most
    held = f"filter(transform(sequence(1, least({BLOCK}, length(_t) - _k + 1)), i -> named_struct('at', i, 'p', substring(_t, i, _k))), s -> (element_at(_f, {word.format(p='s.p')} + 1) & {mask.format(p='s.p')}) <> 0)"
    pieces = rows.select(*key, "_k", "_start", "_t", F.explode(F.expr(held)).alias("_s"))
    pieces = pieces.select(*key, "_k", (F.col("_start") + F.col("_s.at") - 1).alias("at"), F.col("_s.p").alias("_piece"), F.expr(f"substring(_t, _s.at, {NEAR})").alias("_near"))
    met = pieces.join(wanted, ["_k", "_piece"]).where(f"startswith(_near, substring(_w, 1, {NEAR}))").select("_w", *key, "at")
    short = met.where(F.length("_w") <= NEAR)
    long = met.where(F.length("_w") > NEAR).join(haystack.select(*key, F.col(text).alias("_t")), key).where("substring(_t, at, length(_w)) = _w").select("_w", *key, "at")
    return short.unionByName(long).withColumnRenamed("_w", needle)
