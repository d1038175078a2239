"""A bounded sample of labelled texts, by a threshold on hashes of ids: no sort, no limit, the same rows every time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRID = 1 << 40


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], salt: str, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """((text, y, fold), counts): one text of each sampled (id, label); counts are of the whole label table.

    Of each label at most ``most`` ids are taken (all if there are no more; else
    that many less four standard deviations are expected, so that chance does not
    go beyond). Repeated labels of an id count once, and of several texts of one id
    the one with the smallest hash is taken, so no id can swell the sample. ``fold``
    is 0, 1 or 2.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL").distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        p = 1.0 if n <= most[y] else max(1.0, most[y] - 4 * math.sqrt(most[y])) / n
        share = F.when(F.col("y") == y, F.lit(p)).otherwise(share)
    rank = F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(_GRID))
    chosen = known.where(rank < share * _GRID).withColumn("fold", F.pmod(F.xxhash64(F.col("id"), F.lit(f"{salt} fold")), F.lit(3)).cast("int"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # ``most`` ids at most, so texts stay where they are
    return found.groupBy("id", "y", "fold").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("text", "y", "fold"), counts
