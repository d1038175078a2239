"""A corpus cleaned in five stages: toxicity, near-dedup, substring dedup, decontamination, mixing.

Each stage takes what its predecessor kept and is written as Parquet before the
next one reads it; all but the last return the columns of ``documents``.

Nulls and repeats. Null and empty texts are clean, are near copies of nothing and
keep nothing to cut; null ids are documents of their own, and rows that repeat id
and text count once. Further columns pass through, whatever they are called; of
the columns that mixing adds, those that the documents have already stay theirs.
Without labels, benchmark items or documents a stage keeps what it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import toxicity as tox
from quantloom.llm.decontaminate import decontaminate
from quantloom.llm.mixing import mix_sources
from quantloom.llm.near_dedup import near_duplicates
from quantloom.llm.substring_dedup import substring_dedup
from quantloom.runtime import ship, table
from quantloom.scratch import Scratch

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold; the model learns from all labels."""
    model = tox.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return tox.score_toxicity(docs, model, as_col=score).where(F.col(score) < TOXIC_FROM).drop(score)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents as a written table with a unique number, and its column's name: ids can be null or repeated."""
    row = unused(docs, "_row")
    return Scratch(spark, name).table(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id, null last (five-word shingles, similarity 0.8).

    Texts without words form no groups; of rows that repeat such a text and its id one stays.
    """
    rows, row = numbered(spark, docs, "near_dedup")
    found = near_duplicates(rows, shingle_words=5, percent=80, id_col=row).select(F.col(row).alias("row"), "n_shingles", "component_id")
    wordless = ~F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("text").isNotNull()
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.when(wordless, F.col("text")).alias("blank"))
    repeats = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    groups = ids.join(found.hint("merge"), "row").withColumn("group", F.when(~repeats, F.col("component_id")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    kept = groups.groupBy("group", F.when(repeats, F.col("id")).alias("same"), F.when(repeats, F.col("blank")).alias("blank")).agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept.hint("merge"), row).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that an earlier document has; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substring_dedup(docs, min_words=50, with_text=True, carry=rest)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies) and in how many words (taken)."""
    rows, row = numbered(spark, docs, "mix")
    made = [c for c in ("size", "target", "copies", "taken") if c not in docs.columns]
    plan = mix_sources(rows, row_col=row).where("copies > 0").select(row, *made)
    return rows.join(plan.hint("merge"), row).select(*docs.columns, *made)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Scores, sketches and rounded rates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
