"""Incremental ingest and event-time sessions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema, form: str = "parquet") -> int:
    """Append the files that arrived since the last call to ``target``; each file is taken once. Returns the rows of target."""
    stream = spark.readStream.format(form).schema(schema)
    if form == "csv":
        stream = stream.option("header", True)
    rows = stream.load(source).withColumn("Source Document", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.\w+)*$", 1))
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).count()


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts", late: str | None = None) -> DataFrame:
    """(key, start, stop, n, total): runs of events closer than ``gap``. ``late`` sets a watermark for streams."""
    e = events.withWatermark(time, late) if late else events
    s = e.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sessions_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema, gap: str = "30 minutes", late: str = "2 hours") -> None:
    """Sessions of a file stream, appended once the watermark has passed them."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = sessions(rows, gap, late=late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, time: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
