"""Findings of the fourth round."""

from pyspark.sql import functions as F

from quantloom.operators import library, parsimony, rollup
from quantloom.plans import queries_sources


def test_summed_groups_are_the_rolled_matrix(spark):
    """As ``rollup_entities`` sums the group matrix: counts over all samples, groups of one feature as they are, more samples than one row carries."""
    values = spark.createDataFrame([(f, f"S{s:03d}", float(f - 3 + s % 7) if f + s != 12 else None) for f in (1, 2, 3, 4) for s in range(70) if (f + s) % 5 and (f < 4 or s > 65)], "feature int, sample string, x double")
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b"), (9, "b"), (1, "c"), (8, "c")], "feature int, entity string")
    made = parsimony.grouping(edges)
    want = rollup.rollup_entities(parsimony.group_matrix(values, edges, made=made), "sum").collect()
    got = parsimony.summed_groups(values, edges, made=made).collect()
    key = lambda rows: {(r.entity, r["sample"]): (None if r.value is None else round(r.value, 9), r.n_features, r.low_confidence) for r in rows}
    assert {r.entity: r.n_features for r in want} == {"a": 2, "b": 3, "c": 1} and min(r.value for r in want if r.value is not None) < 0
    assert len(got) == len(want) and key(got) == key(want)


def test_a_run_that_sums_writes_no_group_matrix(spark, sf, monkeypatch):
    """Nor tables of cells for it; what later steps do not read is removed."""
    from quantloom import scratch

    seen, gone = {}, set()
    table, remove = scratch.Scratch.table, scratch.Scratch.remove

    def kept(self, df, name="t"):
        seen[name] = out = table(self, df, name)
        return out

    monkeypatch.setattr(scratch.Scratch, "table", kept)
    monkeypatch.setattr(scratch.Scratch, "remove", lambda self, path: (gone.add(path), remove(self, path))[1])
    run, _ = queries_sources.QUERIES["run_reports"]
    run(spark, sf)
    assert "grouped" not in seen and "matrix" not in seen
    assert {seen[n]._scratch_path for n in ("merged", "cells", "raw")} <= gone
    assert seen["sums"].count() == seen["entities"].select("entity").distinct().count()


def test_a_key_stays_in_one_task_when_a_join_turns_to_a_broadcast(spark):
    """The library's sums prove small only as the job runs: adaptive execution then reads the other side as it lies."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "900k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        c = spark.range(60_000, numPartitions=8).select((n % 2000).cast("string").alias("key"), F.concat(F.lit("y"), n % 7).alias("ion"), F.concat(F.lit("S"), n % 3).alias("sample"), (n % 97 + 1.0).alias("area"))
        c = c.groupBy("key", "ion", "sample").agg(F.max("area").alias("area"))
        total = c.groupBy("key").agg(F.sum("area").alias("total"))
        df = c.withColumn("expected", F.lit(2.0)).join(total, "key")
        out = library.library_rollup(df, "least_squares")
        rows = out.collect()
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == len({(r.key, r["sample"]) for r in rows}) == 6000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
