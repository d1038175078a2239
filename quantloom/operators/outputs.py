"""Several outputs of one rollup, from one pass and one write.

A rollup knows more than its values: residuals of a polish, the rows that a top-N chose,
the weights of an inverse-variance mean. Each group emits all of it as tagged rows,
which one job writes as Parquet partitioned by tag; readers take a tag's columns and
see only its files.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import once

from .kernels import _spread, matrices, median_polish_stack, sorted_cells
from .rollup import log_variance

#: Columns of each output besides the key, the row and the sample.
FIELDS = {
    "values": ("sample", "value", "uncertainty", "n_rows"),
    "residuals": ("row", "sample", "residual", "row_effect", "residual_mean", "residual_std", "residual_mad", "residual_max_abs"),
    "weights": ("row", "sample", "weight", "n_rows"),
    "selections": ("row", "selection_rank", "selection_method", "n_rows", "n_selected"),
}
_KINDS = {"sample": "string", "value": "double", "uncertainty": "double", "n_rows": "long", "residual": "double", "row_effect": "double", "residual_mean": "double", "residual_std": "double", "residual_mad": "double", "residual_max_abs": "double", "weight": "double", "selection_rank": "long", "selection_method": "string", "n_selected": "long"}


def row_summary(residuals: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, spread, median absolute deviation and largest size of each row's residuals."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        middle = np.nanmedian(residuals, axis=1, keepdims=True)
        return {
            "residual_mean": np.nanmean(residuals, axis=1), "residual_std": np.nanstd(residuals, axis=1),
            "residual_mad": np.nanmedian(np.abs(residuals - middle), axis=1), "residual_max_abs": np.nanmax(np.abs(residuals), axis=1),
        }


def _wide(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot_table(index="row", columns="sample", values="x", aggfunc="first", dropna=False)


#: Rows of one batch of outputs.
BATCH = 1 << 16


def _tagged(output: str, key: pa.Array, row: pa.Array, **columns) -> pa.RecordBatch:
    """A batch of one output: the columns it has, nulls for the others."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    given = {"output": pa.array([output]).take(pa.array(np.zeros(len(key), np.int64))), "key": key, "row": row}
    given |= {c: pa.array(columns[c], kinds[k], from_pandas=True) if c in columns else pa.nulls(len(key), kinds[k]) for c, k in _KINDS.items()}
    return pa.RecordBatch.from_arrays(list(given.values()), list(given))


def polished_batches(batches, log_count: bool):
    """Values and residuals of the matrices in batches of cells (key, row, sample, x) sorted by key; no longer table than a batch is built."""
    for _, keys, names, samples, x, _ in matrices(batches, "key", "row"):
        k_n, r_n, c_n = x.shape
        overall, rows, cols, resid = median_polish_stack(x)
        value = overall[:, None] + cols + (np.log2(r_n) if log_count else 0.0)
        value[np.isnan(x).all(1)] = np.nan
        spread = np.repeat(_spread(resid), c_n)
        for lo in range(0, value.size, BATCH):
            at = np.arange(lo, min(lo + BATCH, value.size))
            yield _tagged("values", keys.take(pa.array(at // c_n)), pa.nulls(len(at), names.type), sample=samples.take(pa.array(at)), value=value.ravel()[at], uncertainty=spread[at], n_rows=np.full(len(at), r_n))
        flat, effects, step = resid.reshape(k_n * r_n, c_n), rows.ravel(), max(1, BATCH // c_n)
        for lo in range(0, len(flat), step):
            part = flat[lo : lo + step]
            seen = row_summary(part)
            r, c = np.nonzero(~np.isnan(part))
            at = lo + r
            yield _tagged("residuals", keys.take(pa.array(at // r_n)), names.take(pa.array(at)), sample=samples.take(pa.array(at // r_n * c_n + c)), residual=part[r, c], row_effect=effects[at], **{n: v[r] for n, v in seen.items()})


def top_rows(wide: pd.DataFrame, n: int, selection: str) -> list[pd.DataFrame]:
    """Mean of the n rows with the highest median (or seen most often); ties keep the smaller row."""
    x = wide.to_numpy(float)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        middle, seen = np.nan_to_num(np.nanmedian(x, axis=1), nan=-np.inf), (~np.isnan(x)).sum(1)
        keys = (-middle, -seen) if selection == "median_abundance" else (-seen, -middle)
        chosen = np.lexsort((np.arange(len(x)), keys[1], keys[0]))[:n]
        value = np.nanmean(x[chosen], axis=0)
    values = pd.DataFrame({"output": "values", "sample": wide.columns, "value": value, "n_rows": len(wide)})
    picks = pd.DataFrame({"output": "selections", "row": wide.index.to_numpy()[chosen], "selection_rank": np.arange(1, len(chosen) + 1), "selection_method": selection, "n_rows": len(wide), "n_selected": len(chosen)})
    return [values, picks]


def rollup_outputs(m: DataFrame, key: str = "entity", row: str = "feature", method: str = "median_polish", n: int = 3, selection: str = "median_abundance", log_count: bool = False, samples: list[str] | None = None, **variance) -> DataFrame:
    """Tagged rows (output, key, row, and the columns of all outputs) of one method: median_polish, topn or quality_weighted.

    ``m`` are long cells or, for quality_weighted with ``samples``, the rows of ``rollup.matrix_rows``, of which a task
    sorts one for each row of the matrix, not one for each cell.
    """
    if samples is not None and method != "quality_weighted":
        raise ValueError(f"{method} takes long cells")
    cells = ["sample", "x"] if samples is None else ["xs"]
    named = m.select(F.col(key).alias("key"), F.col(row).alias("row"), *cells, *[c for c in ("shape", "coeluting") if samples is None and c in m.columns])
    schema = f"output string, key {named.schema['key'].dataType.simpleString()}, row {named.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in _KINDS.items())
    columns = ["output", "key", "row", *_KINDS]
    if method == "quality_weighted":
        return _weighted_outputs(named, variance, samples).select(*[F.col(c) if c in ("output", "key", "row", "sample", "value", "uncertainty", "n_rows", "weight") else F.lit(None).cast(_KINDS[c]).alias(c) for c in columns])
    if method not in ("median_polish", "topn"):
        raise ValueError(f"no further outputs of {method}")

    number = [c for c, k in _KINDS.items() if k == "double"]
    if method == "median_polish":
        out = sorted_cells(named, "key", "row", "sample", "x").mapInArrow(lambda batches: polished_batches(batches, log_count), schema)
        return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in number})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.concat(top_rows(_wide(pdf), n, selection)).assign(key=pdf["key"].iloc[0]).reindex(columns=columns)
        return rows.astype({c: object for c in ("output", "key", "row", "sample", "selection_method")})

    out = named.groupBy("key").applyInPandas(one, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in number})


def _weighted_outputs(named: DataFrame, variance: dict, samples: list[str] | None = None, max_ratio: float = 100.0) -> DataFrame:
    """Values and weights of an inverse-variance mean: one aggregation by key and sample, whose row unfolds into both.

    With ``samples`` it is one by key, which unfolds into the samples first.
    """
    if samples is None:
        options = {c: F.col(c) for c in ("shape", "coeluting") if c in named.columns} | variance
        v = named.where(F.col("x").isNotNull()).withColumn("v", log_variance(F.pow(F.lit(2.0), F.col("x")), **options))
        sets = v.groupBy("key", "sample").agg(F.array_sort(F.collect_list(F.struct("row", "x", "v"))).alias("p"), F.min("v").alias("least"))
    else:
        keys = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("row", "xs"))).alias("m"))
        keys = keys.select("key", "m", F.posexplode(F.array(*map(F.lit, samples)).cast("array<string>")).alias("i", "sample")).where(F.exists("m", lambda r: F.get(r["xs"], F.col("i")).isNotNull()))
        seen = F.filter(F.transform("m", lambda r: F.struct(r["row"].alias("row"), F.get(r["xs"], F.col("i")).alias("x"))), lambda r: r["x"].isNotNull())
        p = F.transform(seen, lambda r: r.withField("v", log_variance(F.pow(F.lit(2.0), r["x"]), **variance)))
        sets = keys.select("key", "sample", once(p, lambda p: F.struct(p.alias("p"), F.array_min(F.transform(p, lambda r: r["v"])).alias("least"))).alias("s")).select("key", "sample", "s.p", "s.least")
    sets = sets.withColumn("p", F.transform("p", lambda r: F.struct(r["row"].alias("row"), r["x"].alias("x"), (1 / F.least(r["v"], max_ratio * F.col("least"))).alias("w"))))
    sets = sets.withColumns({"all": F.aggregate("p", F.lit(0.0), lambda s, r: s + r["w"]), "sum": F.aggregate("p", F.lit(0.0), lambda s, r: s + r["w"] * r["x"]), "n_rows": F.size("p").cast("long")})
    none = F.lit(None).cast(named.schema["row"].dataType)
    value = F.struct(F.lit("values").alias("output"), none.alias("row"), (F.col("sum") / F.col("all")).alias("value"), F.sqrt(1 / F.col("all")).alias("uncertainty"), F.lit(None).cast("double").alias("weight"))
    null = F.lit(None).cast("double")
    weights = F.transform("p", lambda r: F.struct(F.lit("weights").alias("output"), r["row"].alias("row"), null.alias("value"), null.alias("uncertainty"), (r["w"] / F.col("all")).alias("weight")))
    return sets.select("key", "sample", "n_rows", F.explode(F.concat(F.array(value), weights)).alias("o")).select("key", "sample", "n_rows", "o.*")


def write_outputs(rows: DataFrame, path: str) -> None:
    """One job for all outputs: a folder a tag. A task has a writer for each tag, so that it need not sort its rows by tag."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(len(FIELDS)))
    try:
        rows.write.partitionBy("output").parquet(path)
    finally:
        conf.set(name, before)


def read_output(spark: SparkSession, path: str, output: str, key: str = "entity", row: str = "feature") -> DataFrame:
    """One output by name; only its folder is read."""
    got = spark.read.parquet(path).where(F.col("output") == output)
    return got.select(F.col("key").alias(key), *[F.col(c).alias(row if c == "row" else c) for c in FIELDS[output]])
