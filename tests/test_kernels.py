"""Iterative kernels against plain numpy, and sources against what was written."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators.kernels import lowess, median_polish
from quantloom.operators.rollup import rollup_median_polish
from quantloom.sources import formats, reports


def polished(x, sweeps=20, tolerance=1e-4):
    """Rows first, then columns, until the residuals' absolute sum settles."""
    r, rows, cols, overall, last = x.copy(), np.zeros(x.shape[0]), np.zeros(x.shape[1]), 0.0, np.inf
    for _ in range(sweeps):
        d = np.nanmedian(r, 1)
        r, rows = r - d[:, None], rows + d
        m = np.median(cols)
        cols, overall = cols - m, overall + m
        d = np.nanmedian(r, 0)
        r, cols = r - d[None, :], cols + d
        m = np.median(rows)
        rows, overall = rows - m, overall + m
        total = np.nansum(np.abs(r))
        if abs(last - total) <= tolerance * total:
            break
        last = total
    return overall, rows, cols, r


def test_median_polish_parts_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(20, 2, (7, 5))
    overall, rows, cols, residual = median_polish(x)
    assert np.allclose(overall + rows[:, None] + cols[None, :] + residual, x)
    additive = np.arange(4.0)[:, None] + np.array([0.0, 3.0, 7.0])[None, :]
    o, r, c, e = median_polish(additive)
    assert np.allclose(e, 0) and np.allclose(np.diff(o + c), [3, 4])
    assert np.allclose(o + c, polished(additive)[0] + polished(additive)[2])


def test_median_polish_frame(spark):
    rows = [("f", f"t{i}", f"s{j}", float(10 + i + 2 * j)) for i in range(4) for j in range(3)]
    m = spark.createDataFrame(rows, "feature string, transition string, sample string, x double")
    got = {r["sample"]: r["value"] for r in rollup_median_polish(m, log_count=False).collect()}
    assert np.allclose(np.diff([got[f"s{j}"] for j in range(3)]), 2)


def test_lowess_follows_a_line_and_ignores_one_outlier():
    x = np.linspace(0, 10, 200)
    y = 3 * x + 1
    assert np.allclose(lowess(x, y), y, atol=1e-6)
    y[100] += 50
    assert abs(lowess(x, y)[90] - (3 * x[90] + 1)) < 0.1


def test_fasta(spark, tmp_path):
    text = ">sp|P1|A_HUMAN Alpha a->b OS=Homo GN=AAA PE=1\nPEPTIDE\nKR\n>sp|P2|B_HUMAN Beta GN=BBB\nMK\n>plain one\nACD\n"
    for name, data in (("a.fasta", text.encode()), ("b.fasta.gz", gzip.compress(text.encode()))):
        (tmp_path / name).write_bytes(data)
        rows = {r.entity: r.sequence for r in formats.read_fasta(spark, str(tmp_path / name)).collect()}
        assert rows == {"P1": "PEPTIDEKR", "P2": "MK", "plain": "ACD"}


def test_merge_of_reports(spark):
    a = spark.createDataFrame([("r1", "P", 1.0)], "`Replicate Name` string, `Peptide Modified Sequence` string, Area double")
    merged = reports.merge_reports([("one", a), ("two", a.withColumn("Area", F.col("Area") * 2))])
    assert merged.count() == 2 and {"Sample ID", "Source Document", "Batch"} <= set(merged.columns)
    assert merged.select("Sample ID").distinct().count() == 2
