"""Spectral-library support: keys, ion labels, matching, fits, isotope patterns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import nearest_within
from .kernels import _middle, matrices, repeated, sorted_cells
from .sequence import strip_modifications


def library_key(peptide: Column, charge: Column, collapse: bool = False) -> Column:
    """``sequence_charge``; with ``collapse`` L is read as I."""
    return F.concat_ws("_", F.translate(peptide, "L", "I") if collapse else peptide, charge.cast("string"))


def stripped_key(peptide: Column, charge: Column) -> Column:
    return library_key(strip_modifications(peptide), charge)


def parse_ion(label: Column) -> Column:
    """struct(kind, number, charge, loss) of labels such as y7, b3^2, y5++ or b4-H2O; null if it is none."""
    number = F.regexp_extract(label, r"^[abcxyz](\d+)", 1)
    caret = F.regexp_extract(label, r"\^(\d+)", 1)
    plus = F.length(F.regexp_replace(label, r"[^+]", ""))
    charge = F.when(caret != "", caret.try_cast("int")).when(plus > 0, plus).otherwise(1)
    loss = F.regexp_extract(label, r"^[abcxyz]\d+(?:\^\d+)?\+*-([A-Za-z0-9]+)", 1)
    return F.when(number != "", F.struct(F.substring(label, 1, 1).alias("kind"), number.try_cast("int").alias("number"), charge.cast("int").alias("charge"), F.nullif(loss, F.lit("")).alias("loss")))


def match_fragments(observed: DataFrame, library: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Add ``expected``: the library intensity of the same ion of the same key, else of the nearest m/z within the tolerance."""
    by_ion = library.groupBy("key", "ion").agg(F.max("intensity").alias("_exact"))
    exact = observed.join(by_ion, ["key", "ion"], "left")
    near = nearest_within(observed.select("key", "ion", "mz").distinct(), library.select("key", F.col("mz").alias("lib_mz"), "intensity"), "mz", "lib_mz", tolerance, ["key"], ["key", "ion", "mz"], ["intensity"], digits=8)
    out = exact.join(near.select("key", "ion", "mz", F.col("intensity").alias("_near")), ["key", "ion", "mz"], "left")
    return out.withColumn("expected", F.coalesce("_exact", "_near")).drop("_exact", "_near")


def least_squares(df: DataFrame) -> DataFrame:
    """(key, sample, scale, r2): one-pass fit of observed areas to expected ones, not below 0. An aggregation."""
    o, e = F.coalesce("area", F.lit(0.0)), F.col("expected")
    s = df.where("expected > 0").groupBy("key", "sample").agg(F.sum(o * e).alias("oe"), F.sum(e * e).alias("ee"), F.sum(o * o).alias("oo"), F.count("*").alias("n"))
    scale = F.greatest(F.col("oe") / F.col("ee"), F.lit(0.0))
    rest = F.col("oo") - 2 * scale * F.col("oe") + scale * scale * F.col("ee")
    return s.select("key", "sample", "n", scale.alias("scale"), F.when(F.col("oo") > 0, 1 - rest / F.col("oo")).alias("r2"))


def fit_stack(observed: np.ndarray, expected: np.ndarray, method: str = "median_polish", least: int = 3, limit: float = 1.0, rounds: int = 5, trim: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, R2 and used fragments of every sample of many precursors (precursor, fragment, sample) at once.

    Interference only adds, so each round drops, in each sample, the one fragment
    that lies furthest above its prediction by more than ``limit`` times it, while
    more than ``least`` are left. ``median_polish`` sees positive cells only,
    ``least_squares`` takes missing ones as 0. R2 is about the mean of the used
    cells, 0 where these do not vary (by more than rounding).
    """
    fitted = expected > 0
    obs = np.where(np.isfinite(observed), observed, 0.0)
    use = fitted[:, :, None] & (obs > 0) if method == "median_polish" else np.repeat(fitted[:, :, None], obs.shape[2], axis=2)
    lib = np.where(fitted, expected, 1.0)[:, :, None]
    for step in range(rounds + 1):
        if method == "median_polish":
            ratio = np.where(use, np.log(np.where(use, obs, 1.0)) - np.log(lib), np.nan)
            scale = np.where(use.any(1), np.exp(_middle(ratio, 1)), np.nan)
        else:
            bottom = (use * lib**2).sum(1)
            scale = np.where(bottom > 0, np.maximum((np.where(use, obs, 0) * lib).sum(1) / np.where(bottom > 0, bottom, 1), 0), 0.0)
        if not trim or step == rounds or not use.shape[1]:
            break
        predicted = lib * np.nan_to_num(scale)[:, None, :]
        excess = np.where(use & (predicted > 0), (obs - predicted) / np.where(predicted > 0, predicted, 1), -np.inf)
        worst = excess.argmax(1)
        k, c = np.nonzero((excess.max(1) > limit) & (use.sum(1) > least))
        if not len(k):
            break
        use[k, worst[k, c], c] = False
    n = use.sum(1)
    mean = np.where(use, obs, 0).sum(1) / np.maximum(n, 1)
    rest = np.where(use, (obs - lib * np.nan_to_num(scale)[:, None, :]) ** 2, 0).sum(1)
    total = np.where(use, (obs - mean[:, None, :]) ** 2, 0).sum(1)
    varies = total > n * (1e-12 * mean) ** 2  # equal cells leave the rounding of their mean
    r2 = np.where(varies, 1 - rest / np.where(varies, total, 1), 0.0)
    bare = (n < least) & ~((method == "least_squares") & (np.where(fitted[:, :, None], obs, 0).sum(1) == 0))
    return np.where(bare, np.nan, scale), np.where(bare, np.nan, r2), use


def fit_matrix(observed: np.ndarray, expected: np.ndarray, method: str = "median_polish", least: int = 3, limit: float = 1.0, rounds: int = 5, trim: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_stack`` of one precursor (fragment, sample)."""
    return tuple(a[0] for a in fit_stack(observed[None], expected[None], method, least, limit, rounds, trim))


def _matched(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The fragment x sample matrix of one precursor and the library intensity of each fragment."""
    obs = pdf.pivot_table(index="ion", columns="sample", values="area", aggfunc="first", dropna=False)
    return obs, pdf.groupby("ion")["expected"].first().reindex(obs.index).to_numpy(float)


def library_rollup(df: DataFrame, method: str = "median_polish", least: int = 3, limit: float = 1.0, trim: bool = True, reliable_from: float = 0.5) -> DataFrame:
    """(key, sample, value, r2, n_used, warning): log2 of scale times the library's summed intensity.

    ``df`` is (key, ion, sample, area, expected, total), with ``total`` the sum over
    the whole library spectrum. Keys with fewer matched fragments than ``least`` give
    the log2 of their plain sum and no verdict. ``warning`` is poor_fit if R2 is
    under ``reliable_from``, many_outliers if more than half of the fragments were
    dropped, else null. Precursors of equal numbers of fragments and samples are fitted together.
    """
    def fitted(batches):
        for t, keys, _, samples, x, (cells, k, r, _) in matrices(batches, "key", "ion", "area"):
            number = lambda c: t[c].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)[cells]  # noqa: E731, B023
            exp, total = np.full(x.shape[:2], np.nan), np.full(len(x), -np.inf)
            seen = np.flatnonzero(~np.isnan(number("expected")))[::-1]  # the first cell is written last
            exp[k[seen], r[seen]] = number("expected")[seen]
            np.fmax.at(total, k, number("total"))
            matched = np.isfinite(exp) & (exp > 0)
            ok = matched.sum(1)[:, None]
            scale, r2, use = fit_stack(x, np.where(matched, exp, 0.0), method, least, limit, trim=trim)
            amount, n = scale * total[:, None], use.sum(1)
            few, plain = ok < least, np.nansum(np.maximum(x, 0), axis=1)
            amount = np.where(few, plain, amount)
            value = np.where(amount > 0, np.log2(np.where(amount > 0, amount, 1)), np.nan)
            r2, n = np.where(few, np.nan, r2), np.where(few, 0, n)
            code = np.where(np.isnan(r2), 2, np.where(r2 < reliable_from, 0, np.where(ok - n > ok // 2, 1, 2)))
            warning = pa.array(["poor_fit", "many_outliers", None]).take(pa.array(code.ravel()))
            yield from pa.table({"key": repeated(keys, x.shape[2]), "sample": samples, "value": value.ravel(), "r2": r2.ravel(), "n_used": pa.array(n.ravel(), pa.int32()), "warning": warning}).to_batches(1 << 16)

    out = sorted_cells(df, "key", "ion", "sample", "area", "expected", "total").mapInArrow(fitted, "key string, sample string, value double, r2 double, n_used int, warning string")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "r2")})


def fit_trace(df: DataFrame, least: int = 2, limit: float = 1.0, rounds: int = 5) -> DataFrame:
    """(key, sample, step, name, scale, r2, excluded): how a median fit came about.

    Steps are raw, library_scaled and, if fragments were dropped, outliers_removed
    or - where that made R2 worse, so that the first fit holds again -
    outliers_reverted. ``excluded`` lists the dropped fragments.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        obs, exp = _matched(pdf)
        ok = np.isfinite(exp) & (exp > 0)
        rows, key = [], pdf["key"].iloc[0]
        names = obs.index[ok].to_numpy()
        for sample in obs.columns:
            rows.append((key, sample, 0, "raw", np.nan, np.nan, []))
            x = obs[[sample]].to_numpy(float)[ok]
            if ok.sum() < least or not (x > 0).any():
                continue
            s0, r0, u0 = fit_matrix(x, exp[ok], least=0, trim=False)
            s1, r1, u1 = fit_matrix(x, exp[ok], least=least, limit=limit, rounds=rounds)
            rows.append((key, sample, 1, "library_scaled", s0[0], r0[0], []))
            gone = [str(n) for n in names[(u0 & ~u1)[:, 0]]]
            if gone and r1[0] >= r0[0]:
                rows.append((key, sample, 2, "outliers_removed", s1[0], r1[0], gone))
            elif gone:
                rows.append((key, sample, 2, "outliers_reverted", s0[0], r0[0], []))
        return pd.DataFrame(rows, columns=["key", "sample", "step", "name", "scale", "r2", "excluded"])

    out = df.select("key", "ion", "sample", "area", "expected").groupBy("key").applyInPandas(one, "key string, sample string, step int, name string, scale double, r2 double, excluded array<string>")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("scale", "r2")})


#: Settings of the library-assisted rollup and their defaults.
LIBRARY_DEFAULTS = {"library_path": None, "min_fragments": 3, "mz_tolerance": 0.02, "outlier_threshold": 1.0, "remove_outliers": True, "fitting_method": "median_polish"}


def library_settings(rollup: dict) -> dict:
    """Settings from a configuration: a nested ``library_assist`` block wins over flat ``library_*`` keys, these over ``spectral_library_*``."""
    nested, out = rollup.get("library_assist") or {}, dict(LIBRARY_DEFAULTS)
    for name in out:
        bare = name.removeprefix("library_")
        for source, key in ((rollup, f"spectral_library_{bare}"), (rollup, f"library_{bare}"), (nested, name), (nested, bare)):
            if source.get(key) is not None:
                out[name] = source[key]
    return out


def sum_charges(df: DataFrame, feature: Column) -> DataFrame:
    """Charge states fitted apart, summed on the linear scale."""
    return df.groupBy(feature.alias("feature"), "sample").agg(F.log2(F.sum(F.pow(F.lit(2.0), F.col("value")))).alias("value"))


def match_statistics(df: DataFrame) -> DataFrame:
    """One row: precursors, matched ones, share of fragments with an expectation."""
    per = df.groupBy("key").agg(F.countDistinct("ion").alias("ions"), F.countDistinct(F.when(F.col("expected") > 0, F.col("ion"))).alias("hits"))
    return per.agg(F.count("*").alias("keys"), F.sum((F.col("hits") > 0).cast("long")).alias("matched"), F.try_divide(F.sum("hits"), F.sum("ions")).alias("share"))


#: Mean residue composition, and heavy isotopes per 100 light ones in biological matter (fixed physical values).
AVERAGINE = {"mass": 111.1254, "C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
HEAVY_PER_100 = {"C": 1.0958793, "H": 0.0115, "N": 0.368351851, "O": 0.03799194, "S": 0.789308}


def isotope_pattern(mass: Column, n: int = 5) -> Column:
    """Array of n relative isotope intensities (largest 1).

    The average composition gives whole atoms (halves to even); the number of heavy
    ones is Poisson distributed.
    """
    residues = mass / AVERAGINE["mass"]
    rate = sum((F.bround(residues * AVERAGINE[a]) * (v / (100 + v)) for a, v in HEAVY_PER_100.items()), F.lit(0.0))
    terms = F.array(*[F.exp(-rate) * F.pow(rate, F.lit(float(i))) / float(math.factorial(min(i, 20))) for i in range(n)])
    return F.transform(terms, lambda t: t / F.array_max(terms))


def isotope_correction(df: DataFrame, major: float = 0.5, tolerance: float = 0.01) -> DataFrame:
    """(key, sample, scale, n, corrected_total, interfered, corrected) of rows (key, sample, isotope, observed, expected).

    Interference only adds, so the smallest ratio of observed to expected over the
    major isotopes (at least ``major`` times the largest expected) is the scale.
    ``corrected_total`` is the scale times all that is expected. What exceeds its
    share by more than ``tolerance`` is cut to it (``corrected``, by isotope), and
    the major isotopes of these are ``interfered``. Without an expected intensity
    there is nothing to correct: the observed total stands.
    """
    rows = df.select("key", "sample", "isotope", F.greatest("observed", F.lit(0.0)).alias("o"), F.col("expected").cast("double").alias("e"))
    sets = rows.groupBy("key", "sample").agg(F.array_sort(F.collect_list(F.struct("isotope", "o", "e"))).alias("p"), F.max("e").alias("_top"), F.sum("e").alias("_sum"), F.sum("o").alias("_seen"))
    main = F.filter("p", lambda r: (r["e"] > 0) & (r["e"] >= major * F.col("_top")))
    sets = sets.withColumns({"scale": F.array_min(F.transform(main, lambda r: r["o"] / r["e"])), "n": F.size(main).cast("long")})
    over = lambda r: r["o"] > (1 + tolerance) * F.col("scale") * r["e"]
    return sets.select(
        "key", "sample", "scale", "n", F.coalesce(F.col("scale") * F.col("_sum"), F.col("_seen")).alias("corrected_total"),
        F.transform(F.filter(main, lambda r: F.coalesce(over(r), F.lit(False))), lambda r: r["isotope"]).alias("interfered"),
        F.transform("p", lambda r: F.when(over(r), F.col("scale") * r["e"]).otherwise(r["o"])).alias("corrected"),
    )
