"""From report files to both output matrices: the steps in order, by configuration."""

from __future__ import annotations

import difflib
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import find, without_precursor_ions
from quantloom.operators import combat, normalize, parsimony, qc, rollup
from quantloom.scratch import Scratch
from quantloom.sources import reports

DEFAULTS = {
    "transition_rollup": {"method": "sum", "min_transitions": 3, "use_ms1": False},
    "global_normalization": {"method": "rt_lowess"},
    "batch_correction": {"enabled": True},
    "parsimony": {"shared": "all_groups"},
    "protein_rollup": {"method": "median_polish", "min_features": 3},
    "protein_normalization": {"method": "median"},
    "protein_correction": {"enabled": True},
}
_CORRECTION = {"enabled", "method", "reference_anchored", "reference_type", "auto_revert"}
_NORMALIZATION = {"method", "frac", "grid_points", "optimize", "rounds"}
#: What a configuration may set, by section; a nested section is named with its path.
KNOWN = {
    "transition_rollup": {"method", "min_transitions", "use_ms1"},
    "global_normalization": _NORMALIZATION,
    "batch_correction": _CORRECTION,
    "parsimony": {"shared"},
    "protein_rollup": {"method", "min_features", "n", "selection", "topn"},
    "protein_rollup.topn": {"n", "selection"},
    "protein_normalization": _NORMALIZATION,
    "protein_correction": _CORRECTION,
}


def merged(base: dict, over: dict) -> dict:
    """``base`` with what ``over`` sets, section by section at every depth; neither is changed."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def unknown_keys(config: dict, known: dict[str, set[str]] = KNOWN, path: str = "") -> list[str]:
    """Dotted names of settings that no step reads, in order; what lies below an unknown name is not looked at."""
    names = known.get(path, set()) if path else {k for k in known if "." not in k}
    out = []
    for key, value in config.items():
        full = f"{path}.{key}" if path else key
        if key not in names:
            out.append(full)
        elif isinstance(value, dict) and full in known:
            out += unknown_keys(value, known, full)
    return out


def without(config: dict, names: list[str], path: str = "") -> dict:
    full = lambda k: f"{path}.{k}" if path else k
    return {k: without(v, names, full(k)) if isinstance(v, dict) else v for k, v in config.items() if full(k) not in names}


def settings(config: dict | None, strict: bool = False) -> dict:
    """Defaults with the configuration over them. Unknown settings are reported and left out; ``strict`` raises.

    A section that is null has its defaults. The nested ``protein_rollup.topn`` wins
    over ``n`` and ``selection`` beside it.
    """
    given = {k: v for k, v in (config or {}).items() if v is not None}
    odd = unknown_keys(given)
    if odd and strict:
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    for name in odd:
        near = difflib.get_close_matches(name.rsplit(".", 1)[-1], KNOWN.get(name.rpartition(".")[0], {k for k in KNOWN if "." not in k}), 1)
        warnings.warn(f"unknown setting {name}" + (f" (did you mean {near[0]}?)" if near else ""), stacklevel=2)
    out = merged(DEFAULTS, without(given, odd))
    out["protein_rollup"] |= out["protein_rollup"].pop("topn", None) or {}
    return out


def seen_features(df: DataFrame) -> DataFrame:
    """Without the features that have no value in any sample."""
    return df.join(df.groupBy("feature").agg(F.count("x").alias("_n")).where("_n > 0").select("feature"), "feature", "left_semi")


def level(values: DataFrame, normalization: dict, correction: dict) -> DataFrame:
    """One level's matrix (feature, sample, x, rt, batch, sample_type), normalised and corrected."""
    options = {k: v for k, v in normalization.items() if k != "method"}
    return combat.correct(normalize.normalize(seen_features(values), normalization["method"], **options), correction)


def run_reports(spark: SparkSession, paths: dict[str, str], metadata: DataFrame, config: dict | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, entities, groups) of the named report files; written as tables, and to ``out`` as wide matrices if it is given.

    Both matrices are long: feature or entity, sample, sample_type, batch, x.
    """
    c, scratch = settings(config), Scratch(spark, "run")
    rows = scratch.table(reports.merge_reports([(name, reports.read_report(spark, path)) for name, path in sorted(paths.items())]), "merged")
    edges = scratch.table(parsimony.edges_from_lists(rows, f"`{find(rows.columns, 'feature')}`", f"`{find(rows.columns, 'entity')}`"), "edges")
    cells = reports.long_cells(rows)
    if not c["transition_rollup"]["use_ms1"]:
        cells = without_precursor_ions(cells, "transition")
    cells = scratch.table(cells, "cells")
    scratch.drop(rows)
    samples = scratch.table(reports.with_metadata(cells.select("sample", "batch").distinct(), metadata), "samples")
    tr, pr = c["transition_rollup"], c["protein_rollup"]
    first = rollup.first_cells(cells.repartition("feature"), ["row"])  # all of a feature's steps follow this shuffle
    m = rollup.matrix(first, rollup.sample_list(cells.where("area IS NOT NULL")), tr["min_transitions"])
    if tr["method"] == "sum":
        rolled = rollup.rollup_sum(m)  # the matrix has no features of fewer transitions
    else:
        rolled = rollup.rollup_transitions(scratch.table(m, "matrix"), tr["method"], tr["min_transitions"], cells)
    values = rolled.select("feature", "sample", F.col("value").alias("x")).join(rollup.mean_times(cells).withColumnRenamed("mean_rt", "rt"), "feature", "left").join(samples, "sample")
    raw = scratch.table(values, "raw")
    scratch.drop(cells)
    features = scratch.table(level(raw, c["global_normalization"], c["batch_correction"]), "features")
    scratch.drop(raw)
    made = parsimony.grouping(edges)  # for the groups and for their sums or matrix
    groups = scratch.table(parsimony.groups(edges, made), "groups")
    if pr["method"] == "sum":
        rolled = parsimony.summed_groups(features, edges, c["parsimony"]["shared"], made, pr["min_features"])
    else:
        rolled = rollup.rollup_entities(scratch.table(parsimony.group_matrix(features, edges, c["parsimony"]["shared"], made), "grouped"), **pr)
    values = rolled.select(F.col("entity").alias("feature"), "sample", F.col("value").alias("x")).join(samples, "sample")
    entities = scratch.table(level(scratch.table(values, "raw_entities"), c["protein_normalization"], c["protein_correction"]).withColumnRenamed("feature", "entity"), "entities")
    if out is not None:
        names = [r[0] for r in samples.select("sample").orderBy("sample").collect()]
        linear = lambda d: d.withColumn("x", F.pow(F.lit(2.0), F.col("x")))
        reports.write_matrix(qc.wide(linear(features), names), f"{out}/corrected_features")
        reports.write_matrix(qc.wide(linear(entities), names, "entity"), f"{out}/corrected_entities")
        reports.write_matrix(reports.group_table(groups), f"{out}/groups", "csv")
        reports.write_matrix(reports.sample_table(samples), f"{out}/sample_metadata", "csv")
        reports.write_provenance(spark, f"{out}/provenance.json", c, list(paths.values()), {"features": features.select("feature").distinct().count(), "samples": len(names)}, [f"{k}: {v}" for k, v in c.items()])
    return features, entities, groups
