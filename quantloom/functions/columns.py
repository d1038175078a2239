"""Names: column detection, sample and transition ids, sample types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "__@__"
#: Logical names and the headers that exports use for them (fixed values of the export format).
CANDIDATES = {
    "entity": ["Protein Accession", "Protein"],
    "entity_name": ["Protein Name", "Protein"],
    "gene": ["Protein Gene"],
    "feature": ["Peptide Modified Sequence Unimod Ids", "Peptide Modified Sequence", "Peptide"],
    "charge": ["Precursor Charge"],
    "product_charge": ["Product Charge"],
    "mz": ["Precursor Mz"],
    "product_mz": ["Product Mz"],
    "ion": ["Fragment Ion"],
    "area": ["Area", "Total Area Fragment", "Total Area Ms1"],
    "rt": ["Retention Time", "Best Retention Time"],
    "start": ["Start Time", "Min Start Time"],
    "stop": ["End Time", "Max End Time"],
    "shape": ["Shape Correlation"],
    "coeluting": ["Coeluting"],
    "q": ["Detection Q Value"],
    "replicate": ["Replicate Name", "Replicate", "File Name"],
    "batch": ["Batch", "Batch Name"],
    "acquired": ["Acquired Time"],
    "document": ["Source Document"],
}
REQUIRED = ("entity", "feature", "replicate", "area")
#: Vendor sample types (fixed values) and what they mean here.
SAMPLE_TYPES = {"unknown": "experimental", "standard": "reference", "quality control": "qc", "blank": "blank", "solvent": "blank", "double blank": "blank"}
INTERNAL_STANDARDS = ("PRTC", "ENO1_YEAST", "P00924", "enolase")


def _plain(name: str) -> str:
    return re.sub(r"[\s_]+", "", name).lower()


def find(columns: list[str], logical: str) -> str | None:
    """First candidate header present, without regard to case, spaces and underscores."""
    have = {_plain(c): c for c in reversed(columns)}
    return next((have[_plain(c)] for c in [*CANDIDATES.get(logical, []), logical] if _plain(c) in have), None)


def validate(df: DataFrame) -> dict:
    """Detected columns, missing required ones, row and key counts."""
    found = {k: c for k in CANDIDATES if (c := find(df.columns, k))}
    missing = [k for k in REQUIRED if k not in found]
    counts = {} if missing else df.agg(F.count("*").alias("rows"), F.countDistinct(F.col(f"`{found['feature']}`")).alias("features"), F.countDistinct(F.col(f"`{found['replicate']}`")).alias("replicates")).first().asDict()
    return {"columns": found, "missing": missing, "valid": not missing, **counts}


def refuse_own_output(df: DataFrame) -> None:
    own = {"n_transitions", "mean_rt"} & set(df.columns)
    if own or sum(SEPARATOR in c for c in df.columns) > 1:
        raise ValueError("this table is a result of a rollup, not a report")


def sample_id(replicate: Column, batch: Column) -> Column:
    """replicate, separator, batch; null without replicate."""
    return F.when(replicate.isNotNull(), F.concat(replicate, F.lit(SEPARATOR), F.coalesce(batch, F.lit(""))))


def replicate_of(sample: Column) -> Column:
    return F.split_part(sample, F.lit(SEPARATOR), F.lit(1))


def transition_id(ion: Column, charge: Column, product_charge: Column) -> Column:
    return F.concat(ion, F.lit("_z"), charge.cast("string"), F.lit("_"), product_charge.cast("string"))


def first_of(df: DataFrame, *candidates: str) -> Column:
    """The first value that is not null among those candidate columns that exist."""
    return F.coalesce(*[F.col(f"`{c}`") for c in candidates if c in df.columns], F.lit(None).cast("string"))


def precursor_id(feature: Column, charge: Column) -> Column:
    return F.concat_ws("_", feature, charge.cast("string"))


def without_precursor_ions(df: DataFrame, ion: str = "ion") -> DataFrame:
    return df.where(~F.lower(F.col(ion)).startswith("precursor"))


def type_by_name(name: Column, reference: list[str], qc: list[str]) -> Column:
    """Sample type by substrings of the name; reference patterns come first."""
    any_of = lambda ps: F.lit(False) if not ps else F.array_contains(F.array(*[F.contains(name, F.lit(p)) for p in ps]), True)
    return F.when(any_of(reference), "reference").when(any_of(qc), "qc").otherwise("experimental")


def vendor_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in SAMPLE_TYPES.items() for x in p])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(kind))), F.lit("experimental"))


def internal_standards(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose names or ids contain an internal standard, in any case."""
    pattern = "(?i)" + "|".join(map(re.escape, INTERNAL_STANDARDS))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(hit)


def once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)
