"""Sequences: cleavage rules, digestion, modification stripping, mapping of features to sequences."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import substring_join

#: Cleavage rules (fixed values): a cut falls after a place that matches, but never at an end.
ENZYMES = {
    "trypsin": r"[KR](?=[^P])",
    "trypsin/p": r"[KR](?=.)",
    "lysc": r"K(?=.)",
    "lysn": r".(?=K)",
    "argc": r"R(?=.)",
    "aspn": r".(?=D)",
    "gluc": r"E(?=.)",
    "chymotrypsin": r"[FWYL](?=[^P])",
}


def enzyme_rule(enzyme: str) -> str:
    """The rule by name; hyphens and case do not matter (lys-c is lysc)."""
    rule = ENZYMES.get(enzyme.lower().replace("-", ""))
    if rule is None:
        raise ValueError(f"Unknown enzyme {enzyme!r}; known are {', '.join(ENZYMES)}, and nonspecific for digests")
    return rule


def cut_sequence(sequence: Column, enzyme: str) -> Column:
    """The fragments of a complete digest, in order: cuts are marked, then split at."""
    return F.split(F.regexp_replace(sequence, f"({enzyme_rule(enzyme)})", "$1|"), r"\|")


def boundaries(sequence: Column, enzyme: str) -> Column:
    """Sorted cut positions: 0, the length, every cut, and 1 if the sequence begins with M."""
    lengths = F.transform(cut_sequence(sequence, enzyme), lambda p: F.length(p))
    ends = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x))
    lead = F.when(sequence.startswith("M") & (F.length(sequence) > 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return F.array_sort(F.array_distinct(F.concat(lead, ends)))


def digest(df: DataFrame, sequence: str, enzyme: str = "trypsin", missed: int = 2, shortest: int = 6, longest: int = 30) -> DataFrame:
    """One row per (row, peptide): adds peptide, start (from 0) and missed. Pure expressions, no shuffle.

    ``nonspecific`` gives all pieces of the allowed lengths, none of which misses a cut.
    """
    if enzyme.lower() == "nonspecific":
        return digest_nonspecific(df, sequence, shortest, longest).withColumn("missed", F.lit(0)).select(*df.columns, "start", "missed", "peptide")
    parts = df.withColumn("_p", cut_sequence(F.col(sequence), enzyme)).select("*", F.posexplode("_p").alias("_i", "_f"))
    start = F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0), lambda s, x: s + F.length(x))
    rows = parts.withColumn("start", start).withColumn("missed", F.explode(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("_p") - 1 - F.col("_i")))))
    peptide = F.array_join(F.slice("_p", F.col("_i") + 1, F.col("missed") + 1), "")
    return rows.withColumn("peptide", peptide).where(F.length("peptide").between(shortest, longest)).drop("_p", "_i", "_f")


def digest_nonspecific(df: DataFrame, sequence: str, shortest: int = 6, longest: int = 30) -> DataFrame:
    """All pieces of the allowed lengths."""
    n = F.length(sequence)
    d = df.where(n >= shortest).withColumn("_n", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), n))))
    d = d.withColumn("start", F.explode(F.sequence(F.lit(0), F.length(sequence) - F.col("_n"))))
    return d.withColumn("peptide", F.substring(F.col(sequence), F.col("start") + 1, F.col("_n"))).drop("_n")


def theoretical_counts(df: DataFrame, entity: str, sequence: str, enzyme: str = "trypsin", shortest: int = 6, longest: int = 30) -> DataFrame:
    """(entity, n_theoretical): distinct fully cut peptides of allowed length."""
    return digest(df, sequence, enzyme, 0, shortest, longest).groupBy(F.col(entity).alias("entity")).agg(F.countDistinct("peptide").alias("n_theoretical"))


def strip_modifications(peptide: Column) -> Column:
    """Bare residues: bracketed modifications and terminal marks go, only upper-case letters stay."""
    out = peptide
    for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", r"\{[^}]*\}", r"<[^>]*>"):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"[^A-Z]", "")


def for_matching(peptide: Column, leucine: bool = True) -> Column:
    """Upper case, with I read as L if the two are not to be told apart."""
    return F.translate(F.upper(peptide), "I", "L") if leucine else F.upper(peptide)


def terminus_ok(start: Column, stop: Column, cuts: Column, specificity: str = "full") -> Column:
    """Whether a piece [start, stop) ends at cut positions: both ends (full), one (semi) or any (none)."""
    a, b = F.array_contains(cuts, start), F.array_contains(cuts, stop)
    return {"full": a & b, "semi": a | b, "none": F.lit(True)}[specificity]


def map_features(features: DataFrame, sequences: DataFrame, enzyme: str = "trypsin", specificity: str = "full", leucine: bool = True) -> DataFrame:
    """(feature, entity) edges: features whose bare sequence occurs in an entity's sequence between allowed ends.

    An equi-join of pieces instead of a search of every feature in every sequence.
    """
    f = features.select("feature", for_matching(strip_modifications(F.col("feature")), leucine).alias("bare")).distinct().where("bare <> ''")
    s = sequences.select("entity", F.col("sequence"), for_matching(F.col("sequence"), leucine).alias("_t"))
    hits = substring_join(f, s, "bare", "_t", ["entity"]).join(s.select("entity", "sequence", "_t"), "entity").where(F.substring(F.col("_t"), F.col("at"), F.length("bare")) == F.col("bare"))
    start = F.col("at") - 1
    ok = terminus_ok(start, start + F.length("bare"), boundaries(F.col("sequence"), enzyme), specificity)
    return hits.where(ok).join(f, "bare").select("feature", "entity").distinct()


def digest_maps(df: DataFrame, entity: str, sequence: str, enzyme: str = "trypsin", missed: int = 0, shortest: int = 6, longest: int = 30) -> tuple[DataFrame, DataFrame]:
    """The digest of all sequences as (entity, peptides) and (peptide, entities), both as sorted lists."""
    pairs = digest(df, sequence, enzyme, missed, shortest, longest).select(F.col(entity).alias("entity"), "peptide").distinct()
    return pairs.groupBy("entity").agg(F.array_sort(F.collect_set("peptide")).alias("peptides")), pairs.groupBy("peptide").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def detected(df: DataFrame, feature: str) -> DataFrame:
    """Distinct features that are not null."""
    return df.select(F.col(feature).alias("feature")).where("feature IS NOT NULL").distinct()


def display_names(proteins: DataFrame) -> DataFrame:
    """(entity, shown): the gene, else an entry name other than the accession, else the description's first word, else the accession."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    other = F.when(F.col("name") != F.col("entity"), blank(F.col("name")))
    first = blank(F.split_part(F.trim(F.regexp_replace("description", r"\s+", " ")), F.lit(" "), F.lit(1)))
    return proteins.select("entity", F.coalesce(blank(F.col("gene")), other, first, F.col("entity")).alias("shown"))


def enzyme_from_xml(xml: str | None) -> str | None:
    """The rule that a document's digestion settings name: cut residues, side and whether proline blocks; None if unknown."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    plain = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    found = next((e for e in root.iter() if plain(e) == "enzyme"), None)
    if found is None:
        return None
    given = {k.lower(): v for k, v in found.attrib.items()}
    cut = "".join(sorted({c.upper() for c in given.get("cut", "") if c.isalpha()}))
    side = given.get("sense", "C").strip().upper()
    if (cut, side) == ("KR", "C"):
        return "trypsin" if "P" in given.get("no_cut", "").upper() else "trypsin/p"
    known = {("K", "C"): "lysc", ("K", "N"): "lysn", ("R", "C"): "argc", ("D", "N"): "aspn", ("E", "C"): "gluc", ("FLWY", "C"): "chymotrypsin", ("FWY", "C"): "chymotrypsin"}
    return known.get((cut, side))
