"""URL filters: host and path rules first, then a trained model; no Python in the query.

Model. Host and path are cut into character n-grams (3 to 5, with boundary marks,
host and path apart), hashed to ``2**bits`` buckets; a logistic regression over
the buckets' shares is fitted by Spark ML (L-BFGS in the JVM) on a small labelled table
of URLs (``url_table``), one partition of it. Its bounded coefficient vector becomes an array
literal, and a URL is scored by higher-order functions inside the scan's stage:
no shuffle, no Python.

Rules. A rule is ``host/path``; it fits its host and every subdomain if the URL's
path starts with the rule's (path from the first slash on). The longest fitting
rule decides; among equally long ones the first in code-point order. Rules are a
short literal list. Without a rule the model's verdict holds: block if its
probability reaches ``threshold``.

Defined results: a null URL or one without ``://`` has empty host and path, fits no
rule and gets the model's verdict on nothing. Host letters A-Z are lower-cased;
user names and ports stay part of the host. Repeated rows, and rows without id,
each get their verdict. Other columns are ignored, whatever their names. Equal
probabilities of both verdicts (exactly the threshold) block.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last one wins
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(text: Column, n: int) -> Column:
    """Array of the character n-grams of a string; empty if it is shorter."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_buckets(host: Column, path: Column, bits: int) -> Column:
    marked = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit(">"), path, F.lit("<")))
    parts = [grams(m, n) for m in marked for n in (3, 4, 5)]
    return F.transform(F.concat(*parts), lambda g: F.pmod(F.xxhash64(g), F.lit(1 << bits)).cast("int"))


def train(spark: SparkSession, rows: list[tuple[str, int]] | None = None, bits: int = 11, ridge: float = 1e-4, rounds: int = 30) -> tuple[list[float], float]:
    """Coefficients and intercept, fitted on the small labelled table."""
    rows = url_table.rows() if rows is None else rows
    quoted = lambda u: "'" + u.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quoted(u)}, {y})" for i, (u, y) in enumerate(rows))
    table = spark.sql(f"SELECT row, url, CAST(y AS DOUBLE) AS label FROM VALUES {values} AS t(row, url, y)").coalesce(1)
    dims = 1 << bits
    buckets = gram_buckets(host_of(F.col("url")), path_of(F.col("url")), bits)
    named = table.select("row", "label", buckets.alias("b")).select("row", "label", F.size("b").alias("n"), F.explode("b").alias("bucket"))
    cells = named.groupBy("row", "label", "bucket").agg((F.count("*") / F.sqrt(F.first("n"))).alias("x"))  # one partition: nothing is shuffled
    cells = cells.groupBy("row", "label").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))
    dense = cells.select("label", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))
    features = dense.select("label", array_to_vector("x").alias("features"))
    model = LogisticRegression(regParam=ridge, standardization=False, maxIter=rounds).fit(features)
    return [float(c) for c in model.coefficients], float(model.intercept)


def filter_urls(pages: DataFrame, model: tuple[list[float], float], rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, bits: int = 11, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, probability, verdict."""
    coefficients, intercept = model
    weights = F.lit(coefficients)
    named = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = named.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "_b": gram_buckets(F.col("host"), F.col("path"), bits)})
    total = F.aggregate("_b", F.lit(0.0), lambda s, i: s + F.get(F.col("_w"), i))
    scored = scored.withColumn("_w", weights).withColumn("_z", total / F.sqrt(F.greatest(F.size("_b"), F.lit(1))) + intercept)
    scored = scored.withColumn("probability", 1 / (1 + F.exp(-F.col("_z"))))
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), F.when(F.col("probability") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", "probability", verdict.alias("verdict"))
