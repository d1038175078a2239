"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Each document gets a rate w (expected copies). Among all rates from 0 to ``cap``
that meet every source's token target, those closest to one copy each in relative
entropy are exponentially tilted: w = min(cap, exp(lambda * size / scale)), with
one multiplier lambda per source. The multipliers solve the convex dual, a sum of
one smooth function per source, by Newton iterations: each is one aggregation of
the distinct (source, size) pairs with their counts, so documents are read once
and a hot source is pre-aggregated. ``scale`` (the source's token-weighted mean
size) only conditions the numbers. Steps are kept inside a bracket that is halved
when Newton leaves it.

Rates become copies: floor(w), plus one for a share w - floor(w) of the
documents, picked by systematic rounding in order of size (largest first; ties
by id), so that the taken tokens of any run of sizes stay within one document of
the expected ones. The running sums are taken in two levels - size groups and,
inside a group of equal size, the rank modulo hash ranges - see ``_rounded``.
What remains between taken and target is closed, where a single document can do
it, by adding or dropping one copy of the document nearest in size to the gap, as
long as that brings the source nearer to its target (``repairs`` times at most).

Targets: sources in code-point order (null last) have the given weights, repeated
in turn; together they share ``share`` of all tokens; a source whose part exceeds
``cap`` times its tokens stops there and the excess goes to the others by weight
(water filling), until none is above.

Defined results: null text has size 0; documents of size 0 are taken with no
tokens. A source without tokens has target 0. An empty table gives an empty
result. Every row is a document of its own, with null and repeated ids too; rows
with one id, source and size are rounded in the order of ``row_col``, or of the
table as it is read. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch


#: Tokens are runs of characters other than spaces; each begins where a space, or nothing, stands before it.
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Number of maximal runs without space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from a table (source, size, n). One row per source goes through one task."""
    if share > cap:
        raise ValueError("the sources hold fewer tokens than asked for, even with every document at the cap")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    # Water filling: the part of a source is weight * level, or its ceiling cap * size if that is less.
    # Sources reach their ceilings in the order of ceiling / weight.
    by_ceiling = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sources.withColumn("weight", weight).withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    df = df.withColumns({"goal": F.lit(float(share)) * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    filled, used = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("level", (F.col("goal") - filled) / (F.col("all_weight") - used))
    # The level if all sources before this one are at their ceilings; it holds for the first that stays below.
    df = df.withColumn("below", F.when(F.col("weight") * F.col("level") <= F.col("ceiling"), F.col("level")))
    level = F.first("below", ignorenulls=True).over(by_ceiling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("water", level)
    return df.select("source", "source_size", F.when(F.col("water").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("weight") * F.col("water"))).alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.when(lam * x >= F.log(F.lit(cap)), F.lit(cap)).otherwise(F.exp(F.least(lam * x, F.log(F.lit(cap)))))


def multipliers(sizes: DataFrame, goals: DataFrame, scratch: Scratch, cap: float = 2.0, tolerance: float = 1e-9, max_rounds: int = 60, per_write: int = 4) -> DataFrame:
    """(source, lam, scale) with sum of size * rate = target for every source."""
    tokens = F.col("n") * F.col("size")
    shape = sizes.where("size > 0").groupBy("source").agg((F.sum(tokens * F.col("size")) / F.sum(tokens)).alias("scale"), F.min("size").alias("least"))
    state = goals.alias("g").join(shape.alias("s"), F.expr("g.source <=> s.source")).select("g.*", "scale", "least")
    top = F.log(F.lit(cap)) * F.col("scale") / F.col("least")  # there every document is at the cap
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = state.withColumns({"lo": -60.0 * F.col("scale"), "hi": top})
    state = state.withColumn("lam", F.when(full, top).when(F.col("target") > 0, F.least(F.log(F.col("target") / F.col("source_size")), top)).otherwise(F.col("lo")))
    state = scratch.table(state.drop("least"), "dual")
    positive = sizes.where("size > 0")
    for round_ in range(max_rounds):
        joined = positive.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).select("s.*", "size", "n")
        x = F.col("size") / F.col("scale")
        w = _rate(F.col("lam"), x, cap)
        keys = ["source", "source_size", "target", "scale", "lam", "lo", "hi"]
        exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")  # noqa: E731  sums that do not depend on the order of rows
        sums = joined.groupBy(*keys).agg(exact(tokens * w).alias("taken"), exact(F.when(F.col("lam") * x < F.log(F.lit(cap)), tokens * x * w).otherwise(0.0)).alias("slope"))
        over = F.col("taken") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        sums = sums.withColumns({"lo": lo, "hi": hi, "gap": (F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))})
        newton = F.col("lam") - F.try_divide(F.col("taken") - F.col("target"), F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        step = F.when(F.abs("gap") <= tolerance, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = sums.withColumn("lam", step).select(*keys, "gap")
        if (round_ + 1) % per_write == 0:  # several rounds per written table: each is a small aggregation
            state = scratch.table(state, "dual")
            if state.where(f"abs(gap) > {tolerance} AND hi - lo > 1e-13 * greatest(abs(lo), abs(hi), 1)").isEmpty():
                break
    return state.select("source", "lam", "scale")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", groups: int = 256, repairs: int = 12, row_col: str | None = None) -> DataFrame:
    """Per document: id, size, source_size, target, rate, copies, taken (= copies * size); first ``row_col``, a unique number, if it is given."""
    scratch = Scratch(docs.sparkSession, "mixing")
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("size"))
    rows = scratch.table(read, "sizes")
    sizes = scratch.table(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    goals = scratch.table(targets(sizes, weights, share, float(cap)), "targets")
    dual = multipliers(sizes, goals, scratch, float(cap))
    plan = goals.alias("g").join(dual.alias("m"), F.expr("g.source <=> m.source"), "left").select("g.*", "lam", "scale")
    # one row per distinct size: rate, and where its documents start in the running sum of fractional copies
    rate = F.coalesce(_rate(F.col("lam"), F.col("size") / F.col("scale"), float(cap)), F.lit(0.0))
    cells = sizes.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.source", "size", "n", "source_size", "target", F.when(F.col("size") == 0, 1.0).otherwise(rate).alias("rate"))
    cells = scratch.table(cells.withColumn("part", F.col("rate") - F.floor("rate")), "rates")
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    cells = scratch.table(cells.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), "starts")
    taken = _rounded(rows, cells, scratch, groups)
    taken = scratch.table(taken, "copies")
    for _ in range(repairs):
        taken, changed = _repaired(taken, scratch, cap)
        if not changed:
            break
    return taken.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _rounded(rows: DataFrame, cells: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
    """Systematic rounding: copies = floor(w) + (floor(before + part + 1/2) - floor(before + 1/2)).

    ``before`` is the running sum of fractional parts: the start of the document's
    size plus its rank among equal sizes times the part. The rank is taken inside
    one of ``groups`` hash groups of a size, plus the counts of the groups before,
    so that no window holds more than that share of a common size.
    """
    slot = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id")), F.lit(groups)).cast("int")
    slotted = rows.withColumn("slot", slot)
    counts = slotted.groupBy("source", "size", "slot").agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("ahead", ahead).drop("m")
    ranked = slotted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("id", "row")) - 1)
    on = F.expr("r.source <=> c.source AND r.size = c.size")
    joined = ranked.alias("r").join(counts.alias("c"), on & F.expr("r.slot = c.slot")).select("r.*", "ahead")
    joined = joined.alias("r").join(cells.alias("c"), on).select("r.row", "r.id", "r.source", "r.size", "source_size", "target", "rate", "part", "start", (F.col("rank") + F.col("ahead")).alias("rank"))
    # values on a grid of 1e-9, so that a sum taken in another order cannot move a rounding
    at = lambda k: F.floor(F.round(F.col("start") + (F.col("rank") + k) * F.col("part") + 0.5, 7))
    return joined.select("row", "id", "source", "size", "source_size", "target", "rate", (F.floor("rate") + at(1) - at(0)).cast("int").alias("copies"))


def _repaired(taken: DataFrame, scratch: Scratch, cap: int) -> tuple[DataFrame, bool]:
    """One copy more or less of one document per source, if that brings it nearer to its target."""
    gaps = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    near = taken.alias("t").join(gaps.alias("g"), F.expr("t.source <=> g.source")).select("t.*", "gap")
    may = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    picks = near.where(may & (F.col("size") > 0) & (miss < F.abs("gap") - 0.5)).groupBy("source").agg(F.min_by(F.struct("row", "gap"), F.struct(miss.alias("m"), F.col("id").alias("i"), F.col("row").alias("r"))).alias("pick"))
    picks = scratch.table(picks.select("source", F.col("pick.row").alias("picked"), F.signum("pick.gap").cast("int").alias("step")), "repairs")
    if picks.isEmpty():
        return taken, False
    out = taken.alias("t").join(picks.alias("p"), F.expr("t.source <=> p.source AND t.row = p.picked"), "left")
    out = scratch.table(out.select(*[F.col(f"t.{c}") for c in taken.columns if c != "copies"], (F.col("t.copies") + F.coalesce("step", F.lit(0))).alias("copies")), "copies")
    return out, True
