"""Near-duplicate documents by HyperMinHash.

1. Sketch. The hash of a shingle picks one of 256 buckets with its first 8 bits;
   the bucket keeps its smallest remaining value, compressed to the count of its
   leading zeros and the 10 bits that follow (16 bits a bucket, 512 bytes a
   document). A document with few shingles leaves buckets empty; these borrow
   the register of another bucket, chosen by a fixed sequence of buckets for
   each, so equal registers keep the probability of the Jaccard similarity.
2. Copies. Documents with equal shingle sets (128-bit sum over the set) form a
   class; only its smallest id takes part in what follows. Large groups of
   copies end here, aggregated inside map tasks.
3. Banding. 42 bands of 6 compressed registers. A pair of similarity 0.8 meets
   in no band with probability (1 - 0.8**6)**42 = 3e-6.
4. Candidates. Within a band value every class is paired with one pivot, never
   with all others: the class that shares most bands with others (in a group of
   edited copies that is the text they were made from, or one close to it).
   Pairs whose sizes or whose collision-corrected similarity estimate rule the
   threshold out are dropped; the estimate's margin is 6 standard deviations.
5. Links are confirmed on the full shingle sets. First each class's best pair is
   confirmed and components are formed; then the other pairs that would join two
   components. Last, the documents that did not join their pivot's component are
   searched against all others of the pivot's bands, in blocks of ``BLOCK``: first
   by sketch, then, for what that leaves, on full sets. Blocks are numpy work
   inside a task; a pair never becomes a row unless it is a link. No link that
   shares a band is lost (inside a component none is needed).

Results: one row per document with ``component_id`` (smallest id reachable over
links) and ``kept``. Null or empty texts have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle as a whole. Rows
with one id and different texts are out of contract: both get a row, and the id
counts as one vertex. Other columns are ignored here.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

from .components import components, relabel
from .words import LOWER, SPACE, mix, shingles, slices

BUCKET_BITS, MANTISSA, TEXT_BITS = 8, 10, 11
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 42, 6
PROBES = 48
_KEY_BITS = 64 - TEXT_BITS  # of a hash that are kept beside the text's number in a slice
_VALUE_BITS = _KEY_BITS - BUCKET_BITS
_PROBE = (mix(np.arange(PROBES * BUCKETS, dtype=np.uint64) + np.uint64(77)) >> np.uint64(56)).astype(np.int64).reshape(PROBES, BUCKETS)
_COEFFICIENTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def registers(keys: np.ndarray, n_texts: int) -> np.ndarray:
    """Register matrix from the sorted keys text << _KEY_BITS | hash; 0 only for texts without shingles."""
    group = keys >> np.uint64(_VALUE_BITS)
    first = np.ones(len(keys), bool)
    first[1:] = group[1:] != group[:-1]
    value = keys[first] & np.uint64((1 << _VALUE_BITS) - 1)
    zeros = _VALUE_BITS - np.frexp(value.astype(np.float64))[1].astype(np.int64)  # exact: under 53 bits
    tail = (value << np.minimum(zeros + 1 + 64 - _VALUE_BITS, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    own = np.zeros((n_texts, BUCKETS), np.uint16)
    own.ravel()[group[first].astype(np.int64)] = 1 + (zeros << MANTISSA | tail.astype(np.int64))
    full = own.copy()
    rows = np.flatnonzero((own == 0).any(1) & (own != 0).any(1))
    for probe in _PROBE:
        if not len(rows):
            return full
        part = full[rows]
        part = np.where(part == 0, own[rows][:, probe], part)
        full[rows] = part
        rows = rows[(part == 0).any(1)]
    for r in rows:  # what the sequence did not fill: the next bucket in use
        used = np.flatnonzero(own[r])
        empty = np.flatnonzero(full[r] == 0)
        full[r, empty] = own[r, used[np.searchsorted(used, empty) % len(used)]]
    return full


def _sketches(batches, k: int):
    low = np.uint64((1 << _KEY_BITS) - 1)
    for batch in batches:
        ids = batch.column(0)
        for w in slices(batch.column(1), SPACE, LOWER, max_texts=1 << TEXT_BITS):
            text, h = shingles(w, k)
            keys = np.sort(text.astype(np.uint64) << np.uint64(_KEY_BITS) | h >> np.uint64(TEXT_BITS))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            keys = keys[new]
            n = np.bincount((keys >> np.uint64(_KEY_BITS)).astype(np.int64), minlength=w.n_texts)
            ends = np.cumsum(n)
            sums = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                total = np.zeros(len(keys) + 1, np.uint64)
                np.cumsum(mix((keys & low) + np.uint64(salt)), out=total[1:])
                sums.append((total[ends] - total[ends - n]).view(np.int64))
            regs = registers(keys, w.n_texts)
            packed = pa.Array.from_buffers(pa.binary(BUCKETS * 2), w.n_texts, [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_texts), pa.array(n), *map(pa.array, sums), packed], ["id", "n", "h1", "h2", "regs"])


def _matrix(regs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            regs = _matrix(part.column("regs"))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mix((regs * _COEFFICIENTS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], ["key", "id"])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers that agree by chance between disjoint sets of n and m shingles."""
    a, b = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    hi = 2.0 ** -np.arange(0, _VALUE_BITS)  # values with i leading zeros lie in [hi / 2, hi)
    width = hi / 2 / (1 << MANTISSA)
    both = width * a * b / (a + b) * (np.exp(-(a + b) * hi / 2) - np.exp(-(a + b) * hi))
    return both.sum(1) / ((1 - np.exp(-a)) * (1 - np.exp(-b)))[:, 0]


def jaccard_estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of two register matrices, row by row."""
    by_chance = chance(n.astype(float), m.astype(float))
    return ((x == y).mean(1) - by_chance) / (1 - by_chance)


def _estimates(batches, percent: int):
    t = percent / 100
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            n, m = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
            est = jaccard_estimate(_matrix(part.column("regs_a")), _matrix(part.column("regs_b")), n, m)
            margin = 6 * np.sqrt(t * (1 - t) / np.minimum(BUCKETS, np.minimum(n, m)))
            keep = pa.array((est >= t - margin) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(est).filter(keep), part.column("spoke").filter(keep)], ["a", "b", "est", "spoke"])


def _sets(texts: pa.Array, k: int):
    for w in slices(texts, SPACE, LOWER):
        text, h = shingles(w, k)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        offs = np.searchsorted(text, np.arange(w.n_texts + 1))
        for i in range(w.n_texts):
            s = h[offs[i] : offs[i + 1]]
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


BLOCK = 512


def _blocks(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (pivot, id, comp, main, n) dealt to blocks: queries (outside the main component) meet every block of members."""
    odd = F.col("comp") != F.col("main")
    blocks = lambda c: F.greatest(F.ceil(c / F.lit(BLOCK)), F.lit(1)).cast("int")
    counts = groups.groupBy("pivot").agg(blocks(F.sum(odd.cast("long"))).alias("qb"), blocks(F.count("*")).alias("mb"))
    rows = groups.join(scratch.table(counts, "counts"), "pivot")
    spot = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keep = ["pivot", "id", "comp", "main", "n"]
    queries = rows.where(odd).select(*keep, F.lit(True).alias("query"), spot("qb").alias("i"), each("mb").alias("j"))
    others = rows.select(*keep, F.lit(False).alias("query"), each("qb").alias("i"), spot("mb").alias("j"))
    return queries.unionByName(others)


def _in_blocks(rows: DataFrame, search, schema: str) -> DataFrame:
    """Run ``search`` on each (pivot, i, j) block: at most about 2 * BLOCK rows."""

    def each(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            cuts = _cuts(kept)
            yield from (r for lo, hi in zip(cuts[:-2], cuts[1:-1]) for r in search(kept.slice(lo, hi - lo)))
            kept = kept.slice(cuts[-2])
        if kept is not None and kept.num_rows:
            yield from search(kept)

    keys = ["pivot", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def _cuts(t: pa.Table) -> list[int]:
    """Where blocks begin in sorted rows, and the end."""
    new = np.zeros(t.num_rows, bool)
    for c in ("pivot", "i", "j"):
        codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return [0, *np.flatnonzero(new).tolist(), t.num_rows]


def _sides(t: pa.Table):
    """Indices of queries and others, and the components and sizes of all rows."""
    query = t.column("query").to_numpy()
    return np.flatnonzero(query), np.flatnonzero(~query), t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("n").to_numpy()


def _search_sketches(t: pa.Table, percent: int):
    """The rows that a sketch estimate leaves as a possible link between components."""
    qs, ms, comp, n = _sides(t)
    if not len(qs) or not len(ms):
        return
    share = percent / 100
    regs = _matrix(t.column("regs").combine_chunks())
    centre = np.array(t.column("id").to_pylist(), object)[ms] == np.array(t.column("pivot").to_pylist(), object)[ms]  # compared before
    hit = np.zeros(t.num_rows, bool)
    for q in qs:
        fit = ms[~centre & (comp[ms] != comp[q]) & (100 * np.minimum(n[ms], n[q]) >= percent * np.maximum(n[ms], n[q]))]
        if len(fit):
            margin = 6 * np.sqrt(share * (1 - share) / np.minimum(BUCKETS, np.minimum(n[fit], n[q])))
            agree = (regs[fit] == regs[q]).mean(1)  # chance agreement only raises it
            near = fit[agree >= share - margin]
            hit[near] = True
            hit[q] |= len(near) > 0
    if hit.any():
        yield from t.filter(pa.array(hit)).select(["pivot", "id", "comp", "main", "n"]).to_batches()


def _search_sets(t: pa.Table, k: int, percent: int):
    """One link, confirmed on full sets, of each query to each other component."""
    qs, ms, comp, _ = _sides(t)
    if not len(qs) or not len(ms):
        return
    sets = list(_sets(t.column("text").combine_chunks(), k))
    size = np.array([len(x) for x in sets])
    tokens = np.concatenate([sets[m] for m in ms])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(ms)), size[ms])[order]
    ids, a, b = t.column("id").to_pylist(), [], []
    for q in qs:
        lo, hi = np.searchsorted(tokens, sets[q]), np.searchsorted(tokens, sets[q], "right")
        at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        both = np.bincount(owner[at], minlength=len(ms))
        linked = ms[(comp[ms] != comp[q]) & (100 * both >= percent * (size[ms] + size[q] - both))]
        for c in np.unique(comp[linked]):
            x, y = sorted((ids[q], ids[linked[comp[linked] == c][0]]))
            a.append(x), b.append(y)
    if a:
        kind = t.schema.field("id").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def _exact(batches, k: int, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(_sets(batch.column("text_a"), k), _sets(batch.column("text_b"), k)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            keep.append(union > 0 and 100 * both >= percent * union)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept. Linked: 100 * |A & B| >= percent * |A | B|."""
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    pair = f"a {kind}, b {kind}"

    sketches = scratch.table(texts.mapInArrow(lambda b: _sketches(b, shingle_words), f"id {kind}, n long, h1 long, h2 long, regs binary"), "sketches")
    copies = scratch.table(sketches.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs")), "classes")
    classes = copies.select("id", "n", "regs")
    bands = scratch.table(classes.select("id", "regs").mapInArrow(_bands, f"key long, id {kind}"), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    mates = scratch.table(bands.join(scratch.table(shared.select("key", "size"), "shared"), "key"), "mates")
    scratch.drop(bands)
    weights = mates.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = mates.join(weights, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("weight"), "id")).alias("pivot"))
    # The texts that can be compared at all. Merge joins at every size: a broadcast would hold ids of the corpus.
    near = scratch.table(texts.join(mates.select("id").distinct().hint("merge"), "id"), "texts")

    def estimated(pairs: DataFrame) -> DataFrame:
        sides = [classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}")) for s in "ab"]
        return reduce(lambda df, side: df.join(side, side.columns[0]), sides, pairs).mapInArrow(lambda b: _estimates(b, percent), f"{pair}, est double, spoke {kind}")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = [near.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
        return reduce(lambda df, side: df.join(side, side.columns[0]), sides, pairs).mapInArrow(lambda b: _exact(b, shingle_words, percent), pair)

    members = scratch.table(mates.join(scratch.table(pivots, "pivots"), "key").select("pivot", "id").distinct(), "members")
    spokes = members.where("id <> pivot")
    stars = scratch.table(estimated(spokes.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"), F.col("id").alias("spoke"))), "stars")
    best = stars.groupBy("spoke").agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("est"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    stars = stars.select("a", "b").distinct()
    links = scratch.table(confirmed(best), "links")
    labels = components(links, scratch)

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        named = pairs.withColumns({"x": F.col("a"), "y": F.col("b")})
        return relabel(relabel(named, labels, "x"), labels, "y").where("x <> y").select(*pairs.columns)

    more = scratch.table(confirmed(across(stars.join(best, ["a", "b"], "left_anti"))), "links")
    labels = components(more, scratch, labels)

    # What is left: documents outside their pivot's component, against all that share a band with it.
    groups = relabel(relabel(members.withColumns({"comp": F.col("id"), "main": F.col("pivot")}), labels, "comp"), labels, "main")
    odd = (F.col("comp") != F.col("main")).cast("long")
    open_ = scratch.table(groups.groupBy("pivot").agg(F.sum(odd).alias("q"), F.count("*").alias("m")).where("q > 0 AND m > 2"), "open")
    groups = scratch.table(groups.join(open_.select("pivot"), "pivot").join(classes.select("id", "n"), "id"), "groups")
    sketched = _blocks(groups, scratch).join(classes.select("id", "regs"), "id")
    hits = _in_blocks(sketched, lambda b: _search_sketches(b, percent), f"pivot {kind}, id {kind}, comp {kind}, main {kind}, n long")
    hits = scratch.table(hits.distinct(), "hits")
    found = _in_blocks(_blocks(hits, scratch).join(near, "id"), lambda b: _search_sets(b, shingle_words, percent), pair)
    labels = components(scratch.table(found.distinct(), "links"), scratch, labels)

    own = sketches.select("id", "n", "h1", "h2").join(copies.select("h1", "h2", "n", F.col("id").alias("component_id")), ["h1", "h2", "n"], "left")
    out = relabel(own, labels, "component_id").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
