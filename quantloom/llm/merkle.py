"""Merkle manifest of a dataset, with a proof for every row.

A leaf is the SHA-256 of a row's fields: for each field its UTF-8 byte count, a colon
and the value, or ``-`` if it is null (integers in decimal). Digests are hashed as
lowercase hexadecimal text. A tree (one a language) holds its leaves by ascending id;
as long as it has several nodes, every eight neighbours become one node, the last run
from what is left, even from one. The roots of the trees, by name (null first, then
by UTF-8 bytes), are the leaves of one more tree, whose root stands for the dataset.

Traversal. Leaves are cut into aligned blocks of 8**4, each a perfect subtree but for
the last. In a block, ``paths`` goes from leaf to leaf: each level keeps the run in
which the current leaf's ancestor stands, and a treehash stack that meanwhile reads
one leaf a step and has the next run ready when it is needed. So a block takes
memory logarithmic in its leaves beside the digests themselves. Block roots are the
leaves of the level above, in blocks again (a round divides the rows by 4,096), until
each tree has one node. Then paths are handed down: the path of a block's root is the
same for all its rows and is appended to theirs.

Rows are numbered by range partitions, so a tree may span any number of tasks; blocks
are the only groups. Text is hashed in the scan and never shuffled.

Null ids come first in their tree. Rows of one id are ordered by their leaves; equal
rows are leaves of their own. A null tree name is a tree. A table without rows gives
no rows and no root. Empty and very long texts are hashed like others. Columns other
than the fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.ordering import numbered
from quantloom.scratch import Scratch

ARITY, HEIGHT = 8, 4
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of a row's fields, null as ``-``."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*told), 256)


def joint(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class Treehash:
    """Nodes of one level, made from leaves that come one by one; holds at most seven digests a level."""

    def __init__(self, level: int):
        self.level, self.tails, self.nodes = level, [[] for _ in range(level)], []

    def _rise(self, node: str, at: int) -> None:
        while at < self.level:
            self.tails[at].append(node)
            if len(self.tails[at]) < ARITY:
                return
            node, self.tails[at], at = joint(self.tails[at]), [], at + 1
        self.nodes.append(node)

    def feed(self, leaf: str) -> None:
        self._rise(leaf, 0)

    def finish(self) -> None:
        """No more leaves: runs that are not full become nodes."""
        for at in range(self.level):
            if self.tails[at]:
                node, self.tails[at] = joint(self.tails[at]), []
                self._rise(node, at + 1)

    def taken(self) -> list[str]:
        out, self.nodes = self.nodes, []
        return out


def block_root(leaves: Sequence[str], height: int) -> str:
    tree = Treehash(height)
    for leaf in leaves:
        tree.feed(leaf)
    tree.finish()
    return tree.nodes[0]


def paths(leaves: Sequence[str], height: int) -> Iterator[list[tuple[list[str], int]]]:
    """For each leaf in order: of each level the run with its ancestor, and the ancestor's place in the run."""
    n, spans = len(leaves), [ARITY ** (k + 1) for k in range(height)]
    trees, runs = [Treehash(k) for k in range(height)], []
    for tree, span in zip(trees, spans):
        for leaf in leaves[:span]:
            tree.feed(leaf)
        if span >= n:
            tree.finish()
        runs.append(tree.taken())
    for i in range(n):
        yield [(runs[k], i // (span // ARITY) % ARITY) for k, span in enumerate(spans)]
        for k, (tree, span) in enumerate(zip(trees, spans)):
            if i + span < n:
                tree.feed(leaves[i + span])
                if i + span == n - 1:
                    tree.finish()
            if (i + 1) % span == 0:
                runs[k] = tree.taken()


def told(path: list[tuple[list[str], int]]) -> tuple[bytes, bytes]:
    """A path as raw sibling digests, left to right and level by level, and for each level (left ones, all) as two bytes."""
    siblings = "".join("".join(run[:at]) + "".join(run[at + 1 :]) for run, at in path)
    return bytes.fromhex(siblings), bytes(x for run, at in path for x in (at, len(run) - 1))


def folded(leaf: str, siblings: bytes, shape: bytes) -> str:
    """The root that a leaf and its siblings give."""
    text, at = siblings.hex(), 0
    for left, others in zip(shape[::2], shape[1::2]):
        mid, end = at + 64 * left, at + 64 * others
        leaf = sha256((text[at:mid] + leaf + text[mid:end]).encode()).hexdigest()
        at = end
    return leaf


def height_of(n: int) -> int:
    """Levels inside a block of a tree of n leaves."""
    height = 0
    while height < HEIGHT and ARITY**height < n:
        height += 1
    return height


def _roots(block: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    n, place = block["n"][0].as_py(), block["place"][0].as_py()
    return pa.table({"tree": block["tree"][:1], "place": [place // BLOCK], "digest": [block_root(block["digest"].to_pylist(), height_of(n))], "n": [-(-n // BLOCK)]})


_PATH = "_siblings binary, _shape binary, subroot string"


def _handed_down(block: pa.Table, above: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of a block with their paths: through the block, then the path of its root."""
    block = block.drop_columns([c for c in ("_block",) if c in block.column_names]).sort_by("place").combine_chunks()
    upper, shape = above["_siblings"][0].as_py(), above["_shape"][0].as_py()
    subroot = above["subroot"][0].as_py()
    steps = paths(block["digest"].to_pylist(), height_of(block["n"][0].as_py()))
    for batch in block.to_batches(max_chunksize=1024):
        own = [told(next(steps)) for _ in range(batch.num_rows)]
        extra = [pa.array([s + upper for s, _ in own], pa.binary()), pa.array([s + shape for _, s in own], pa.binary()), pa.array([subroot] * batch.num_rows, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_siblings", "_shape", "subroot"])


def _ddl(df: DataFrame, drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop)


def _climbed(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """nodes (tree, place from 0, digest, n) and the block roots above them, until each tree has one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        block = rounds[-1].select("tree", "place", "digest", "n", F.expr(f"place div {BLOCK}").alias("_block"))
        rounds.append(scratch.table(block.groupBy("tree", "_block").applyInArrow(_roots, "tree string, place long, digest string, n long"), "roots"))
    return rounds


def _descended(rounds: list[DataFrame], top: DataFrame, scratch: Scratch) -> DataFrame:
    """The first round's rows with their paths; ``top``: (tree, place 0, _siblings, _shape, subroot)."""
    for nodes in reversed(rounds[:-1]):
        blocks = nodes.withColumn("_block", F.expr(f"place div {BLOCK}"))
        above = top.select("tree", F.col("place").alias("_block"), "_siblings", "_shape", "subroot")
        out = blocks.groupBy("tree", "_block").cogroup(above.groupBy("tree", "_block")).applyInArrow(lambda a, b: pa.Table.from_batches(_handed_down(a, b)), f"{_ddl(nodes)}, {_PATH}")
        top = out if nodes is rounds[0] else scratch.table(out, "paths")
    return top


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", claimed: Column | None = None) -> DataFrame:
    """id, leaf, tree_size, place, subroot, root, siblings, shape (and ``claimed``, a leaf to be checked) of every row.

    ``siblings``: raw digests of all levels up to the root; ``shape``: for each level
    the number of siblings on the left, and of all, a byte each.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    name = F.col(tree_col).cast("string")
    leaves = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("tree"),
        F.col(id_col).alias("id"), digest([F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    ranked = numbered(leaves.withColumn("_copy", F.monotonically_increasing_id()), "tree", "id", "digest", "_copy", within=("tree",), name="place", scratch=scratch)
    ranked = scratch.table(ranked.select("tree", "id", "digest", "claimed", (F.col("place") - 1).alias("place")), "leaves")
    sizes = scratch.table(ranked.groupBy("tree").agg((F.max("place") + 1).alias("n")), "trees")
    block = ranked.withColumn("_block", F.expr(f"place div {BLOCK}"))
    blocks = block.select("tree", "_block").distinct().join(sizes, "tree")
    rounds = _climbed(scratch.table(block.join(blocks, ["tree", "_block"]).drop("_block"), "nodes"), scratch)

    subroots = rounds[-1].select("tree", "digest")
    n_trees = subroots.count()
    order = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name", name="place", scratch=scratch)
    upper = _climbed(scratch.table(order.select("tree", "name", "digest", (F.col("place") - 1).alias("place"), F.lit(n_trees).cast("long").alias("n")), "subroots"), scratch)
    peak = upper[-1].first()
    root = peak["digest"] if peak else None
    none = F.lit(b"")
    top = upper[-1].select("tree", "place", none.alias("_siblings"), none.alias("_shape"), F.lit(None).cast("string").alias("subroot"))
    if len(upper) == 1:
        top = top.join(upper[0].select("place", "name", "digest"), "place")
    named = _descended(upper, top, scratch)
    starts = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "_siblings", "_shape", F.col("digest").alias("subroot"))
    whole = _descended(rounds, starts, scratch)
    if len(rounds) == 1:
        whole = rounds[0].join(starts.drop("place"), "tree")
    return whole.select("id", F.col("digest").alias("leaf"), F.col("n").alias("tree_size"), "place", "subroot", F.lit(root).cast("string").alias("root"), F.col("_siblings").alias("siblings"), F.col("_shape").alias("shape"), "claimed")


def verify(rows: DataFrame, leaf_col: str = "claimed") -> DataFrame:
    """Adds folded_root, the root that ``leaf_col`` and the row's siblings give, and verified."""

    def fold(batches):
        for batch in batches:
            roots = [folded(*x) for x in zip(*(batch.column(c).to_pylist() for c in (leaf_col, "siblings", "shape")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "folded_root"])

    return rows.mapInArrow(fold, f"{_ddl(rows)}, folded_root string").withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_col: str, text_col: str, every: int) -> Column:
    """The text, its A-Z lower-cased where ``every`` divides the checksum of the id."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text_col))


def audited(docs: DataFrame, every: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proofs of the documents' manifest, checked against documents some of which were changed since."""
    changed = digest([tampered(id_col, text_col, every) if c == text_col else F.col(c) for c in FIELDS])
    rows = verify(manifest(docs, id_col=id_col, claimed=changed))
    proof = F.sha2(F.lower(F.hex("siblings")), 256)
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
