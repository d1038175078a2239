"""Benchmark decontamination by size-partitioned MinHash containment search.

Which benchmark items does a document contain? An item of 30 shingles inside a
document of 10,000 has a Jaccard similarity near 0.003, which no banding of
document signatures finds. The search therefore asks for containment:

* Items are partitioned by size: class c holds items of 2**c to 2**(c+1)-1
  shingles. A class has its own number of MinHash functions,
  ``min(2 * upper size, permutations)``, and its own least document size (the
  item's share that must be present).
* An item's signature is the shingle with the smallest value under each function
  of its class. A document that contains a share s of an item contains each of
  these with probability s, whatever else it holds.
* A document's shingles are looked up among the signatures of the classes that it
  is large enough for. An item is a candidate if at least one of its signature
  shingles is found (the estimate of s, found / functions, is returned). At s =
  0.8 all of 16 are missing with probability 6e-12.
* Candidates are verified: exact containment of the item's distinct shingles,
  compared as words.

Items are searched in blocks, each sent to the executors at its bounded size (at
most about ``block_items`` items and ``block_bytes`` bytes of text, but one item at
least); documents are scanned once per block and never shuffled.

Words are lower-cased (A-Z) runs without space characters; a shingle is five of
them. An item of fewer words is one shingle, found wherever its words stand one after
another: documents are looked through for runs of each length that such items have.
Null and empty
items or documents contain nothing. Items and documents without an id are searched
like others and reported with a null id. Equal items are all reported; a repeated
row, of items or documents, is reported as often as it comes. Other columns are
ignored, or pass through where documents are filtered, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quantloom.scratch import Scratch

from .words import LOWER, SPACE, mix, shingles, slices


#: Blocks of items that one pass over the documents looks for.
PASS_BLOCKS = 4


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER.tobytes()).split()


def item_shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def _signatures(texts: list[str | None], permutations: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Signature hashes (sorted), the item of each, items' sizes and numbers of functions; of items under k words, by length: hashes (sorted) and items."""
    sizes = np.zeros(len(texts), np.int64)
    uses = np.zeros(len(texts), np.int64)
    hashes, items, short = [], [], {}
    for w in slices(pa.array(texts, pa.string()), SPACE, LOWER):
        text, h = shingles(w, k)
        order = np.lexsort((h, text))
        offs = np.searchsorted(text[order], np.arange(w.n_texts + 1))
        for i in range(w.n_texts):
            own = np.unique(h[order[offs[i] : offs[i + 1]]])
            if not len(own):
                continue
            if w.counts[i] < k:
                short.setdefault(int(w.counts[i]), []).append((own[0], w.first + i))
                sizes[w.first + i] = uses[w.first + i] = 1
                continue
            upper = 1 << int(len(own)).bit_length()
            n = min(2 * upper, permutations)
            salts = mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(upper << 20))
            least = mix(own[None, :] ^ salts[:, None]).argmin(1)
            sizes[w.first + i], uses[w.first + i] = len(own), n
            hashes.append(own[least])
            items.append(np.full(n, w.first + i))
    runs = {}
    for n, found in short.items():
        found.sort()
        runs[n] = np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), sizes, uses, runs
    h, item = np.concatenate(hashes), np.concatenate(items)
    order = np.argsort(h, kind="stable")
    return h[order], item[order], sizes, uses, runs


def _short_matches(w, items: list[str | None], runs: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(text, item) of a slice's texts in which all words of an item of few words stand one after another."""
    for n, (hashes, owner) in runs.items():
        text, h = shingles(w, n)
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for i in np.unique(text[hi > lo]):
            mine = (hi > lo) & (text == i)
            own = item_shingles(w.data[w.text_offs[i] : w.text_offs[i + 1]].tobytes().split(), n)
            for c in sorted({int(c) for a, b in zip(lo[mine], hi[mine]) for c in owner[a:b]}):
                if tuple(item_words(items[c])) in own:
                    yield int(i), c


def _matches(texts: pa.Array, block, percent: int, k: int, sets: dict[int, set]):
    """(row, item index, containment, estimate) of the verified items in a column of texts."""
    _, items, (sig, owner, sizes, uses, runs), _ = block
    known, start, count = np.unique(sig, return_index=True, return_counts=True)
    mask = np.zeros(1 << 20, bool)
    mask[(known >> np.uint64(44)).astype(np.int64)] = True
    for w in slices(texts, SPACE, LOWER):
        for i, c in _short_matches(w, items, runs):
            yield w.first + i, c, 1.0, 1.0
        text, h = shingles(w, k)
        maybe = np.flatnonzero(mask[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(known, h[maybe])
        at[at == len(known)] = 0
        hit = known[at] == h[maybe]
        for i in np.unique(text[maybe[hit]]):
            mine = at[hit & (text[maybe] == i)]
            n_doc = max(int(w.counts[i]) - k + 1, 1)  # its shingles, repeats included
            votes = np.bincount(np.concatenate([owner[start[j] : start[j] + count[j]] for j in np.unique(mine)]), minlength=len(sizes))
            candidates = np.flatnonzero((votes > 0) & (100 * n_doc >= percent * sizes))
            own = item_shingles(w.data[w.text_offs[i] : w.text_offs[i + 1]].tobytes().split(), k) if len(candidates) else set()
            for c in candidates:
                if c not in sets:
                    sets[c] = item_shingles(item_words(items[c]), k)
                both = len(sets[c] & own)
                if 100 * both >= percent * len(sets[c]):
                    yield w.first + int(i), c, both / len(sets[c]), votes[c] / uses[c]


def _search(batches, block, percent: int, k: int):
    keys, _, _, kind = block.value
    sets: dict[int, set] = {}
    for batch in batches:
        found = list(_matches(batch.column(1), block.value, percent, k, sets))
        rows, items, share, estimate = zip(*found) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([keys[c] for c in items], kind), pa.array(share, pa.float64()), pa.array(estimate, pa.float64())], ["id", "item", "containment", "estimate"])


def _clean(batches, blocks: list, percent: int, k: int, at: int):
    sets: list[dict[int, set]] = [{} for _ in blocks]
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for block, known in zip(blocks, sets):
            keep[[row for row, *_ in _matches(batch.column(at), block.value, percent, k, known)]] = False
        yield batch.filter(pa.array(keep))


def _item_blocks(spark, items: DataFrame, permutations: int, k: int, block_items: int, block_bytes: int, item_col: str, item_text_col: str):
    """Broadcast blocks of items: keys, texts, signatures, key type. Items are numbered once, block by running number and size."""
    kind = to_arrow_type(items.schema[item_col].dataType)
    named = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    rows = Scratch(spark, "items").table(named.withColumns({"row": F.monotonically_increasing_id(), "bytes": F.octet_length("text")}), "items")
    n, size, most = rows.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    # An even deal by hash: the fullest block stays near the bounds, which allow for one largest item more.
    blocks = max(1, -(-n // block_items), -(-(size or 0) // max(1, block_bytes - min(most or 0, block_bytes // 2))))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item", "text").collect() if n else []
        yield spark.sparkContext.broadcast(([r[0] for r in part], [r[1] for r in part], _signatures([r[1] for r in part], permutations, k), kind))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, shingle_words: int = 5, permutations: int = 32, block_items: int = 20_000, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, item, containment, estimate): items of whose distinct shingles a document has ``percent`` or more."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, containment double, estimate double"
    parts = [texts.mapInArrow(lambda it, block=block: _search(it, block, percent, shingle_words), schema) for block in _item_blocks(docs.sparkSession, items, permutations, shingle_words, block_items, block_bytes, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, shingle_words: int = 5, permutations: int = 32, block_items: int = 20_000, block_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns; a filter without a shuffle.

    A pass looks for the items of ``PASS_BLOCKS`` blocks; with more of them, what a
    pass leaves is written for the next one.
    """
    at, scratch, before = docs.columns.index(text_col), Scratch(docs.sparkSession, "clean"), None
    found = _item_blocks(docs.sparkSession, items, permutations, shingle_words, block_items, block_bytes, item_col, item_text_col)
    group = list(islice(found, PASS_BLOCKS))
    while group:
        docs = docs.mapInArrow(lambda it, blocks=group: _clean(it, blocks, percent, shingle_words, at), docs.schema)
        group = list(islice(found, PASS_BLOCKS))
        if group:  # more items than one pass takes: a chain of passes would hold all their blocks in each task
            docs = scratch.table(docs, "pass")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
