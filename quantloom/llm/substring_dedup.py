"""Substring dedup by level-wise doubling.

A window is ``min_words`` consecutive words of one text. A window is repeated if
the same word sequence starts in a text with a smaller id; each word that a
repeated window covers is removed.

Levels, each of about twice the words of the one before (13, 25, 50):

1. a quarter of a window. Only window minimisers are taken: of the quarter-length
   windows inside each full window, the one with the smallest hash. Equal full
   windows choose the same minimiser, so none is missed, and about 2 in 40
   positions are shuffled instead of all. Those that two texts hold go on; where
   the words of all full windows around are the same in a text with a smaller id,
   all these windows are repeated, and one row says so.
2. half a window. Where the surroundings differ, one text of each kind extends its
   minimiser to both sides; of two half windows, one at least lies inside any full
   window that the minimiser stands for. Kinds whose half windows occur in no
   second text end here.
3. full windows around what is left, compared one by one. No candidate is left
   after that: whether a longer window is repeated too does not change which words
   go.

Hot passages: smallest ids are aggregated inside map tasks before the shuffle,
and the joins that bring them back to the places can be split by adaptive
execution. Copies of a text stop at level 1, so a large group of copies is
linear in its size.

Defined results: null text is an empty text (no words, nothing removed, digest
of the empty string). A text that repeats a window only within itself keeps it.
Rows with one id are of one rank, whatever their texts: neither is smaller, each
is judged by itself, and repeated rows all lose the same words. A null id is
neither smaller nor larger than others: such a text keeps everything. Texts
shorter than a window are unchanged. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.scratch import Scratch

from .words import SPACE, mix, range_hashes, slices, windows


def _slide(h: np.ndarray, width: int, op) -> np.ndarray:
    """op over h[i : i + width], for every i where the window fits."""
    span, out = 1, h
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = op(out[: len(out) - rest], out[rest:])
    return out


def minimisers(h: np.ndarray, offs: np.ndarray, k: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the k-word windows that are smallest inside some full window."""
    pos, out = windows(h, offs, full)  # where a full window starts
    if not len(pos):
        return pos, out
    at, hk = windows(h, offs, k)
    dense = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
    dense[at] = hk
    width = full - k + 1
    least = np.zeros(len(h) + width, np.uint64)  # smallest hash of the full window that starts here; 0: there is none
    slid = _slide(dense, width, np.minimum)
    least[pos + width - 1] = slid[pos]
    most = _slide(least, width, np.maximum)[: len(h)]  # largest such of the full windows that hold position i
    chosen = at[most[at] == hk]
    return chosen, dense[chosen]


def _anchors(batches, k: int, half: int, full: int):
    """Minimisers with their place, hashes of the half windows on both sides, and of the words of all full windows around them."""
    for batch in batches:
        ids, rows = batch.column(0), batch.column(1)
        for w in slices(batch.column(2), SPACE):
            words = w.hashes()
            pos, h = minimisers(words, w.offs, k, full)
            if not len(pos):
                continue
            text = np.searchsorted(w.offs, pos, "right") - 1
            first, last = w.offs[text], w.offs[text + 1]
            lo = np.maximum(pos - (full - k), first)
            around = mix(range_hashes(words, lo, np.minimum(pos + full, last)) ^ (pos - lo).astype(np.uint64))
            ahead = pa.array(range_hashes(words, pos, np.minimum(pos + half, last)).view(np.int64), mask=pos + half > last)
            behind = pa.array(range_hashes(words, np.maximum(pos - (half - k), first), pos + k).view(np.int64), mask=pos - (half - k) < first)
            at = pa.array(text + w.first)
            arrays = [pa.array(h.view(np.int64)), ids.take(at), rows.take(at), pa.array((pos - first).astype(np.int32)), pa.array(around.view(np.int64)), ahead, behind]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "id", "t", "pos", "around", "ahead", "behind"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False), offs


def _doubled(batches, k: int, full: int):
    """Hashes of the full windows around each given minimiser of a text."""
    for batch in batches:
        ids, rows, texts = batch.column(0), batch.column(1), batch.column(2)
        at, at_offs = _flat(batch.column(3))
        for w in slices(texts, SPACE):
            h = w.hashes()
            near = np.zeros(len(h) + 1, np.int64)
            a = at_offs[w.first : w.first + w.n_texts + 1]
            base = np.repeat(w.offs[:-1], np.diff(a)) + at[a[0] : a[-1]]
            np.add.at(near, np.maximum(base - (full - k), np.repeat(w.offs[:-1], np.diff(a))), 1)
            np.add.at(near, base + 1, -1)
            pos, out = windows(h, w.offs, full)
            keep = np.cumsum(near)[pos] > 0
            pos, out = pos[keep], out[keep]
            text = np.searchsorted(w.offs, pos, "right") - 1
            for lo in range(0, len(pos), 1 << 17):
                cut = slice(lo, lo + (1 << 17))
                of = pa.array(text[cut] + w.first)
                yield pa.RecordBatch.from_arrays([pa.array(out[cut].view(np.int64)), ids.take(of), rows.take(of), pa.array((pos[cut] - w.offs[text[cut]]).astype(np.int32))], ["h", "id", "t", "pos"])


def _cleaned(batches, with_text: bool):
    """Columns id, text, first, last and any others -> id, counts, digest, the kept text if asked for, the others."""
    for batch in batches:
        n_words, n_removed, digest, out = [], [], [], []
        for text, first, last in zip(batch.column(1), batch.column(2), batch.column(3)):
            words = kept = (text.as_py() or "").encode().split()
            if first.is_valid and len(first.values):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, first.values.to_numpy(), 1)
                np.add.at(cover, np.minimum(last.values.to_numpy(), len(words)), -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                out.append(joined.decode() if len(kept) < len(words) else text.as_py())
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(out, pa.string()))
            names.append("text")
        yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[4:]], names + batch.schema.names[4:])


def repeated_ranges(docs: DataFrame, scratch: Scratch, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, first, last, and as _c0.. the carried columns): each text with the word ranges that its repeated windows cover; null where none."""
    half, full = min_words // 2, min_words
    k = (half + 1) // 2
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))  # t tells apart texts of one id
    id_type = texts.schema["id"].dataType.simpleString()
    row = f"h long, id {id_type}, t long, pos int"
    anchors = scratch.table(texts.where("id IS NOT NULL").mapInArrow(lambda b: _anchors(b, k, half, full), f"{row}, around long, ahead long, behind long"), "anchors")
    # level 1: minimisers of two texts
    ids = anchors.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), (F.min("around") == F.max("around")).alias("same"))
    ids = scratch.table(ids.where("least < most").drop("most"), "repeated")  # written, so that both sides of the join are plain shuffles, which AQE can split
    found = scratch.table(anchors.join(ids, "h"), "found")
    scratch.drop(anchors, ids)
    span = (F.greatest(F.col("pos") - (full - k), F.lit(0)).alias("first"), (F.col("pos") + full).alias("last"))
    mixed = found.where("not same").drop("least", "same")
    kinds = scratch.table(mixed.groupBy("h", "around").agg(F.min("id").alias("least")), "kinds")
    mixed = scratch.table(mixed.join(kinds, ["h", "around"]), "mixed")
    gone = found.where("same").select("id", "t", "pos", "least").unionByName(mixed.select("id", "t", "pos", "least")).where("least < id").select("id", "t", *span)
    # level 2: half windows of one text of each kind
    sides = mixed.where("least = id").select("h", "id", "t", "pos", F.explode(F.array_compact(F.array("ahead", "behind"))).alias("w"))
    sides = scratch.table(sides, "sides")
    shared = sides.groupBy("h", "w").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h", "w")
    at = sides.join(scratch.table(shared, "halves"), ["h", "w"]).groupBy("id", "t").agg(F.collect_set("pos").alias("at"))
    # level 3: full windows around them
    wide = scratch.table(texts.join(at, ["id", "t"]).select("id", "t", "text", "at").mapInArrow(lambda b: _doubled(b, k, full), row), "wide")
    ids = wide.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    ids = scratch.table(ids, "repeated")
    single = wide.join(ids, "h").where("least < id").select("id", "t", F.col("pos").alias("first"), (F.col("pos") + full).alias("last"))
    ranges = gone.union(single).groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    ranges = scratch.keep(ranges.select("id", "t", F.col("r.first").alias("first"), F.col("r.last").alias("last")), "ranges")
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    return whole.join(ranges, ["id", "t"], "left").select("id", "text", "first", "last", *whole.columns[3:])


def substring_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per text: id, n_words, n_removed, kept_sha256 and, if asked for, the kept text and other columns.

    A text that loses nothing keeps its spacing; one that loses words is its kept
    words joined by one space. ``kept_sha256`` is always of the joined words.
    """
    if min_words < 4 or min_words % 2:
        raise ValueError("min_words must be even and 4 at least: it is halved twice")
    places = repeated_ranges(docs, Scratch(docs.sparkSession, "substring"), min_words, id_col, text_col, carry)
    made = [("id", docs.schema[id_col].dataType), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    made += [("text", T.StringType())] * with_text
    schema = T.StructType([T.StructField(*f) for f in made] + [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])
    out = places.mapInArrow(lambda b: _cleaned(b, with_text), schema)
    return out.toDF(*[{"id": id_col, "text": text_col}.get(c, c) for c in schema.names[: len(made)]], *carry)
