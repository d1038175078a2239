"""Quality rules: text statistics with fixed limits, and a calibrated linear model.

Model. Words (as they are) and trigrams of characters (code points) are hashed to
2048 buckets each; a text's features are the buckets' shares of its words and
trigrams. A logistic regression is fitted on labelled quality rows: at most
``max_rows`` ids of each label, chosen by hash (``sampling``), so that the driver
holds a bounded matrix. Two thirds fit the weights, one third the
calibration (Platt), weighted to the labelled table's class sizes. Texts are
scored in Arrow batches; a text is kept if no rule fails and its calibrated
probability of label 1 reaches the fixed threshold.

Defined results: null and empty texts have no words and fail the base rule.
Without both labels the model's probability is 1, so the rules alone decide. A
line counts as a duplicate if it has a word and equals an earlier line, spaces
included. Labels that are null or of unknown ids are ignored; both labels of one id
are two training rows, repeated ones one. Repeated rows each get their result. Other columns never enter a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts
from .words import _BASE, _BYTES, Words, _ranges, mix, slices, windows

WORD_BITS = CHAR_BITS = 11
WORD_DIMS, CHAR_DIMS = 1 << WORD_BITS, 1 << CHAR_BITS
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def statistics(w: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice."""
    n = w.counts
    starts_char = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=starts_char[1:])
    per_word = starts_char[w.ends] - starts_char[w.starts]
    total = np.zeros(len(per_word) + 1, np.int64)
    np.cumsum(per_word, out=total[1:])
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(SYMBOLS[w.data], out=symbols[1:])
    return {
        "n_words": n,
        "word_chars": total[w.offs[1:]] - total[w.offs[:-1]],
        "n_symbols": symbols[w.text_offs[1:]] - symbols[w.text_offs[:-1]],
        "n_dup_lines": _duplicate_lines(w),
        "n_repeat_words": _repeated_words(w, hashes),
    }


def _seen_before(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: whether an equal (text, h) came earlier, and whether there is any other."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    earlier, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    other[order] = twice
    return earlier, other


def _duplicate_lines(w: Words) -> np.ndarray:
    breaks = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.text_offs[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([w.text_offs[1:], breaks]))
    # a line has a word if a word begins in it
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[worded], ends[worded]
    if not len(starts):
        return np.zeros(w.n_texts, np.int64)
    h = mix(_ranges(_BYTES[w.data], _BASE, starts, ends) + (ends - starts).astype(np.uint64))
    text = np.searchsorted(w.text_offs, starts, "right") - 1
    return np.bincount(text, _seen_before(text, h)[0], w.n_texts).astype(np.int64)


def _repeated_words(w: Words, hashes: np.ndarray) -> np.ndarray:
    pos, h = windows(hashes, w.offs, 3)
    if not len(pos):
        return np.zeros(w.n_texts, np.int64)
    text = np.searchsorted(w.offs, pos, "right") - 1
    again = pos[_seen_before(text, h)[1]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(cover)[:-1] > 0, out=covered[1:])
    return covered[w.offs[1:]] - covered[w.offs[:-1]]


def buckets(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each character trigram, and where each text's trigrams begin and end."""
    words = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    code = np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=chars[1:])
    offs = chars[w.text_offs]
    key = code[:-2] * np.uint32(0x85EBCA6B) + code[1:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F) if len(code) > 2 else np.zeros(0, np.uint32)
    grams = (key ^ key >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - CHAR_BITS)
    first = np.minimum(offs[:-1], len(grams))
    last = np.clip(offs[1:] - 2, first, len(grams))
    return words, grams, first, last


@dataclass
class QualityModel:
    word_weights: np.ndarray
    char_weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        """Mean weights on an integer grid: a text's sum does not depend on its neighbours."""
        words, grams, first, last = buckets(w, hashes)
        grid = 2.0 ** (30 - math.ceil(math.log2(max(np.abs(self.word_weights).max(), np.abs(self.char_weights).max(), 1e-12))))

        def means(weights: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
            total = np.zeros(len(places) + 1, np.int64)
            np.cumsum(np.rint(weights * grid).astype(np.int64)[places], out=total[1:])
            return (total[hi] - total[lo]) / grid / np.maximum(n, 1)

        return means(self.word_weights, words, w.offs[:-1], w.offs[1:], w.counts) + means(self.char_weights, grams, first, last, last - first) + self.bias

    def probability(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(w, hashes) + self.shift, -30, 30)))


def _shares(batches):
    """Dense feature rows of the training sample."""
    for batch in batches:
        for w in slices(batch.column(0)):
            h = w.hashes()
            words, grams, first, last = buckets(w, h)
            x = np.zeros((w.n_texts, WORD_DIMS + CHAR_DIMS), np.float32)
            for i in range(w.n_texts):
                x[i, :WORD_DIMS] = np.bincount(words[w.offs[i] : w.offs[i + 1]], minlength=WORD_DIMS) / max(1, w.counts[i])
                x[i, WORD_DIMS:] = np.bincount(grams[first[i] : last[i]], minlength=CHAR_DIMS) / max(1, last[i] - first[i])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(w.first, w.n_texts), batch.column(2).slice(w.first, w.n_texts)], ["x", "y", "fold"])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the bias."""
    w = v = np.zeros(x.shape[1] + 1)
    rate = 1 / (0.25 * float((weight * ((x**2).sum(1) + 1)).sum()) + ridge)
    for k in range(rounds):
        z = np.clip(x @ v[:-1].astype(np.float32) + v[-1], -30, 30)
        g = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(x.T @ g.astype(np.float32), g.sum()) + ridge * np.append(v[:-1], 0)
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, rounds: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    sample, counts = labelled_texts(docs, labels, label_col, {0: max_rows, 1: max_rows}, "quality", id_col, text_col)
    if len(counts) < 2:
        return None
    rows = sample.mapInArrow(_shares, "x binary, y int, fold int").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), -1)
    y, fold = np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    n = np.array([(y == c).sum() for c in (0, 1)])
    if not n.all():
        return None
    fit, check = fold != 0, fold == 0
    if min(len(set(y[fit])), len(set(y[check]))) < 2:
        fit = check = np.ones(len(y), bool)
    mean, spread = x[fit].mean(0), x[fit].std(0) + 1e-4
    z = (x - mean) / spread / np.float32(np.sqrt(x.shape[1]))
    even = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w = _fit(z[fit], y[fit], even[fit] / even[fit].sum(), 1e-3, rounds)
    margin = z[check] @ w[:-1] + w[-1]
    # Platt scaling on the held-out third, weighted to the class sizes of all labels
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])[check]
    a, b = _platt(margin, y[check], weight)
    scaled = w[:-1] / spread / np.sqrt(x.shape[1])
    return QualityModel(scaled[:WORD_DIMS], scaled[WORD_DIMS:], float(w[-1] - mean @ scaled), a, b)


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([margin, np.ones(len(margin))])
    weight = weight * len(y) / weight.sum()
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return float(w[0]), float(w[1])


def quality(docs: DataFrame, model: QualityModel | None, min_words: int = 50, max_repeat: int = 50, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scored(batches):
        for batch in batches:
            for w in slices(batch.column(1)):
                h = w.hashes()
                s = statistics(w, h)
                p = shared.value.probability(w, h) if shared.value is not None else np.ones(w.n_texts)
                failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat * s["n_words"])
                arrays = [batch.column(0).slice(w.first, w.n_texts), *map(pa.array, s.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *s, "base_failed", "probability", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_col)
