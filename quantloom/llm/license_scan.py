"""License detection by ordered signature rules.

1. Gate. A text is looked at further only if one of a few stems occurs in its
   normalised words (every rule's match contains one of them). One Aho-Corasick
   pass over them then tells which keywords occur; a rule's regexes are tried
   only if its keyword does.
2. Rules (``license_rules``) are tried in order of priority, then as listed.
3. Overlaps. A detection goes if another one of higher priority - or of equal
   priority, longer or listed earlier - contains its word interval. Detections
   that only overlap in part all stay.
4. Base phrases are counted at every place, whatever is suppressed; their labels
   always stay.

The score is the confidence of the best detection kept: its priority / 90, at
most 1; a text without detections has 0.

Defined results: null and empty texts have no words, labels or detections.
Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII;
positions count words from 0. Repeated rows each get their result. Other columns
are ignored.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import SIGNATURES
from .words import LOWER, NOT_ALNUM, slices

#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Every rule's match holds at least one of these; they are looked for in normalised words.
GATE = tuple(s.encode() for s in ("licen", "gpl", "copyright", "spdx", "domain", "permission", "warranty", "redistribution", "cc0", "cc by", "creative", "rights", "apache", "bsd", "wtfpl", "mozilla", "mpl", "openrail", "proprietary", "agpl", "advertising", "neither", "beer", "evil", "odbl", "pddl", "clause", "ms pl", "eupl", "busl", "sspl", "perl", "ruby", "sil org", "exception", "linking", "epl", "cddl", "ofl", "fdl", "oracle", "universal", "mit no", "mulan p", "documents edl", "openssl", "unauthorized copying"))
_SPACED = np.where(NOT_ALNUM, 32, LOWER).astype(np.uint8).tobytes()


def normalised(text: bytes) -> bytes:
    """Lower-case alphanumeric words joined by one space."""
    return b" ".join(text.translate(_SPACED).split())


class Rules:
    def __init__(self, signatures=SIGNATURES):
        order = sorted(range(len(signatures)), key=lambda i: (-signatures[i][1], i))
        self.rules = [(signatures[i][0], signatures[i][1], signatures[i][2], [re.compile(p) for p in signatures[i][3]]) for i in order]
        self.keywords = ahocorasick.Automaton()
        for word in {r[2] for r in self.rules}:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def detections(self, words: str, starts: np.ndarray) -> np.ndarray:
        """Rows (first word, word after the last, priority, rule) of what remains after suppression, by place."""
        present = {word for _, word in self.keywords.iter(words)}
        found = []
        for n, (_, priority, keyword, patterns) in enumerate(self.rules):
            if keyword in present:
                for pattern in patterns:
                    spans = np.frombuffer(array("q", chain.from_iterable(m.span() for m in pattern.finditer(words))), np.int64).reshape(-1, 2)
                    if len(spans):
                        first = np.searchsorted(starts, spans[:, 0], "right") - 1
                        last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right")
                        found.append(np.stack([first, last, np.full(len(spans), priority), np.full(len(spans), n)], 1))
        return suppressed(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _outermost(rows: np.ndarray) -> np.ndarray:
    """Rows that no earlier one contains, by first word, then longest, then rule."""
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 1], rows[:, 0]))]
    before = np.maximum.accumulate(np.append(-1, rows[:-1, 1]))
    return rows[rows[:, 1] > before]


def suppressed(found: np.ndarray) -> np.ndarray:
    """Keep what no stronger detection contains. Stronger: higher priority, then longer, then listed earlier.

    Rows are (first word, word after the last, priority, rule). Priorities are taken
    from the highest down; ``outer`` holds the kept intervals that no other contains,
    whose ends ascend with their beginnings.
    """
    kept, outer = [], np.zeros((0, 4), np.int64)
    for priority in np.unique(found[:, 2])[::-1]:
        level = _outermost(found[found[:, 2] == priority])
        if len(outer):
            at = np.searchsorted(outer[:, 0], level[:, 0], "right")
            level = level[(at == 0) | (outer[np.maximum(at, 1) - 1, 1] < level[:, 1])]
        kept.append(level)
        outer = _outermost(np.concatenate([outer, level]))
    rows = np.concatenate(kept)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def word_starts(words: str) -> np.ndarray:
    """Places of the first letters of words that are joined by one space."""
    data = np.frombuffer(words.encode(), np.uint8) if words.isascii() else np.frombuffer(words.encode("utf-32-le"), np.uint32)
    return np.append(0, np.flatnonzero(data == 32) + 1)


BASE_PATTERNS = tuple((re.compile(f"(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label in BASE)


def base_places(words: str, starts: np.ndarray) -> dict[str, np.ndarray]:
    """First words of every place of each base phrase, by label."""
    out = {}
    for pattern, label in BASE_PATTERNS:
        at = np.frombuffer(array("q", (m.start() for m in pattern.finditer(words))), np.int64)
        if len(at):
            out[label] = np.searchsorted(starts, at, "right") - 1
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, base columns, labels, score and the kept detections (first, last, priority, label)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def scanned(batches):
        rules = Rules()
        names = pa.array([r[0] for r in rules.rules], pa.string())
        for batch in batches:
            for w in slices(batch.column(1), NOT_ALNUM, LOWER):
                out: dict[str, list] = {c: [] for c in kinds}
                kept = []
                for i in range(w.n_texts):
                    text = normalised(w.data[w.text_offs[i] : w.text_offs[i + 1]].tobytes())
                    base, found = {}, np.zeros((0, 4), np.int64)
                    if any(g in text for g in GATE):
                        words = text.decode()
                        starts = word_starts(words)
                        base, found = base_places(words, starts), rules.detections(words, starts)
                    ruled = {rules.rules[n][0] for n in np.unique(found[:, 3])}
                    out["n_base"].append(sum(map(len, base.values())))
                    out["first_word"].append(min((int(p[0]) for p in base.values()), default=None))
                    out["last_word"].append(max((int(p[-1]) for p in base.values()), default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base.keys() | ruled)))
                    out["score"].append(min(1.0, max(int(found[:, 2].max(initial=0)), 60 * bool(base)) / 90))
                    kept.append(found)
                rows_found = np.concatenate(kept)
                detection = pa.StructArray.from_arrays([pa.array(rows_found[:, 0]), pa.array(rows_found[:, 1]), pa.array(rows_found[:, 2], pa.int32()), names.take(pa.array(rows_found[:, 3]))], ["first", "last", "priority", "label"])
                offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
                columns = [batch.column(0).slice(w.first, w.n_texts), pa.array(w.counts, pa.int64()), *(pa.array(v, kinds[c]) for c, v in out.items()), pa.ListArray.from_arrays(offsets, detection)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", *out, "detections"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first: long, last: long, priority: int, label: string>>"
    return rows.mapInArrow(scanned, schema).withColumnRenamed("id", id_col)
