"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM over sentences.

Sentences. A text is cut at space characters into pieces, and into sentences where
``.``, ``!``, ``?`` or a line feed stands between the last letter of a piece and the
first of the next. Inside a piece, letters are folded (case, common digit-for-letter
swaps) and everything else is dropped, so ``i.d-i*o_t`` is one unit ``idiot``; runs of
single letters are joined (``i d i o t``). Pieces longer than 12 letters are seen
through overlapping windows of 12. Further units are runs of neighbouring pieces of
one sentence, glued: of two or three pieces up to 24 letters, of more up to 12
letters. Pieces and runs of two or three letters get a mark at both ends, so that
they hold quadruples too. Letters beyond ASCII have five codes between them, so words
of other scripts are told apart only coarsely.

Kernel. The gap-weighted subsequence kernel of order 4: two strings share every
quadruple of letters that both hold in order, weighted decay**span; spans of up
to 7 letters count, so up to three inserted letters inside a quadruple are
tolerated. Values are divided by the norm of a string of that length. A sentence
is worth its best unit.

Training, on a bounded, hash-chosen sample of the labelled documents (``max_toxic``
and ``max_clean``), whose sentences carry their document's label.

1. Landmarks: the units that are enriched in toxic sentences beyond chance (runs only
   if they hold no such piece) and, as background, common units of clean ones. A unit
   counts once a document, and equal sentences are of one document, so that neither
   copies of a document nor its own repetitions prove anything.
   Features are K(landmarks)**-1/2 k(unit, landmarks).
2. A first SVM (squared hinge) tells the enriched units from units of clean documents.
3. Then the SVM is fitted on sentences, ``rounds`` times: of every toxic document the
   sentence that scores highest, if it is taken for toxic so far - a label speaks of a
   document, not of each of its sentences -, against the highest one of every clean
   document, each seen through its best unit.

Scoring. The decision function over landmarks is one weight for each letter
quadruple, so all units are scored from running sums of table look-ups, one pass
over the letters. A document's features are its best sentence and the numbers of
pieces and of sentences above 1/2, which can only raise the probability, and its
length, since a long text holds more by chance. Logistic calibration, fitted on the
third of the sample that the SVM did not see and weighted to the labelled table's
class sizes, makes them a probability.

Defined results: null and empty texts get the probability of a text without
units. Without both classes among the labels the score is 0 for all. Labels of
ids that are not in the documents, null labels and null ids are ignored; both labels
of one id are two rows, repeated ones one. Repeated documents each get their score.
Other columns never enter a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.scratch import Scratch

from .sampling import labelled_texts
from .words import _BASE, _BYTES, _ranges, mix, slices

ORDER, SPAN, DECAY, LONGEST, STEP = 4, 7, 0.6, 12, 6
#: Letters of a run of up to PIECES pieces; longer runs have up to LONGEST.
RUN, PIECES = 24, 3
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?\n")] = True
#: Stands at both ends of units shorter than ORDER; no letter has this code.
MARK = b"\0"
#: Offsets of the second to fourth letter of a quadruple.
GAPS = [(a, b, c) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)]

CODE = np.zeros(256, np.uint8)
CODE[97:123] = CODE[65:91] = np.arange(1, 27)
for digit, letter in zip(b"01345790@$", b"oieastgoas"):
    CODE[digit] = letter - 96
CODE[0x80:0xC0] = 27  # letters beyond ASCII: see ``letter_codes``

_NORMS = np.zeros(RUN + 1)
for _n in range(RUN + 1):
    _NORMS[_n] = np.sqrt(sum(max(0, _n - c) * DECAY ** (2 * (c + 1)) for *_, c in GAPS)) or 1.0


def letter_codes(data: np.ndarray) -> np.ndarray:
    """0 where no letter stands, else its code; a byte that continues a character counts with the one before it."""
    code = CODE[data]
    more = np.flatnonzero(code == 27)
    code[more] = 27 + (data[more].astype(np.int64) + 3 * data[more - 1]) % 5
    return code


def unit_ranges(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters, and of each unit first, last, text, whether it is a run, and sentence; units of a sentence follow each other."""
    code = letter_codes(words.data)
    at = np.flatnonzero(code)
    letters = code[at]
    kept = np.zeros(len(code) + 1, np.int64)
    np.cumsum(code > 0, out=kept[1:])
    first, last, text = kept[words.starts], kept[words.ends], words.text_of()
    some = last > first
    first, last, text = first[some], last[some], text[some]
    single = last - first == 1
    glue = np.zeros(len(first), bool)
    glue[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    begins = np.flatnonzero(~glue)
    if not len(begins):
        return letters, first, last, text, glue, text
    first, last, text = first[begins], last[np.r_[begins[1:] - 1, len(last) - 1]], text[begins]
    ends = np.r_[0, np.cumsum(SENTENCE_END[words.data])]
    new = np.ones(len(first), bool)
    new[1:] = (text[1:] != text[:-1]) | (ends[at[first[1:]]] > ends[at[last[:-1] - 1]])
    sentence = np.cumsum(new)
    runs = []
    begin = np.arange(len(first))
    for n in range(2, LONGEST + 1):
        begin = begin[begin + n <= len(first)]
        end = begin + n - 1
        ok = (sentence[begin] == sentence[end]) & (last[end] - first[begin] <= (RUN if n <= PIECES else LONGEST))
        begin, end = begin[ok], end[ok]
        if not len(begin):
            break
        runs.append((first[begin], last[end], text[begin], sentence[begin]))
    size = last - first
    extra = np.maximum(0, -(-(size - LONGEST) // STEP))  # further windows of long pieces
    if extra.any():
        which = np.repeat(np.arange(len(first)), extra + 1)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        first = first[which] + nth * STEP
        last = np.minimum(first + LONGEST, last[which])
        text, sentence = text[which], sentence[which]
    run = np.repeat([False, True], [len(first), sum(len(r[0]) for r in runs)])
    first, last, text, sentence = (np.concatenate(x) for x in zip((first, last, text, sentence), *runs))
    order = np.argsort(sentence, kind="stable")
    order = order[(last - first)[order] > 1]
    return letters, first[order], last[order], text[order], run[order], sentence[order]


def marked(unit: bytes) -> bytes:
    return unit if len(unit) >= ORDER else MARK + unit + MARK


def quadruples(letters: np.ndarray, first: np.ndarray, last: np.ndarray):
    """(unit, quadruple, weight) of each quadruple of each unit; letters of the units must follow each other."""
    size = last - first
    unit = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    stop = np.repeat(last, size)
    wide = letters.astype(np.int32)
    for a, b, c in GAPS:
        ok = at + c < stop
        i = at[ok]
        yield unit[ok], wide[i] << 15 | wide[i + a] << 10 | wide[i + b] << 5 | wide[i + c], DECAY ** (c + 1)


def _packed(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(u) for u in units], np.int64)
    last = np.cumsum(size)
    return np.frombuffer(b"".join(units), np.uint8), last - size, last


def kernel(units: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    letters, first, last = _packed(landmarks)
    rows = [(u, q, np.full(len(u), w)) for u, q, w in quadruples(letters, first, last)]
    unit, quad, weight = (np.concatenate(x) for x in zip(*rows))
    known, local = np.unique(quad, return_inverse=True)
    z = np.zeros((len(known), len(landmarks)), np.float32)
    np.add.at(z, (local, unit), (weight / _NORMS[last - first][unit]).astype(np.float32))
    letters, first, last = _packed(units)
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for unit, quad, weight in quadruples(letters, first, last):
        at = np.minimum(np.searchsorted(known, quad), len(known) - 1)
        hit = known[at] == quad
        np.add.at(out, unit[hit], z[at[hit]] * np.float32(weight))
    return out / _NORMS[last - first][:, None]


@dataclass
class ToxicModel:
    """weights: one for each letter quadruple; bias of the unit score; calibration: weights of the features."""

    weights: np.ndarray
    bias: float
    calibration: np.ndarray

    def unit_scores(self, letters: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scores of letters[first:last]; sums are of integers, so that they do not depend on what else a slice holds."""
        n, wide, grid = len(letters), letters.astype(np.int32), 1 << 24
        total, by_reach = np.zeros(n), []  # of quadruples that begin at a letter and reach at most 3, 4, 5, 6 letters on
        for reach in range(ORDER - 1, SPAN):
            m = max(0, n - reach)
            for a, b, c in GAPS:
                if c == reach:
                    total[:m] += self.weights[wide[:m] << 15 | wide[a : a + m] << 10 | wide[b : b + m] << 5 | wide[c : c + m]] * DECAY ** (c + 1)
            by_reach.append(np.rint(total * grid).astype(np.int64))
        running = np.zeros(n + 1, np.int64)
        np.cumsum(by_reach[-1], out=running[1:])
        out = running[np.maximum(first, last - SPAN + 1)] - running[first]
        for reach, part in zip(range(ORDER - 1, SPAN - 1), by_reach):
            at = last - reach - 1
            out += np.where(at >= first, part[np.maximum(at, 0)], 0)
        out = out / grid / _NORMS[last - first]
        short = np.flatnonzero(last - first < ORDER)
        if len(short):
            key = sum(np.where(first[short] + i < last[short], wide[np.minimum(first[short] + i, n - 1)], 0) << 5 * i for i in range(ORDER - 1))
            _, one, back = np.unique(key, return_index=True, return_inverse=True)
            raw = letters.tobytes()
            own, begin, end = _packed([marked(raw[first[i] : last[i]]) for i in short[one]])
            score = np.zeros(len(one))
            for unit, quad, weight in quadruples(own, begin, end):
                score += np.bincount(unit, self.weights[quad] * weight, len(one))
            out[short] = (score / _NORMS[end - begin])[back]
        return out + self.bias

    def sentences(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters, and of each sentence its text, the score of its best unit, and where that begins and ends."""
        letters, first, last, text, _, sentence = unit_ranges(w)
        if not len(first):
            return letters, text[:0], np.zeros(0), first, last
        score = self.unit_scores(letters, first, last)
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        top = np.maximum.reduceat(score, starts)
        best = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[starts, len(score)])))
        best = best[np.r_[True, sentence[best][1:] != sentence[best][:-1]]]
        return letters, text[starts], top, first[best], last[best]

    def features(self, texts: pa.Array) -> np.ndarray:
        """1, the log number of pieces (may lower the probability), the best score, log counts of pieces and of sentences above 1/2."""
        out = np.zeros((len(texts), 5))
        out[:, 0], out[:, 2] = 1, -1.0
        for w in slices(texts):
            letters, first, last, text, run, sentence = unit_ranges(w)
            if not len(first):
                continue
            score = self.unit_scores(letters, first, last)
            new = np.r_[True, text[1:] != text[:-1]]
            starts, sents = np.flatnonzero(new), np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            rows = w.first + text[starts]
            out[rows, 1] = np.log1p(np.add.reduceat((~run).astype(float), starts))
            out[rows, 2] = np.clip(np.maximum.reduceat(score, starts), -1, 1)
            out[rows, 3] = np.log1p(np.add.reduceat((~run & (score > 0.5)).astype(float), starts))
            hit = np.bincount(text[sents], np.maximum.reduceat(score, sents) > 0.5, w.n_texts)
            out[rows, 4] = np.log1p(hit[text[starts]])
        return out

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.calibration, -30, 30)))


def sentence_hashes(letters: np.ndarray, first: np.ndarray, last: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence's units begin, and a hash of its letters."""
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    a, b = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)
    return starts, mix(_ranges(_BYTES[letters], _BASE, a, b) + (b - a).astype(np.uint64)).view(np.int64)


def _sentences(batches):
    """(sentence, doc, toxic, text): each sentence with the hashes of its letters and of its whole text's, and the label."""
    for batch in batches:
        for w in slices(batch.column(0), max_bytes=1 << 19):
            letters, first, last, text, _, sentence = unit_ranges(w)
            if not len(first):
                continue
            starts, hashes = sentence_hashes(letters, first, last, sentence)
            _, docs = sentence_hashes(letters, first, last, text)
            of = np.cumsum(np.r_[False, text[1:] != text[:-1]])[starts]
            at = np.flatnonzero(letter_codes(w.data))
            begin, end = at[np.minimum.reduceat(first, starts)], at[np.maximum.reduceat(last, starts) - 1] + 1
            for _ in range(3):  # to the byte that begins a character
                begin = begin - ((w.data[begin] & 0xC0) == 0x80)
            raw = w.data.tobytes()
            cut = pa.array([raw[i:j].decode(errors="replace") for i, j in zip(begin.tolist(), end.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(docs[of]), batch.column(1).take(pa.array(w.first + text[starts])), cut], ["sentence", "doc", "toxic", "text"])


def _document_units(batches):
    """Distinct units of each document, with its label; run: 1 if a unit is nowhere a piece of its document."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for w in slices(batch.column(0), max_bytes=1 << 18):
            letters, first, last, text, run, _ = unit_ranges(w)
            raw, seen = letters.tobytes(), {}
            for t, a, b, r in zip(text.tolist(), first.tolist(), last.tolist(), run.tolist()):
                seen[t, raw[a:b]] = r and seen.get((t, raw[a:b]), True)
            rows = w.first + np.array([t for t, _ in seen], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([marked(u) for _, u in seen], pa.binary()), pa.array(toxic[rows], pa.int32()), pa.array([int(r) for r in seen.values()], pa.int32())], ["unit", "toxic", "run"])


def _best_sentences(batches, shared):
    """The best unit of the best sentence of each document, its score, that sentence's hash, and the document's label."""
    for batch in batches:
        toxic = batch.column(1)
        for w in slices(batch.column(0)):
            letters, text, score, first, last = shared.value.sentences(w)
            if not len(text):
                continue
            _, a, b, _, _, sentence = unit_ranges(w)
            _, hashes = sentence_hashes(letters, a, b, sentence)
            raw = letters.tobytes()
            order = np.lexsort((first, -score, text))
            order = order[np.r_[True, text[order][1:] != text[order][:-1]]]
            units = pa.array([marked(raw[first[i] : last[i]]) for i in order], pa.binary())
            yield pa.RecordBatch.from_arrays([units, pa.array(score[order]), pa.array(hashes[order]), toxic.take(pa.array(w.first + text[order]))], ["unit", "score", "sentence", "toxic"])


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton iterations for ridge/2 |w|^2 + sum weight * max(0, 1 - y x.w)^2 / 2."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge * np.eye(x.shape[1]), xa.T @ (wa * y[active]))
        if np.abs(new - w).max() < 1e-8:
            return new
        w = new if _ < 10 else (w + new) / 2
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def chance_of(t: int, n: int, p: float) -> float:
    """Probability that t or more of n documents are toxic if each is with probability p."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(t, n + 1))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of which all but the first two are 0 at least: a feature that came out negative is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        out = np.zeros(x.shape[1])
        out[use] = logistic(x[:, use], y, weight)
        bad = use & (out < 0)
        bad[:2] = False
        if not bad.any():
            return out
        use[np.flatnonzero(bad)[out[bad].argmin()]] = False


def within(counts: dict, most: int) -> tuple[float, float | None, float]:
    """(least, tie, share): all rows with keys from ``least`` on are at most ``most``; of the ``tie`` just below, a share still has room.

    Rows of the tied key are chosen by hash, so that a bound never drops a group whole.
    """
    total, least = 0, math.inf
    for value in sorted(counts, reverse=True):
        if total + counts[value] > most:
            return least, value, (most - total) / counts[value]
        total += counts[value]
        least = value
    return least, None, 0.0


def _in_share(share: float) -> Column:
    return F.pmod(F.xxhash64("unit", F.lit("tie")), F.lit(1 << 40)) < int((1 << 40) * share)


def _landmark_units(units: DataFrame, n_tox: int, n_clean: int, negatives: int) -> tuple[list, list, list]:
    """(enriched, common, others): rows (unit, t, c) that were chosen by thresholds on their counts, so that few are collected."""
    shapes = [(r["run"], r["t"], r["c"], r["n"]) for r in units.groupBy("run", "t", "c").agg(F.count("*").alias("n")).collect()]
    share, part = n_tox / (n_tox + n_clean), negatives // 4
    enriched, common, others = [], [], []
    for run in (0, 1):
        with_df, by_c, lifts, total = {}, {}, {}, 0
        for r, t, c, n in shapes:
            if r == run:
                with_df[t + c] = with_df.get(t + c, 0) + n
                if c:
                    by_c[c] = by_c.get(c, 0) + n
                    total += n
        for r, t, c, n in shapes:
            expected = c * n_tox / n_clean
            if r == run and t >= 2 and t > 8 * expected and with_df[t + c] * chance_of(t, t + c, share) < 0.1:
                lifts[t, c] = (t - expected) / math.sqrt(expected + 1), n
        per_lift: dict[float, int] = {}
        for value, n in lifts.values():
            per_lift[value] = per_lift.get(value, 0) + n
        least, tie, room = within(per_lift, 1500)
        own = units.where(F.col("run") == run)

        def counted(wanted: list[tuple[int, int]]) -> Column:
            return F.struct("t", "c").isin([F.struct(F.lit(t).cast("long"), F.lit(c).cast("long")) for t, c in wanted]) if wanted else F.lit(False)

        pairs, tied = [x for x, (value, _) in lifts.items() if value >= least], [x for x, (value, _) in lifts.items() if value == tie]
        top = own.where(counted(pairs) | (counted(tied) & _in_share(room))).collect() if pairs or tied else []
        top.sort(key=lambda r: (-lifts[r["t"], r["c"]][0], bytes(r["unit"])))
        pieces = [bytes(r["unit"]) for r in enriched]
        enriched += [r for r in top if not any(u in bytes(r["unit"]) for u in pieces)]
        if total:
            least, tie, room = within(by_c, part)
            common += own.where((F.col("c") >= min(least, max(by_c) + 1)) | ((F.col("c") == F.lit(tie)) & _in_share(room))).collect()
            spread = F.pmod(F.xxhash64("unit"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, part / total))
            others += own.where(F.col("c") > 0).where(spread).collect()
    lift = lambda r: (r["t"] - r["c"] * n_tox / n_clean) / math.sqrt(r["c"] * n_tox / n_clean + 1)
    enriched.sort(key=lambda r: (-lift(r), bytes(r["unit"])))
    common.sort(key=lambda r: (-r["c"], bytes(r["unit"])))
    return enriched, common, others


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_clean: int = 10_000, landmarks: int = 192, background: int = 64, negatives: int = 8000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel | None:
    """Fit on at most max_toxic + max_clean labelled documents; None without both classes."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    sample, counts = labelled_texts(docs, labels, label_col, {0: max_clean, 1: max_toxic}, "toxicity", id_col, text_col)
    sample = scratch.table(sample.select("text", F.col("y").alias("toxic"), "fold"), "sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_tox, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_tox or not n_clean:
        scratch.drop(sample)
        return None
    seen = sample.where("fold <> 0")
    # a sentence speaks for one of the documents that hold it, and a document once for a unit
    told = seen.select("text", "toxic").mapInArrow(_sentences, "sentence long, doc long, toxic int, text string").groupBy("sentence", "toxic").agg(F.min(F.struct("doc", "text")).alias("s"))
    told = told.groupBy("toxic", F.col("s.doc").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list("s.text")), "\n").alias("text")).select("text", "toxic")
    units = told.mapInArrow(_document_units, "unit binary, toxic int, run int").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.min("run").alias("run"))
    units = scratch.table(units, "units")
    enriched, common, others = _landmark_units(units, n_tox, n_clean, negatives)
    if not enriched or not common:
        scratch.drop(units, sample)
        return ToxicModel(np.zeros(1 << 20, np.float32), -1.0, np.array([np.log(counts[1] / counts[0]), 0, 0, 0, 0]))
    positive = [bytes(r["unit"]) for r in enriched]
    marks = positive[:landmarks] + [bytes(r["unit"]) for r in common if bytes(r["unit"]) not in set(positive)][:background]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])
    letters, first, last = _packed(marks)

    def fitted(rows: dict[bytes, tuple[float, float]]) -> ToxicModel:
        """The SVM on rows that stand for so many toxic and clean ones, as one weight for each quadruple."""
        names = sorted(rows)
        x = np.hstack([kernel(names, marks) @ root, np.ones((len(names), 1))])
        t, c = np.array([rows[u] for u in names], float).T
        size = np.sqrt(t + c)
        x, y, weight = np.vstack([x, x]), np.r_[np.ones(len(t)), -np.ones(len(c))], np.r_[t / size, c / size]
        x, y, weight = x[weight > 0], y[weight > 0], weight[weight > 0]
        for side in (y > 0, y < 0):  # both classes weigh the same
            weight[side] *= len(y) / 2 / max(weight[side].sum(), 1e-12)
        w = squared_hinge(x, y, weight, 0.3)
        beta, table = root @ w[:-1], np.zeros(1 << 20)
        for unit, quad, part in quadruples(letters, first, last):
            np.add.at(table, quad, beta[unit] * part / _NORMS[last - first][unit])
        return ToxicModel(table.astype(np.float32), float(w[-1]), np.zeros(5))

    base = {bytes(r["unit"]): (0.0, float(r["c"])) for r in common + others if r["c"]}
    base |= {bytes(r["unit"]): (float(r["t"]), float(r["c"])) for r in enriched}
    model = fitted(base)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        best = seen.mapInArrow(lambda b, s=shared: _best_sentences(b, s), "unit binary, score double, sentence long, toxic int").collect()  # one row a sampled document
        rows = dict(base)
        for unit, _, label in sorted({(bytes(r["unit"]), r["sentence"], r["toxic"]) for r in best if r["score"] > 0 or not r["toxic"]}):
            t, c = rows.get(unit, (0.0, 0.0))
            rows[unit] = (t + label, c + 1 - label)
        model = fitted(rows)
    shared = spark.sparkContext.broadcast(model)

    def featured(batches):
        for b in batches:
            f = shared.value.features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), b.column(1)], ["f", "toxic"])

    rows = sample.where("fold = 0").select("text", "toxic").mapInArrow(featured, "f array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
        model.calibration = monotone(np.array([r["f"] for r in rows]), y, weight * len(y) / weight.sum())
    else:
        model.calibration = np.array([-1.0, 0, 4.0, 0, 0])
    scratch.drop(units, sample)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel | None, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """The documents with a column of probabilities; batches are scored whole, without a shuffle."""
    if model is None:
        return docs.withColumn(as_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.probability(b.column(at)))], [*b.schema.names, as_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(as_col, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of held-out documents are not used."""
    model = train(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    scored = score_toxicity(rows, model, "_text", "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
