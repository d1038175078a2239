"""Best-fit packing of tokenised documents by bin completion.

A document is its token ids and an end mark. One longer than a sequence is cut into
full pieces, and its first piece takes the rest. Pieces are integers up to the
sequence length, so the packing problem of any corpus is a histogram with at most
``max_tokens`` rows; that histogram (and never a piece) is what meets in one place.

Solving (``complete``). The incumbent is best-fit decreasing, worked out for whole
groups of like bins at a time. Branch and bound then completes bins: it takes the
largest piece left, enumerates fillings of the room beside it, least waste first,
and skips the dominated ones (some included pieces could give way to one larger
piece that is left over). A filling is applied to as many bins as it fits, so the
depth does not grow with the corpus. A node is cut off when the waste so far exceeds
what a better solution than the incumbent may waste; from time to time what is left
is completed by best fit, which may become the incumbent. Half of ``max_nodes`` nodes
go to a search in depth, the rest to branches by how often they depart from a node's
first choice, fewest first. The search ends at the Martello-Toth lower bound, when
the tree is searched through, or after ``max_nodes`` nodes.

Placing. Pieces get a rank among those of equal length (their number in the writing
task plus what earlier tasks wrote), and a filling owns a range of ranks of each of
its lengths; this table has at most a few thousand rows and is broadcast. Documents
are tokenised once and never shuffled: only ids, lengths and checksums are.

Tokenising. ``tokenizers`` encodes words, each once while a bounded memo holds it; the
text is cut where the vocabulary's own pattern surely cuts it, and runs with characters
outside Latin letters go to ``tokenizers`` whole. Long texts are taken in chunks. A
tokenizer of another kind than byte-level BPE gets every text whole.

Null and empty texts are one end mark, a piece of length 1. Rows are packed each by
itself, whatever their ids: null or repeated ids give as many pieces as rows. Other
columns are ignored, whatever their names. No rows give no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.scratch import Scratch

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
BLANK = r"\t-\r \xa0"
#: Characters that all regular-expression engines class alike.
PLAIN = re.compile("[\x00-\x1b -~\xa0-ɏ]*")
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Between two words of plain letters the vocabulary's pattern always cuts.
CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
CHUNK, MEMO, MEMO_WORD = 1 << 20, 300_000, 64

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write each byte as a visible character: printable ones as themselves, the others from 256 on.
UNITS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


class Memo(dict):
    """Ids of words in two generations: the older one goes when the newer is full, so the memory is bounded."""

    def __init__(self, model):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            units = word.encode().decode("latin1").translate(UNITS)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(units)])
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TokenIds:
    """Token ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in file:
            import public_tokenizers

            file = public_tokenizers.path(file)
        tokenizer = Tokenizer.from_file(file)
        self.marks = {t.content: int(i).to_bytes(4, "little") for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None
        form = json.loads(tokenizer.to_str())
        cut = form["pre_tokenizer"] or {}
        #: Cut by words: byte-level pieces, no other step before or after.
        self.by_words = form["normalizer"] is None and form["post_processor"] is None and form["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        self.tokenizer, self.memo = tokenizer, Memo(tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK:
            cut = CUT.search(text, at + CHUNK)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        parts = [text] if self.mark is None or not any(m in text for m in self.marks) else self.mark.split(text)
        out = []
        for part in parts:
            if part in self.marks:
                out.append(self.marks[part])
                continue
            for chunk in self._chunks(part):
                if PLAIN.fullmatch(chunk):
                    out.append(b"".join(map(self.memo.__getitem__, WORDS.findall(chunk))))
                else:
                    out += [b"".join(map(self.memo.__getitem__, WORDS.findall(run))) if PLAIN.fullmatch(run) else self._whole(run) for run in CUT.split(chunk)]
        return b"".join(out)


@cache
def token_ids(file: str) -> TokenIds:
    """One a Python worker: later tasks find the words of earlier ones."""
    return TokenIds(file)


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full pieces, the first one takes the rest."""
    first = (n - 1) % most + 1
    return [(0, first), *((s, most) for s in range(first, n, most))]


_FIELDS = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int32()), ("_nth", pa.int64())]
_DDL = "piece int, start long, length long, ids_crc32 long, _part int, _nth long"
FLUSH_BYTES = 8 << 20


def _pieces(batches, file: str, end: int, most: int, with_ids: bool):
    encode, mark = token_ids(file), int(end).to_bytes(4, "little")
    part, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
    for batch in batches:
        texts, ids = batch.column("_text"), batch.column("doc_id")
        take, rows, bodies, held = [], [], [], 0

        def flushed():
            out = [ids.take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS))]
            names = ["doc_id", *(n for n, _ in _FIELDS)]
            if with_ids:
                whole = np.frombuffer(b"".join(bodies), "<u4").astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r[2] for r in rows)]), pa.int32()), pa.array(whole)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names)

        for i in range(batch.num_rows):
            data = encode(texts[i].as_py() or "") + mark
            for k, (start, length) in enumerate(pieces_of(len(data) // 4, most)):
                body = data[4 * start : 4 * (start + length)]
                take.append(i)
                rows.append((k, start, length, zlib.crc32(body), part, int(seen[length])))
                seen[length] += 1
                if with_ids:
                    bodies.append(body)
                held += 64 + (len(body) if with_ids else 0)
                if held > FLUSH_BYTES:
                    yield flushed()
                    take, rows, bodies, held = [], [], [], 0
        if rows:
            yield flushed()


def token_pieces(docs: DataFrame, max_tokens: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with their number among those of equal length in the task that made them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, max_tokens, with_ids), f"doc_id {kind}, {_DDL}" + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    room = len(counts) - 1
    size = np.arange(room + 1)
    total, best = [int(x) for x in counts], 0
    n = np.concatenate([[0], np.cumsum(counts)]).astype(object)
    s = np.concatenate([[0], np.cumsum(counts.astype(object) * size)])
    half = room // 2
    for k in range(half + 1):
        alone, large = n[room + 1] - n[room - k + 1], n[room - k + 1] - n[half + 1]
        free = large * room - (s[room - k + 1] - s[half + 1])
        best = max(best, alone + large + max(0, -(-(s[half + 1] - s[k] - free) // room)))
    return int(max(best, total[room]))


def best_fit(counts: list[int], room: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing, for groups of like bins: (how many bins, their filling)."""
    open_bins: dict[int, list[list]] = {}  # by room left: [bins, filling]
    done: list[tuple[int, Filling]] = []
    rooms: list[int] = []

    def put(n: int, left: int, filling: Filling) -> None:
        if not left:
            done.append((n, filling))
        elif left in open_bins:
            open_bins[left].append([n, filling])
        else:
            open_bins[left] = [[n, filling]]
            rooms.insert(bisect_right(rooms, left), left)

    for size in range(room, 0, -1):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                per = room // size
                if left // per:
                    put(left // per, room - per * size, ((size, per),))
                if left % per:
                    put(1, room - left % per * size, ((size, left % per),))
                break
            have = rooms[at]
            n, filling = open_bins[have].pop()
            if not open_bins[have]:
                del open_bins[have], rooms[at]
            per = have // size
            full = min(n, left // per)
            if full:
                put(full, have - per * size, (*filling, (size, per)))
            left, rest = left - full * per, n - full
            if rest and left and left < per:
                put(1, have - left * size, (*filling, (size, left)))
                left, rest = 0, rest - 1
            if rest:
                put(rest, have, filling)
    return done + [(n, f) for groups in open_bins.values() for n, f in groups]


def _spread(bits: int, most: int) -> int:
    """Bits moved up by 0 to ``most`` places, together."""
    step, have = 1, 0
    while have < most:
        move = min(step, most - have)
        bits |= bits << move
        have += move
        step = have + 1
    return bits


def dominated(filling: Filling, waste: int, left: int) -> bool:
    """Could some pieces of the filling give way to one larger piece, or to one of equal length as a group? ``left``: bits of the lengths left over."""
    if left & ((2 << waste) - 1) & ~1:
        return True  # room for one more
    one, many = 0, 0
    for size, k in filling:
        for _ in range(k):
            many |= many << size | one << size
            one |= 1 << size
    return bool(left & _spread(many, waste) or waste and left & _spread(one << 1, waste - 1))


def fillings(counts: list[int], room: int, slack: int, width: int) -> Iterator[tuple[Filling, int]]:
    """At most ``width`` undominated fillings of ``room`` that waste at most ``slack``, least waste first, long pieces first."""
    sizes = [s for s in range(1, room + 1) if counts[s]]
    mask, reach = (2 << room) - 1, [1]
    for s in sizes:
        bits, k, step = reach[-1], min(counts[s], room // s), 1
        while k:  # up to k pieces of length s, by doubling
            step = min(step, k)
            bits |= bits << (step * s) & mask
            k -= step
            step *= 2
        reach.append(bits)
    available = sum(1 << s for s, c in enumerate(counts) if c)

    def sums(j: int, goal: int, tail: Filling) -> Iterator[Filling]:
        if not goal:
            yield tail
            return
        for i in range(min(j, bisect_right(sizes, goal)), 0, -1):
            if not reach[i] >> goal & 1:
                return
            s = sizes[i - 1]
            for k in range(min(counts[s], goal // s), 0, -1):
                if reach[i - 1] >> (goal - k * s) & 1:
                    yield from sums(i - 1, goal - k * s, (*tail, (s, k)))

    found = tried = 0
    for waste in range(min(slack, room) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for f in sums(len(sizes), room - waste, ()):
            tried += 1
            left = available
            for s, k in f:
                if counts[s] == k:
                    left &= ~(1 << s)
            if not dominated(f, waste, left):
                yield f, waste
                found += 1
            if found >= width or tried >= 16 * width:
                return


def complete(counts: list[int], max_nodes: int = 4000, width: int = 6) -> tuple[list[tuple[int, Filling]], int]:
    """(fillings with their number of bins, lower bound) for ``counts[length]`` pieces of each length up to ``len(counts) - 1``."""
    counts, room = list(counts), len(counts) - 1
    total, bound = sum(s * c for s, c in enumerate(counts)), lower_bound(np.array(counts, dtype=object))
    best = best_fit(counts, room)
    fewest = sum(n for n, _ in best)
    path: list[tuple[int, Filling]] = []
    used = wasted = nodes = 0

    def choices():
        """Of this node: the filling around the largest piece left and the waste that it brings."""
        largest = next((s for s in range(room, 0, -1) if counts[s]), 0)
        slack = (fewest - 1) * room - total - wasted
        if not largest or slack < 0:
            return
        counts[largest] -= 1
        options = list(fillings(counts, room - largest, slack, width))
        counts[largest] += 1
        for rank, (f, waste) in enumerate(options):
            f = ((largest, f[0][1] + 1), *f[1:]) if f and f[0][0] == largest else ((largest, 1), *f)
            yield rank, f, waste

    for allowed in (max_nodes, *range(max_nodes)):
        stack, cut_short, last = [(choices(), allowed)], False, max_nodes // 2 if allowed == max_nodes else max_nodes
        while stack and fewest > bound and nodes < last:
            options, others = stack[-1]
            rank, f, waste = next(options, (0, None, 0))
            if f is None:
                stack.pop()
                if path:
                    n, f = path.pop()
                    used, wasted = used - n, wasted - n * (room - sum(s * k for s, k in f))
                    for s, k in f:
                        counts[s] += n * k
                continue
            if rank > others:
                cut_short, stack[-1] = True, (iter(()), 0)
                continue
            slack = (fewest - 1) * room - total - wasted
            n = min(counts[s] // k for s, k in f)
            n = min(n, slack // waste) if waste else n
            if n <= 0:
                continue
            nodes += 1
            for s, k in f:
                counts[s] -= n * k
            path.append((n, f))
            used, wasted = used + n, wasted + n * waste
            done = not any(counts)
            if done or nodes % 64 == 0:
                rest = [] if done else best_fit(counts, room)
                if (bins := used + sum(n for n, _ in rest)) < fewest:
                    fewest, best = bins, [*path, *rest]
            stack.append((iter(()) if done else choices(), others - rank))
        if fewest == bound or nodes >= max_nodes or not (stack or cut_short):
            break
        for n, f in path:  # a search that ran out of nodes left these
            for s, k in f:
                counts[s] += n * k
        path, used, wasted = [], 0, 0
    return best, bound


def placements(packed: list[tuple[int, Filling]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset) for each filling and length."""
    base, ranks = 0, {}
    for n, filling in packed:
        at = 0
        for size, k in filling:
            first = ranks.get(size, 0)
            ranks[size] = first + n * k
            yield size, first, first + n * k, k, base, at
            at += k * size
        base += n


def _placement_table(spark: SparkSession, histogram: dict[int, int], max_tokens: int, max_nodes: int) -> DataFrame:
    packed, _ = complete([histogram.get(s, 0) for s in range(max_tokens + 1)], max_nodes)
    return spark.createDataFrame(list(placements(packed)), "length long, _from long, _to long, _per long, _base long, _at long")


def pack(docs: DataFrame, max_tokens: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, max_nodes: int = 4000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, max_tokens, tokenizer, end_id, with_ids, id_col, text_col), "pieces")
    shares = scratch.table(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")), "shares")
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # max_tokens rows at most
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    starts = shares.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = pieces.join(starts, ["_part", "length"]).withColumn("_rank", F.col("_start") + F.col("_nth"))
    placed = ranked.join(F.broadcast(_placement_table(spark, histogram, max_tokens, max_nodes)), "length").where("_rank >= _from AND _rank < _to")
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_base") + F.expr("(_rank - _from) div _per")).alias("sequence_id"),
        (F.col("_at") + nth % F.col("_per") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
