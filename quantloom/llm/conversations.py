"""Repair of damaged conversations: the cheapest edits that give legal turns.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``: perhaps a
system turn, then user and assistant in turn, ending with the assistant. Rows may be
kept (0), given the role user or assistant (2) or deleted (3), and empty turns may be
inserted anywhere (2). Blank and repeated rows must go; a row that ends without a
sentence mark and stays adds 1. Of equally cheap edits the one whose initials
(``D``, ``I``, ``K``, ``R``) come first in ASCII order is taken; as each role is fixed by
what stands before it, the initials determine the repaired turns.

Dynamic program. Four states (start, after s, u, a) and the rows give a shortest path.
A task takes many conversations, buckets them by length (powers of two) and works
through tensors with time as the first axis: costs to the end are updated backward,
one step for all conversations of the bucket, and stored; then all cursors move
forward together, each taking the first edit that keeps the stored cost (``costs``,
``traced``).

Long conversations are cut into segments of at most ``SEGMENT`` rows, dealt out like
conversations of their own: a first pass gives each segment's costs from each state to
each state, a scan from the last segment to the first turns these into the costs at each
segment's end, a second pass traces every segment from each state, and a scan forward
picks the traces that connect. Scans hold four numbers. Only the final digest of a
conversation, SHA-256 over all its text, is by definition one stream: rows pass sorted
through it, and none is held.

Order: by turn, nulls first; rows of one turn by role, then by the digest of their text,
copies next to each other. Null texts, roles, ids and turns count as one space where
text is wanted; a null conversation id is a conversation. Rows without a letter at the
start of the role (empty role) are never legal. Conversations whose rows are all lost
keep a row of zeros. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quantloom.operators.ordering import numbered
from quantloom.scratch import Scratch

SEGMENT, ROWS_AT_ONCE = 4096, 1 << 16
STATES, FAR = 4, 1 << 40
#: Role that each state takes next, as the index of the state reached: start -> u (or s, kept only), s -> u, u -> a, a -> u.
NEXT = np.array([2, 2, 3, 2])
KEEPS = np.array([[0, 1, 2, 0], [0, 0, 2, 0], [0, 0, 0, 3], [0, 0, 2, 0]])  # state x initial (other, s, u, a): state reached, 0 if not legal
END = np.array([0, FAR, FAR, 0])
REROLE, DELETE, INSERT = 2, 3, 2
NO_ROWS = sha256(b"").hexdigest()


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """conv, turn, role, text of the rows after damage; ``copies`` is 0 for a row that is dropped (its conversation stays known)."""
    space = F.lit(" ")
    at = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    kind = F.crc32(at.cast("binary")) % 20 if damage else F.lit(-1)
    text, role = F.coalesce(F.col(text_col), space), F.coalesce(F.col(role_col), space)
    hurt = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode(F.when(F.col("copies") < 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs with insertions before what follows; states are the second axis."""
    for _ in range(3):  # start or s, u, a, u
        cost = np.minimum(cost, INSERT + cost[:, NEXT])
    return cost


def costs(initial: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost to the end, [time + 1, conversation, state, ...], of rows [time, conversation]; ``end``: [conversation, state, ...]."""
    steps, n = initial.shape
    wide = (slice(None), *[None] * (end.ndim - 1))
    out = np.empty((steps + 1, *end.shape), np.int64)
    out[steps] = closed(end)
    for t in range(steps - 1, -1, -1):
        after = out[t + 1]
        extra = np.where(must[t], FAR, cut[t])[wide]
        kept = KEEPS[:, initial[t]].T  # conversation x state
        keep = np.where((kept > 0).reshape(n, STATES, *[1] * (end.ndim - 2)), np.take_along_axis(after, kept.reshape(n, STATES, *[1] * (end.ndim - 2)), 1), FAR)
        now = np.minimum(DELETE + after, np.minimum(keep, REROLE + after[:, NEXT]) + extra)
        out[t] = np.where((t < length)[wide], np.minimum(closed(now), FAR), out[steps])
    return out


def traced(cost: np.ndarray, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray, end: np.ndarray, start: int) -> tuple[list[bytes], np.ndarray]:
    """Initials of the edits of each conversation from ``start``, first in ASCII order of the cheapest, and the states reached.

    ``end``: cost of stopping in each state. All cursors move together; a step writes
    one letter of each conversation that is not done. An insertion at a segment's end
    belongs to it only if no row follows (``end`` without insertions is that of a last
    segment; others begin their successor's way with it).
    """
    steps, n = initial.shape
    conv, at, state = np.arange(n), np.zeros(n, np.int64), np.full(n, start)
    letters = []
    live = cost[0, :, start] < FAR
    while live.any():
        row = np.minimum(at, steps - 1)
        here, more = cost[at, conv, state], live & (at < length)
        after = np.minimum(at + 1, steps)
        extra = np.where(must[row, conv], FAR, cut[row, conv])
        kept = KEEPS[state, initial[row, conv]]
        delete = more & (DELETE + cost[after, conv, state] == here)
        insert = live & ~delete & (INSERT + cost[at, conv, NEXT[state]] == here) & ~((at == length) & (end[conv, state] == here))
        keep = more & ~delete & ~insert & (kept > 0) & (cost[after, conv, kept] + extra == here)
        rerole = more & ~delete & ~insert & ~keep
        letters.append(np.select([delete, insert, keep, rerole], [68, 73, 75, 82], 0).astype(np.uint8))
        state = np.where(keep, kept, np.where(insert | rerole, NEXT[state], state))
        at = at + (delete | keep | rerole)
        live = delete | insert | keep | rerole
    if not letters:
        return [b""] * n, state
    text = np.stack(letters, 1)
    lengths = (text > 0).sum(1)
    return [text[i, : lengths[i]].tobytes() for i in range(n)], state


class Segments:
    """Flags of many segments, row by row, and their tensors by length class."""

    def __init__(self, t: pa.Table):
        initial, fault = (t[c].to_numpy() for c in ("initial", "fault"))
        first = np.flatnonzero(t["first"].to_numpy())
        self.first, self.length = first, np.diff(np.append(first, t.num_rows))
        self.initial, self.must, self.cut = initial.astype(np.int64), np.isin(fault, (1, 2)), (fault == 3).astype(np.int64)
        self.fault = fault

    def buckets(self) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """(segments, (initial, must, cut as [time, segment]; length))."""
        size = np.ceil(np.log2(self.length)).astype(int)
        for c in np.unique(size):
            of = np.flatnonzero(size == c)
            steps = np.arange(self.length[of].max())[:, None]
            row = self.first[of] + np.minimum(steps, self.length[of] - 1)
            yield of, (self.initial[row], self.must[row], self.cut[row], self.length[of])

    def counts(self) -> list[pa.Array]:
        """Blank, duplicate and truncated rows of each segment."""
        return [pa.array(np.add.reduceat((self.fault == k).astype(np.int64), self.first)) for k in (1, 2, 3)]


def _whole_segments(batches, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a segment ends (``first`` marks the beginnings)."""
    held = []
    rows = 0
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(list(names))
        first = np.flatnonzero(t["first"].to_numpy())
        if rows >= ROWS_AT_ONCE and len(first):
            yield pa.concat_tables([*held, t[: first[0]]]).combine_chunks()
            held, rows, t = [], 0, t[first[0] :]
        held.append(t)
        rows += t.num_rows
    if rows:
        yield pa.concat_tables(held).combine_chunks()


_KEYS = ("conv", "seg")
_FLAGS = (*_KEYS, "first", "initial", "fault")


def _matrices(batches):
    """The cost of each segment from each state to each state, 16 numbers."""
    for t in _whole_segments(batches, _FLAGS):
        s = Segments(t)
        out = np.empty((len(s.first), STATES * STATES), np.int64)
        for of, (initial, must, cut, length) in s.buckets():
            end = np.broadcast_to(np.where(np.eye(STATES, dtype=bool), 0, FAR), (len(of), STATES, STATES))
            out[of] = costs(initial, must, cut, length, end)[0].reshape(len(of), -1)
        yield from _with_keys(t, s.first, [pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), STATES * STATES).cast(pa.list_(pa.int64()))], ["matrix"])


def _with_keys(t: pa.Table, first: np.ndarray, columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    keys = t.select(list(_KEYS)).take(pa.array(first)).combine_chunks()
    yield from pa.Table.from_arrays([*keys.columns, *columns], [*_KEYS, *names]).to_batches()


def _ends(batches):
    """Sorted by conversation, last segment first: what each segment's end costs from there on."""
    conv, end = object(), None
    for batch in batches:
        out = []
        for c, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist()):
            if c != conv:
                conv, end = c, END
            out.append(end.tolist())
            end = np.minimum((np.array(matrix).reshape(STATES, STATES) + end[None]).min(1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), pa.array(out, pa.list_(pa.int64()))], [*_KEYS, "ends"])


def _traces(batches):
    """Of each segment and start state: edits, their last state; and the segment's faults."""
    for t in _whole_segments(batches, (*_FLAGS, "ends")):
        s = Segments(t)
        n = len(s.first)
        given = t["ends"].combine_chunks().take(pa.array(s.first)).to_pylist()
        end = np.array([END if e is None else e for e in given], np.int64).reshape(n, STATES)
        audits, reached = [[""] * STATES for _ in range(n)], np.zeros((n, STATES), np.int64)
        seg = t["seg"].to_numpy()[s.first]
        for of, (initial, must, cut, length) in s.buckets():
            cost = costs(initial, must, cut, length, end[of])
            for start in range(STATES):
                if start and not (seg[of] > 0).any():
                    break
                made, state = traced(cost, initial, must, cut, length, end[of], start)
                reached[of, start] = state
                for i, edits in zip(of, made):
                    audits[i][start] = edits.decode()
        yield from _with_keys(t, s.first, [pa.array(audits, pa.list_(pa.string())), pa.array(reached.tolist(), pa.list_(pa.int64())), *s.counts()], ["audits", "reached", "blank", "duplicate", "truncated"])


def _conversations(batches, conv_type: pa.DataType, turns: bool):
    """Sorted rows of each conversation, each segment led by its traces: its summary, or its repaired turns."""
    names = TURNS if turns else SUMMARY
    done: list[list] = []
    now: Conversation | None = None
    key, held = object(), 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "audits", "reached", "blank", "duplicate", "truncated")]
        for conv, kind, turn, role, text, audits, reached, *faults in zip(*columns):
            if now is None or conv != key:
                if now is not None:
                    done += now.finished(key, turns)
                key, now = conv, Conversation()
            if kind == 0:
                now.segment(audits, reached, faults)
            elif kind == 1:
                now.row(turn, role, text)
            made = now.taken(key)
            if turns:
                done += made
                held += len(text or "")
            if len(done) >= 4096 or held > 8 << 20:
                yield _rows(done, names, conv_type)
                done, held = [], 0
    if now is not None:
        done += now.finished(key, turns)
    if done:
        yield _rows(done, names, conv_type)


SUMMARY = {"conv_id": None, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
TURNS = {"conv_id": None, "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}


def _rows(done: list, names: dict, conv_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k or conv_type) for c, k in zip(zip(*done), names.values())], list(names))


class Conversation:
    """What one conversation's digest columns need, row by row."""

    def __init__(self):
        self.state, self.walk, self.edits, self.at = 0, 0, "", 0
        self.audit: list[str] = []
        self.faults, self.illegal, self.cost, self.before = [0, 0, 0], 0, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.hash, self.lines, self.n_lines = sha256(), [], 0

    def segment(self, audits: list[str], reached: list[int], faults: tuple[int, int, int]) -> None:
        self._rest()
        self.edits, self.at = audits[self.state], 0
        self.state = reached[self.state]
        self.audit.append(self.edits)
        self.faults = [a + b for a, b in zip(self.faults, faults)]

    def _line(self, role: str, text: str, edit: str) -> None:
        self.hash.update((("\n" if self.n_lines else "") + role + ":" + text).encode())
        self.lines.append((self.n_lines, role, text, edit))
        self.n_lines += 1

    def taken(self, key) -> list[tuple]:
        out, self.lines = [(key, *line) for line in self.lines], []
        return out

    def _inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.walk, self.at = int(NEXT[self.walk]), self.at + 1
            self._line("user" if self.walk == 2 else "assistant", "", "I")
            self.cost += INSERT

    def _rest(self) -> None:
        self._inserted()
        if self.at != len(self.edits):
            raise ValueError("edits and rows of a conversation do not agree")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.least, self.most = turn if self.least is None else self.least, turn
            self.turns += turn != self.turn
            self.turn = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.cost += DELETE
            return
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        self.cost += stripped[-1:] not in (".", "!", "?")
        if edit == "K":
            self.walk = int(KEEPS[self.walk, _CODE.get(role[:1], 0)])
            self._line(role, text, "K")
        else:
            self.walk = int(NEXT[self.walk])
            self._line("user" if self.walk == 2 else "assistant", text, "R")
            self.cost += REROLE

    def finished(self, key, turns: bool) -> list[tuple]:
        self._rest()
        if turns:
            return self.taken(key)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [(key, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())]


_CODE = {"s": 1, "u": 2, "a": 3}


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, damage: bool = False, turns: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    With ``turns`` the repaired conversations themselves: conv_id, place, role, text
    and edit of each turn. With ``damage`` the rows are first damaged, for trials.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "conversations")
    hurt = damaged(rows, conv_col, turn_col, role_col, text_col, damage)
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    initial = F.substring("role", 1, 1)
    hurt = hurt.withColumns({
        "digest": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256),
        "initial": F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0),
        "fault": F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3),
    })
    ordered = numbered(hurt, "conv", F.col("copies") == 0, "turn", "role", "digest", "copy", within=("conv",), name="pos", scratch=scratch)
    ordered = scratch.table(ordered.withColumns({"pos": F.col("pos") - 1, "lost": F.col("copies") == 0}).withColumn("seg", F.expr(f"pos div {segment}")), "ordered")
    kept = ordered.where("NOT lost").select("conv", "seg", "pos", "initial", "fault", "digest")
    origin = kept.where("fault <> 1").groupBy("conv", "digest").agg(F.min("pos").alias("_pos")).select(F.col("conv").alias("_conv"), "_pos")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))
    fault = F.when((F.col("fault") != 1) & F.col("_pos").isNull(), 2).otherwise(F.col("fault"))
    flags = kept.join(origin, same, "left").select("conv", "seg", "pos", "initial", fault.alias("fault"))
    flags = scratch.table(flags.withColumn("first", F.col("pos") % segment == 0), "flags")

    long = flags.where("first AND seg > 0").select("conv").distinct().withColumnRenamed("conv", "_conv")
    kind = ordered.schema["conv"].dataType.simpleString()
    parts = flags.join(long, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
    matrices = _sorted(parts, ["conv", "seg"], ["conv", "seg", "pos"]).mapInArrow(_matrices, f"conv {kind}, seg long, matrix array<long>")
    ends = _sorted(matrices, ["conv"], ["conv", F.desc("seg")]).mapInArrow(_ends, f"conv {kind}, seg long, ends array<long>")
    ends = scratch.table(ends, "ends").select(F.col("conv").alias("_conv"), F.col("seg").alias("_seg"), "ends")
    met = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg")) & F.col("first")
    known = flags.join(ends, met, "left").drop("_conv", "_seg")
    traces = _sorted(known, ["conv", "seg"], ["conv", "seg", "pos"]).mapInArrow(_traces, f"conv {kind}, seg long, audits array<string>, reached array<long>, blank long, duplicate long, truncated long")
    leads = scratch.table(traces, "traces").withColumns({"kind": F.lit(0), "pos": F.lit(-1).cast("long")})
    body = ordered.select("conv", "seg", F.when(F.col("lost"), 2).otherwise(1).alias("kind"), "pos", "turn", "role", F.when(~F.col("lost"), F.col("text")).alias("text"))
    stream = leads.unionByName(body, allowMissingColumns=True)
    order = ["conv", F.col("kind") == 2, "seg", "kind", "pos"]
    conv_type = to_arrow_type(ordered.schema["conv"].dataType)
    ddl = "place long, role string, text string, edit string" if turns else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    sorted_rows = _sorted(stream.select("conv", "seg", "kind", "pos", "turn", "role", "text", "audits", "reached", "blank", "duplicate", "truncated"), ["conv"], order)
    return sorted_rows.mapInArrow(lambda b: _conversations(b, conv_type, turns), f"conv_id {kind}, {ddl}").withColumnRenamed("conv_id", conv_col)


def _sorted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order)
