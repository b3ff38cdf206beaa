"""Repair of conversations by an error-correcting Earley parser over a grammar of roles.

A conversation is empty, or turns of user and assistant in pairs, with one of the system before them or none. Error productions let a row be
deleted or take another role and let a turn be inserted, each at a price. All productions begin with what was read so far, so
every item of the chart begins at the first row; predicting and completing between two rows is then the same for every chart and is done once, for the
grammar (``Chart``). What is left for a row is to move the minimum (cost, audit) from the items before it to those after it.

Audits aren't copied: of each item the chart holds the rank of its audit among those of its column and where it came from. That is enough, as no two
audits of a column that end in an edit of its row are each other's beginning.

The chart of a run of rows can be made from any item it may begin with. So a conversation of any length is cut into runs, whose charts are made apart and joined
by their ends: what one task holds is bounded, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices

GRAMMAR = (("Before", ()), ("Before", ("s",)), ("Before", ("Told",)), ("Asked", ("Before", "u")), ("Told", ("Asked", "a")), ("Talk", ()), ("Talk", ("Told",)))
GOAL = "Talk"
#: Terminals that may be inserted or given to a row of another role, and the role they stand for.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation in a run.
RUN = 4096
SPACE = " \t\n\x0b\x0c\r"
INITIALS = ("s", "u", "a")
LEGAL = ("su", "ua", "au")
#: First faults of a row.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Classes of rows: initial (s, u, a, another) times two, one more if truncated; rows that must go.
GOES = 8
NEVER = 1 << 40


class Chart:
    """The grammar's items and, for each class of rows, the cheapest edits that lead from one item to another.

    Items are what a row may have just been read into: ``start``, or a production with its dot after a terminal.
    """

    def __init__(self) -> None:
        self.items: list[tuple[int, int] | None] = [None]
        moves: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        at = 0
        while at < len(self.items):
            closed = self.completed(self.items[at])
            found = {}
            for production, dot in sorted(closed):
                right = GRAMMAR[production][1]
                if dot < len(right) and right[dot] in INITIALS:
                    item = (production, dot + 1)
                    if item not in self.items:
                        self.items.append(item)
                    found[right[dot]] = self.items.index(item)
            moves.append(found)
            self.accepts.append(any(GRAMMAR[p][0] == GOAL and d == len(GRAMMAR[p][1]) for p, d in closed))
            at += 1
        n = self.n = len(self.items)
        inserted = [self.inserts(moves, p) for p in range(n)]
        options: dict[tuple[int, int, int], tuple[int, str, tuple, str | None]] = {}
        for row in range(GOES + 1):
            initial, truncated = row // 2, row % 2
            for p in range(n):
                for mid, (cost, roles) in inserted[p].items():
                    letters = "I" * len(roles)
                    made = [(mid, cost + DELETE, letters + "D", roles, None)]
                    if row != GOES:
                        more = cost + TRUNCATED * truncated
                        if initial < len(INITIALS) and INITIALS[initial] in moves[mid]:
                            made.append((moves[mid][INITIALS[initial]], more, letters + "K", roles, None))
                        made += [(q, more + REROLE, letters + "R", roles, ROLES[x]) for x, q in moves[mid].items() if x in ROLES]
                    for q, cost_, edits, roles_, new in made:
                        if (row, p, q) not in options or (cost_, edits) < options[row, p, q][:2]:
                            options[row, p, q] = (cost_, edits, roles_, new)
        self.edits = sorted({o[1] for o in options.values()})
        self.options = options
        self.cost = np.full((GOES + 1, n, n), NEVER, np.int64)
        self.letters = np.zeros((GOES + 1, n, n), np.int64)
        for (row, p, q), o in options.items():
            self.cost[row, p, q], self.letters[row, p, q] = o[0], self.edits.index(o[1])
        # how each item ends: the cheapest inserts that complete the goal
        self.ends: list[tuple[int, tuple]] = []
        for p in range(n):
            self.ends.append(min((cost, roles) for q, (cost, roles) in inserted[p].items() if self.accepts[q]))

    def completed(self, item: tuple[int, int] | None) -> set[tuple[int, int]]:
        """The items of a column that follow from one without reading: predictions where nothing is read yet, then completions."""
        closed = {(p, 0) for p in range(len(GRAMMAR))} if item is None else {item}
        todo = list(closed)
        while todo:
            production, dot = todo.pop()
            left, right = GRAMMAR[production]
            if dot == len(right):
                for p, (_, r) in enumerate(GRAMMAR):
                    if r and r[0] == left and (p, 1) not in closed:
                        closed.add((p, 1))
                        todo.append((p, 1))
        return closed

    def inserts(self, moves: list[dict[str, int]], start: int) -> dict[int, tuple[int, tuple]]:
        """Items that inserted turns lead to, with the least cost and the roles."""
        found, todo = {start: (0, ())}, [start]
        while todo:
            p = todo.pop(0)
            cost, roles = found[p]
            for x, q in moves[p].items():
                if x in ROLES and (q not in found or found[q][0] > cost + INSERT):
                    found[q] = (cost + INSERT, (*roles, ROLES[x]))
                    todo.append(q)
        return found


CHART = Chart()
N = CHART.n


def charts(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Charts of runs of rows, from each item that a run may begin with: costs and ranks of the last column by first and last item, and for each row
    from which item before it each item came. All runs are read together, a row of each at a time."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    cost = np.full((n, N, N), NEVER, np.int64)
    cost[:, np.arange(N), np.arange(N)] = 0
    rank = np.zeros((n, N, N), np.int64)
    back = np.zeros((len(classes), N, N), np.uint8)
    many = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    for t, k in enumerate(many.tolist()):
        runs = order[:k]
        rows = at[runs] + t
        row = classes[rows]
        step, edit = CHART.cost[row][:, None], CHART.letters[row][:, None]
        # [run, first item, item before, item after]
        total = cost[runs][:, :, :, None] + step
        audit = rank[runs][:, :, :, None] * len(CHART.edits) + edit
        came = np.argmin(total * (N * len(CHART.edits)) + audit, axis=2)
        pick = came[:, :, None, :]
        back[rows] = came
        cost[runs] = np.minimum(np.take_along_axis(total, pick, 2)[:, :, 0], NEVER)
        rank[runs] = np.argsort(np.argsort(np.take_along_axis(audit, pick, 2)[:, :, 0], axis=2), axis=2)
    return cost, rank, back


def best_end(cost: np.ndarray, rank: np.ndarray) -> int:
    """The item that a chart ends with."""
    return min(range(N), key=lambda q: (int(cost[q]) + CHART.ends[q][0], int(rank[q])))


def steps(classes: np.ndarray, back: np.ndarray, first: int, last: int) -> list[tuple[str, tuple, str | None]]:
    """For each row its edits: letters, roles of turns inserted before it, the row's new role."""
    out, q = [], last
    for row, came in zip(classes[::-1].tolist(), back[::-1, first].tolist(), strict=True):
        p = came[q]
        out.append(CHART.options[row, p, q][1:])
        q = p
    return out[::-1]


# --- rows ------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Damages rows by the checksum of conversation and turn, a twentieth each: dropped, emptied, without ends of sentences, repeated, said to be the user's. Nulls of text, role and in the checksum are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.expr("pmod(crc32(encode(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')), 'utf-8')), 20)").alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("one")).drop("one")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Repair:
    """The repair of ``rows`` (conv_id, turn, role, text).

    Rows of a conversation are read by turn (nulls first), then role, then text. The first fault of a row counts: ``blank`` (nothing but white space), ``duplicate``
    (the role and text of an earlier row), ``truncated`` (doesn't end in one of .!?). Keeping a row costs 0, another role 3, deleting it 4 (blank and duplicate rows must go),
    an inserted empty turn 3; a truncated row that stays costs 3 more. Of the cheapest repairs the one whose audit, the edits' initials in
    order, is least by ASCII is taken.

    A null conversation is one like any other; null roles and texts are a space (so a null text is blank); equal rows, also of one turn, are duplicates; no rows give no
    conversations; other columns are ignored. Conversations and texts may be of any length: rows that are equal in all columns are counted first, conversations are cut into
    runs of at most 4096 rows, and only a run's ends go to the task that joins them.
    """

    PACKED = "conv_id long, at long, turn array<long>, copies array<long>, fault array<int>, role array<string>, text array<string>"
    PARSED = "conv_id long, at long, cost array<long>, rank array<int>, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, audit string, repaired_sha256 string, total long"

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark, "conversations")
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
        rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
        solid = F.rtrim(F.col("text"), F.lit(SPACE))
        rows = rows.withColumn("fault", F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT))
        said = F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.concat("role", "text")), 256)
        rows = self.scratch.put(rows.withColumn("said", F.when(F.col("fault") != BLANK, said)).withColumn("order", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"))))
        # what was said for the first time, of what was said in more than one turn; the join's large side can be split
        first = rows.where("said is not null").groupBy("said").agg(F.min("order").alias("began"), F.max("order").alias("ended")).where("began < ended").select("said", "began")
        rows = rows.join(first.hint("merge"), "said", "left").withColumn("fault", F.when(F.col("began") < F.col("order"), DUPLICATE).otherwise(F.col("fault")))
        order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
        rows = self.scratch.put(rows.select("conv_id", "turn", "role", "text", "copies", "fault"))
        sorted_ = rows.repartitionByRange(partitions(self.spark), *order).sortWithinPartitions(*order)
        self.runs = self.scratch.put(sorted_.mapInArrow(_pack, self.PACKED))
        self.parsed = self.scratch.put(self.runs.mapInArrow(_parse, self.PARSED))
        cut = self.parsed.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("cut"))
        self.whole = self.parsed.join(cut, _same("conv_id", "cut"), "left_anti")
        ends = self.parsed.join(cut, _same("conv_id", "cut"), "left_semi").drop("audit", "repaired_sha256", "total")
        ends = ends.repartition(partitions(self.spark), "conv_id").sortWithinPartitions("conv_id", "at")
        self.joined = self.scratch.put(ends.mapInArrow(_join, f"{', '.join(x for x in self.PARSED.split(', ')[:13])}, begins int, ends int, closes boolean, total long"))

    def report(self) -> DataFrame:
        """For each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        final = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        one = self.whole.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"), "audit", "repaired_sha256")
        # the digest of a conversation is of one stream: its runs' repaired texts pass through one task, one after the other
        parts = self.runs.select("at", "turn", "copies", "fault", "role", "text").join(self.joined.drop("cost", "rank").hint("merge"), "at")
        written = parts.mapInArrow(_write, f"{_STATISTICS}, audit string, repaired binary")
        written = written.repartition(partitions(self.spark), "conv_id").sortWithinPartitions("conv_id", "at")
        return one.unionByName(written.mapInArrow(_fold, final))

    def turns(self) -> DataFrame:
        """The repaired conversations: conv_id, at and place (which give the order), turn (null where inserted), role, text, edit (K, R or I)."""
        choice = self.whole.select("at", F.lit(0).alias("begins"), F.lit(-1).alias("ends"), F.lit(True).alias("closes")).unionByName(self.joined.select("at", "begins", "ends", "closes"))
        return self.runs.join(choice.hint("merge"), "at").mapInArrow(_turns, "conv_id long, at long, place long, turn long, role string, text string, edit string")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as runs of one conversation each, in their order; a conversation is cut at ``RUN`` rows and where a batch ends."""
    seq = TaskContext.get().partitionId() << 32
    for b in slices(batches, "text", 8 << 20):
        ids = b.column("conv_id")
        null = np.asarray(ids.is_null())
        value = np.asarray(ids.fill_null(0))
        starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))
        ends = np.append(starts[1:], len(value))
        at = np.concatenate([*(np.arange(a, z, RUN) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), [len(value)]]).astype(np.int32)
        each = pa.array(np.arange(seq, seq + len(at) - 1))
        seq += len(at) - 1
        lists = [pa.ListArray.from_arrays(pa.array(at), b.column(c)) for c in ("turn", "copies", "fault", "role", "text")]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[:-1])), each, *lists], ["conv_id", "at", "turn", "copies", "fault", "role", "text"])


class _Runs:
    """The rows of a batch of runs, one after the other."""

    def __init__(self, b: pa.RecordBatch):
        column = lambda c: b.column(c).flatten()
        self.at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b.column("copies"))))]).astype(np.int64)
        self.role, self.text, self.turn = column("role"), column("text"), column("turn")
        self.copies, self.fault = np.asarray(column("copies")), np.asarray(column("fault"))
        first = pc.utf8_slice_codeunits(self.role, 0, 1)
        self.initial = np.asarray(pc.index_in(first, pa.array(INITIALS)).fill_null(len(INITIALS))).astype(np.int64)
        self.first = first
        self.classes = np.where((self.fault == BLANK) | (self.fault == DUPLICATE), GOES, self.initial * 2 + (self.fault == CUT))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.at])

    def written(self, k: int, steps: list, closing: tuple) -> tuple[str, list[str]]:
        """A run's audit, and the repaired rows of it."""
        audit, out = [], []
        a, z = int(self.at[k]), int(self.at[k + 1])
        copies = self.copies[a:z].tolist()
        for (letters, before, new), role, text, n in zip(steps, self.role[a:z].to_pylist(), self.text[a:z].to_pylist(), copies, strict=True):
            audit.append(letters if n == 1 else letters + "D" * (n - 1))
            out += [f"{x}:" for x in before]
            if letters[-1] != "D":
                out.append(f"{new or role}:{text}")
        audit.append("I" * len(closing))
        out += [f"{x}:" for x in closing]
        return "".join(audit), out


def _small(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of runs cut to about so many rows; one run stays whole."""
    for b in batches:
        held, start = 0, 0
        for i, n in enumerate(pc.list_value_length(b.column("copies")).to_pylist()):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if b.num_rows > start:
            yield b.slice(start)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _small(batches):
        r = _Runs(b)
        cost, rank, back = charts(r.classes, r.at)
        extra = DELETE * r.sums(r.copies - 1)  # copies beyond the first must go and change no item
        cost += extra[:, None, None]
        pairs = pc.binary_join_element_wise(r.first[:-1], r.first[1:], "") if len(r.first) else r.first
        wrong = np.append(~np.asarray(pc.is_in(pairs, pa.array(LEGAL))), False) if len(r.first) else np.zeros(0, bool)
        wrong[r.at[1:] - 1] = False
        blank = r.fault == BLANK
        duplicates = np.where(blank, 0, r.copies - 1 + (r.fault == DUPLICATE))
        turn, none = np.asarray(r.turn.fill_null(0)), np.asarray(r.turn.is_null())
        new = ~none
        new[1:] &= none[:-1] | (turn[1:] != turn[:-1])
        new[r.at[:-1]] = ~none[r.at[:-1]]
        least, most, audits, digests, totals = [], [], [], [], []
        for k in range(b.num_rows):
            a, z = int(r.at[k]), int(r.at[k + 1])
            seen = a + int(none[a:z].sum())
            least.append(int(turn[seen]) if seen < z else None)
            most.append(int(turn[z - 1]) if seen < z else None)
            q = best_end(cost[k, 0], rank[k, 0])
            audit, rows = r.written(k, steps(r.classes[a:z], back[a:z], 0, q), CHART.ends[q][1])
            audits.append(audit)
            digests.append(hashlib.sha256("\n".join(rows).encode()).hexdigest())
            totals.append(int(cost[k, 0, q]) + CHART.ends[q][0])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N * N).cast(pa.list_(kind)) for x, kind in ((cost, pa.int64()), (rank.astype(np.int32), pa.int32()))]
        numbers = [pa.array(r.sums(x), pa.int64()) for x in (np.where(blank, r.copies, 0), duplicates, (r.fault == CUT).astype(np.int64), wrong + r.copies - 1)]
        edges = [r.first.take(pa.array(x)) for x in (r.at[:-1], r.at[1:] - 1)]
        arrays = [b.column("conv_id"), b.column("at"), *lists, *numbers, *edges, pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(r.sums(new.astype(np.int64)), pa.int64()), pa.array(audits), pa.array(digests), pa.array(totals, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in Repair.PARSED.split(", ")])


_STATISTICS = "conv_id long, at long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, begins int, ends int, closes boolean, total long"


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Charts of a conversation's runs, in order, joined at their ends: which item each begins and ends with. A conversation leaves some 300 bytes for each run of up to 4096 rows here, whatever its texts."""
    held: list[pa.RecordBatch] = []
    came: list[np.ndarray] = []
    cost, rank, conv = None, None, ()

    def close() -> Iterator[pa.RecordBatch]:
        q = best_end(cost, rank)
        total = int(cost[q]) + CHART.ends[q][0]
        path = [q]
        for step in reversed(came):
            path.append(int(step[path[-1]]))
        path.reverse()
        rows = sum(x.num_rows for x in held)
        at = 0
        for x in held:
            n = x.num_rows
            more = [pa.array(path[at : at + n], pa.int32()), pa.array(path[at + 1 : at + n + 1], pa.int32()), pa.array([k + 1 == rows for k in range(at, at + n)]), pa.array([total] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*x.columns, *more], [*x.schema.names, "begins", "ends", "closes", "total"])
            at += n

    for b in batches:
        ids, costs, ranks = b.column("conv_id").to_pylist(), b.column("cost").to_pylist(), b.column("rank").to_pylist()
        start = 0
        for i, this in enumerate(ids):
            if conv != (this,):
                if conv:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    yield from close()
                conv, start, held, came = (this,), i, [], []
                cost, rank = np.full(N, NEVER), np.zeros(N, np.int64)
                cost[0] = 0
            each, place = np.array(costs[i]).reshape(N, N), np.array(ranks[i]).reshape(N, N)
            total = np.minimum(cost[:, None] + each, NEVER)
            step = np.argmin(total * N + rank[:, None], axis=0)
            came.append(step.astype(np.uint8))
            cost = total[step, np.arange(N)]
            rank = np.argsort(np.argsort(rank[step] * N + place[step, np.arange(N)]))
        held.append(b.slice(start))
    if conv:
        yield from close()


def _chosen(b: pa.RecordBatch) -> Iterator[tuple[int, _Runs, list, tuple]]:
    r = _Runs(b)
    cost, rank, back = charts(r.classes, r.at)
    for k, (first, last, closes) in enumerate(zip(b.column("begins").to_pylist(), b.column("ends").to_pylist(), b.column("closes").to_pylist(), strict=True)):
        last = best_end(cost[k, first], rank[k, first]) if last < 0 else last
        a, z = int(r.at[k]), int(r.at[k + 1])
        yield k, r, steps(r.classes[a:z], back[a:z], first, last), CHART.ends[last][1] if closes else ()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _small(batches):
        audits, texts = [], []
        for k, r, edits, closing in _chosen(b):
            audit, rows = r.written(k, edits, closing)
            audits.append(audit)
            texts.append("\n".join(rows).encode() if rows else None)
        names = [x.split(" ")[0] for x in _STATISTICS.split(", ")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(audits, pa.string()), pa.array(texts, pa.binary())], [*names, "audit", "repaired"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a conversation, in order, as one row."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv: tuple = ()
    state: dict = {}

    def out() -> pa.RecordBatch:
        gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["turns"]
        values = [conv[0], gaps, *state["sums"], state["cost"], "".join(state["audit"]), state["digest"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names)

    for b in slices(batches, "repaired", 4 << 20):
        for row in b.to_pylist():
            if conv != (row["conv_id"],):
                if conv:
                    yield out()
                conv = (row["conv_id"],)
                state = {"sums": [0, 0, 0, 0], "audit": [], "digest": hashlib.sha256(), "any": False, "least": None, "most": None, "turns": 0, "last": None, "cost": row["total"]}
            s = state
            s["sums"] = [x + row[c] for x, c in zip(s["sums"], names[2:6], strict=True)]
            s["sums"][3] += s["last"] is not None and s["last"] + row["first"] not in LEGAL
            s["last"] = row["last"]
            s["turns"] += row["turns"] - (row["least"] is not None and row["least"] == s["most"])
            s["least"] = row["least"] if s["least"] is None else s["least"]
            s["most"] = s["most"] if row["most"] is None else row["most"]
            s["audit"].append(row["audit"])
            if row["repaired"] is not None:
                s["digest"].update(b"\n" + row["repaired"] if s["any"] else row["repaired"])
                s["any"] = True
    if conv:
        yield out()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "at", "place", "turn", "role", "text", "edit"]
    for b in _small(batches):
        out = []
        convs, ats = b.column("conv_id").to_pylist(), b.column("at").to_pylist()
        for k, r, edits, closing in _chosen(b):
            a, z, rows = int(r.at[k]), int(r.at[k + 1]), []
            for (letters, before, new), turn, role, text in zip(edits, r.turn[a:z].to_pylist(), r.role[a:z].to_pylist(), r.text[a:z].to_pylist(), strict=True):
                rows += [(None, x, "", "I") for x in before]
                if letters[-1] != "D":
                    rows.append((turn, new or role, text, letters[-1]))
            rows += [(None, x, "", "I") for x in closing]
            out += [(convs[k], ats[k], place, *row) for place, row in enumerate(rows)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` and reports on the repair; a conversation of which no row is left has zeros and empty texts."""
    found = Repair(damage(conversations)).report()
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = every.join(found, _same("id", "conv_id"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
