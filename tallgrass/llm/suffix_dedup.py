"""Repeated byte strings of a fixed length, by prefix-free parsing and suffix arrays of its dictionary.

1. Rolling-hash triggers cut each text into phrases: a trigger is the least hash of 32 bytes among those that a
   string of 200 bytes can start with, so each string start has one trigger, found from the string alone, and equal strings
   have equal triggers at equal places. The starts that share a trigger, with all bytes that their strings cover, are a
   phrase. Distinct phrases are the dictionary and the rows (text, place, phrase) are the parse.
2. A phrase that the parse holds twice settles all its starts; one that shares its trigger with no other phrase and stands once
   has no repeat. The other phrases of the dictionary are opened.
3. The suffixes of opened phrases are sorted: Spark sorts them by the bytes from the trigger on, numpy by the bytes before it,
   read backwards. Longest common prefixes of neighbours in both orders tell, for every start, which suffixes agree on all
   200 bytes. Bytes are compared there, not hashes.
4. Corpus order comes from the parse: as phrases overlap by the bytes that a string covers, no suffix needs what follows its phrase to be
   told from another within 200 bytes, and equal ones stand in the order of their rows in the parse.

Matches never leave a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, data, mix, slices, utf8

GRAM = 32
#: Opened phrases that one task sorts at once (in 0.9 s, by a process of 180 MB at most); a trigger with more of them is sorted in parts, which tell each other
#: up to one digest for each start of a phrase.
PART = 1 << 15
#: Parts of a trigger that at least one in HOT phrases has; of such triggers there are HOT at most.
SALTS, HOT = 256, 1000
_POS = np.uint64(31)
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolled(flat: np.ndarray) -> np.ndarray:
    """A rolling hash of the GRAM bytes from each place on. It places triggers only: no two strings are equal by it."""
    total, have = _VALUES[flat], 1
    while have < GRAM:  # the sum over 2 * have bytes is the one over have bytes and the one behind it
        total = total[:-have] + total[have:] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2
    return mix(total)


def prints(held: memoryview, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of runs of bytes, as two numbers. The hash is a cryptographic one, so no pattern of bytes makes different runs agree."""
    digest = hashlib.blake2b
    made = np.frombuffer(b"".join([digest(held[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]), np.int64)
    return made[::2], made[1::2]


def padded(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of ``width`` bytes with zeros behind, and their sizes."""
    flat, at = data(values)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each row begins with that the row before begins with too; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        first = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def agreeing(group: np.ndarray, right: pa.Array, left: pa.Array, n: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts of phrases, (phrase, start) as a table: which agree on ``length`` bytes with another start of the same
    group, and which is the first of those that agree.

    Phrases come in the order of (group, right): ``right`` are the bytes from the trigger on, ``left`` those before it backwards, ``at``
    the trigger's place and ``n`` the starts. The string that starts ``c`` bytes before the trigger is c bytes of left and length - c of
    right. Suffixes whose neighbours share so many bytes are runs in either order; two starts agree if they are in one run of both.
    """
    m = len(n)
    lcp = common(*padded(right, length))
    lcp[1:][group[1:] != group[:-1]] = 0
    wide = -(-(length - GRAM) // 8) * 8
    rows, sizes = padded(left, max(8, wide))
    order = np.lexsort((sizes, *rows.view(">u8").astype(np.uint64).T[::-1]))
    lcs = common(rows[order], sizes[order])
    repeated, first = np.zeros((m, length - GRAM + 1), bool), np.zeros((m, length - GRAM + 1), bool)
    back = np.empty(m, np.int64)
    for c in range(int(at.max(initial=-1)) + 1):
        on = np.flatnonzero((at - n < c) & (c <= at))
        if not len(on):
            continue
        back[order] = np.cumsum(lcs < c)
        run = np.cumsum(lcp < length - c)[on] * (m + 1) + back[on]
        sort = np.argsort(run, kind="stable")
        run, on = run[sort], on[sort]
        new = np.ones(len(on) + 1, bool)
        new[1:-1] = run[1:] != run[:-1]
        repeated[on, at[on] - c] = ~(new[:-1] & new[1:])
        first[on, at[on] - c] = new[:-1]
    return repeated, first


def runs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of each run of true values in a row."""
    edge = np.zeros((len(table), table.shape[1] + 2), np.int8)
    edge[:, 1:-1] = table
    step = np.diff(edge, axis=1)
    of, begin = np.nonzero(step == 1)
    return of, begin, np.nonzero(step == -1)[1] - begin


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 1 << 20) -> Iterator[pa.Table]:
    """Sorted batches put together to about ``most`` bytes, cut only where a value of ``columns`` changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.nbytes for x in held) < most:
            continue
        table = pa.Table.from_batches(held)
        keys = [table[c].to_numpy() for c in columns]
        changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(changes):
            yield table.slice(0, int(changes[-1]))
            held = table.slice(int(changes[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def parse(flat: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase: first and last start, place and hash of its trigger. Texts shorter than ``length`` have none."""
    span = length - GRAM + 1
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    places = np.arange(n - GRAM + 1)
    grams = rolled(flat)
    # hash and place in one number: the least one is the leftmost least hash
    least = (grams >> _POS << _POS) | places.astype(np.uint64)
    have = 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: have - span], least[span - have :])
    trigger = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
    starts = np.zeros(len(trigger) + 1, bool)  # starts whose string ends in the same text
    step = np.zeros(len(trigger) + 2, np.int64)
    sizes = np.diff(at)
    texts = sizes >= length
    np.add.at(step, at[:-1][texts], 1)
    np.add.at(step, at[1:][texts] - length + 1, -1)
    starts[:-1] = np.cumsum(step)[: len(trigger)] > 0
    new = np.ones(len(trigger) + 1, bool)
    new[1:-1] = (trigger[1:] != trigger[:-1]) | ~starts[: len(trigger) - 1]
    edges = np.zeros(len(trigger) + 1, bool)
    inside = at[:-1][texts]
    edges[inside] = True  # a text's first start begins a phrase even where the trigger before is the same
    low = np.flatnonzero((new | edges)[:-1] & starts[:-1])
    ends = (new | edges)[1:] | ~starts[1:]
    high = np.flatnonzero(ends & starts[:-1])
    return low, high, trigger[low], grams[trigger[low]]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v) for v in columns.values()], list(columns))


def _parsed(b: pa.RecordBatch, length: int):
    flat, at = data(b.column("text"))
    low, high, trigger, gram = parse(flat, at, length)
    return memoryview(np.ascontiguousarray(flat)), at, low, high, trigger, gram, np.searchsorted(at, low, side="right") - 1


def _pairs(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """low and n of each list; nothing for a null."""
    low, n = (x.to_numpy() for x in lists.flatten().flatten())
    ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)).tolist()
    for begin, end in zip([0, *ends], ends, strict=False):
        yield low[begin:end], n[begin:end]


def repeated_bytes(docs: DataFrame, *, length: int = 200, text: str = "text", key: str = "doc_id", texts: bool = False) -> DataFrame:
    """For each row: key, n_bytes, n_removed, n_spans and kept_sha256, and with ``texts`` the bytes that are left.

    A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else, in the same text
    or another. A null text is empty; texts shorter than ``length`` keep all. A null or repeated key is kept, one output row for
    each input row; repeated rows are repeats of each other. Other columns are ignored; no rows give no rows.

    A text of any length is parsed whole. Tables are counted with partial sums before they are joined, and the joins of a trigger that
    at least one in ``HOT`` phrases has are cut into ``SALTS`` parts, so a phrase that a third of all rows hold is no task's alone. A trigger
    with more than ``PART`` phrases in the dictionary is sorted in parts, and one string of each class in a part meets those of the
    other parts by its digest. At most ``HOT`` triggers come to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    body = utf8(text)
    base = scratch.put(docs.select(F.col(key).cast("long").alias("id"), body.alias("text"), F.sha2(body, 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    source = base.where(F.octet_length("text") >= length).select("row", "text")

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield _batch(gram=_parsed(b, length)[5])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            held, at, low, high, trigger, gram, of = _parsed(b, length)
            k1, k2 = prints(held, low, high + length)
            rows = b.column("row").to_numpy()[of]
            gram = gram.view(np.int64)
            salt = np.where(np.isin(gram, hot), rows % SALTS, 0).astype(np.int32)
            yield _batch(gram=gram, salt=salt, k1=k1, k2=k2, row=rows, low=(low - at[of]).astype(np.int32), n=(high - low + 1).astype(np.int32), at=(trigger - low).astype(np.int32))

    # parse and dictionary, without the phrases whose trigger is the only one of its kind
    shared = scratch.put(source.mapInArrow(triggers, "gram long").groupBy("gram").count().where("count > 1"))
    every = shared.agg(F.sum("count")).first()[0] or 0
    hot = np.array([r.gram for r in shared.where(F.col("count") * HOT >= every).select("gram").collect()], np.int64)
    is_hot = F.col("gram").isin(hot.tolist()) if len(hot) else F.lit(False)
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    parsed = source.mapInArrow(phrases, "gram long, salt int, k1 long, k2 long, row long, low int, n int, at int")
    parsed = scratch.put(parsed.join(shared.select("gram", salts).hint("merge"), ["gram", "salt"]))
    scratch.drop(shared)
    words = ["gram", "k1", "k2"]
    first = F.min(F.struct("row", "low", "n", "at")).alias("one")
    dictionary = scratch.put(parsed.groupBy(*words).agg(F.count(F.lit(1)).alias("times"), first).select(*words, "times", "one.*"))
    twice = parsed.join(dictionary.where("times > 1").select(*words, salts).hint("merge"), [*words, "salt"])
    open_ = dictionary.groupBy("gram").agg(F.count(F.lit(1)).alias("phrases"), F.min("times").alias("least")).where("phrases > 1 and least = 1")
    open_ = open_.select("gram", F.ceil(F.col("phrases") / PART).cast("int").alias("parts"), salts)
    opened = dictionary.withColumn("salt", F.when(is_hot, F.pmod("k1", F.lit(SALTS))).otherwise(0).cast("int")).join(open_.hint("merge"), ["gram", "salt"])
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k2"), F.col("parts")).cast("int")).otherwise(-1)
    nothing = lambda kind: F.lit(None).cast(kind)
    marks = twice.select("row", F.struct("low", "n").alias("twice"), nothing("struct<low:int,n:int,at:int,gram:bigint,part:int>").alias("opened"))
    marks = marks.unionByName(opened.select("row", nothing("struct<low:int,n:int>").alias("twice"), F.struct("low", "n", "at", "gram", part.alias("part")).alias("opened")))
    held = scratch.put(source.join(marks.groupBy("row").agg(F.collect_list("twice").alias("twice"), F.collect_list("opened").alias("opened")).hint("merge"), "row"))
    scratch.drop(parsed, dictionary)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            flat, begins = data(b.column("text"))
            found = b.column("opened")
            of = np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy())
            one = dict(zip(("low", "n", "at", "gram", "part"), (x.to_numpy() for x in found.flatten().flatten()), strict=True))
            low = begins[of] + one["low"]
            trigger, end = low + one["at"], low + one["n"] - 1 + length
            bytes_ = flat.tobytes()
            right = [bytes_[x:y] for x, y in zip(trigger.tolist(), end.tolist(), strict=True)]
            left = [bytes_[x:y][::-1] for x, y in zip(low.tolist(), trigger.tolist(), strict=True)]
            yield _batch(gram=one["gram"], part=one["part"], row=b.column("row").to_numpy()[of], low=one["low"], n=one["n"], at=one["at"], right=pa.array(right, pa.binary()), left=pa.array(left, pa.binary()))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["gram", "part"]):
            gram, part, row, low, n, at = (t[c].to_numpy() for c in ("gram", "part", "row", "low", "n", "at"))
            right, left = (t[c].combine_chunks() for c in ("right", "left"))
            group = np.cumsum(np.concatenate([[False], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
            repeated, first = agreeing(group, right, left, n, at, length)
            of, begin, count = runs(repeated)
            none = pa.nulls(len(of), pa.int64())
            yield _batch(row=row[of], low=(low[of] + begin).astype(np.int32), n=count.astype(np.int32), w1=none, w2=none)
            # of a trigger in several parts one string of each class goes to meet the other parts'
            of, begin = np.nonzero(first & (part >= 0)[:, None])
            if len(of):
                mine, inverse = np.unique(of, return_inverse=True)
                texts = [x[::-1] + y for x, y in zip(left.take(pa.array(mine)).to_pylist(), right.take(pa.array(mine)).to_pylist(), strict=True)]
                bounds = np.cumsum([0, *map(len, texts)])[inverse] + begin
                w1, w2 = prints(memoryview(b"".join(texts)), bounds, bounds + length)
                yield _batch(row=row[of], low=(low[of] + begin).astype(np.int32), n=np.ones(len(of), np.int32), w1=w1, w2=w2)

    made = held.where("size(opened) > 0").select("row", "text", "opened").mapInArrow(suffixes, "gram long, part int, row long, low int, n int, at int, right binary, left binary")
    made = made.repartition("gram", "part").sortWithinPartitions("gram", "part", "right")
    found = scratch.put(made.mapInArrow(settled, "row long, low int, n int, w1 long, w2 long"))
    windows = found.where("w1 is not null")
    same = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    single = windows.join(same.hint("merge"), ["w1", "w2"]).select("row", "low", "n")
    more = scratch.put(found.where("w1 is null").select("row", "low", "n").unionByName(single).groupBy("row").agg(F.collect_list(F.struct("low", "n")).alias("more")))
    scratch.drop(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for raw, *found in zip(b.column("text"), _pairs(b.column("twice")), _pairs(b.column("more")), strict=True):
                raw = raw.as_py()
                inside = np.zeros(len(raw) + 1, np.int64)
                for low, n in found:
                    np.add.at(inside, low, 1)
                    np.add.at(inside, low + n - 1 + length, -1)
                gone = np.cumsum(inside)[:-1] > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if texts else None))
            removed, spans, sha, left = zip(*out, strict=True)
            columns = {"row": b.column("row"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(sha), "left": pa.array(left, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    done = held.select("row", "text", "twice").join(more.hint("merge"), "row", "left").mapInArrow(cut, "row long, n_removed long, n_spans long, kept string, left binary")
    rest = base.select("id", "row", "sha", F.octet_length("text").cast("long").alias("n_bytes"), *([F.col("text")] if texts else []))
    out = rest.join(done, "row", "left")
    columns = [F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.coalesce("left", "text").alias("kept_text")] if texts else []))
