"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes). Texts of one set are one class: a digest of
   the whole set groups them, and only a representative of each class goes on.
2. A signature of 125 minima is cut into 25 bands of 5. The members of a bucket (one band's value) are the
   candidates. First each bucket's members meet its most central one, that with the most neighbours over all
   its buckets: in a group of copies of one text that is the text itself. The links that hold give components.
3. A bucket that still holds two components has its members' signatures compared, whole against whole in
   blocks, but only pairs across components. A wide one is first split by later bands, which join most of what is alike, then
   compared in full.
4. Signatures are compared a batch of 25 minima at a time; a pair goes as soon as the posterior probability of a
   similarity at or over the threshold is below ``miss``. Survivors are verified on the full sets.

Every banded candidate pair is thus either inside a component, pruned by its posterior, or verified.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, SOLID, Scratch, data, mix, slices, span_hashes, spans, utf8
from .components import components

HASHES, ROWS, BATCH = 125, 5, 25
BANDS = HASHES // ROWS
#: How many times larger blocks are where a wide bucket is compared in full.
WIDER = 4
_SEEDS = np.random.default_rng(11).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(13).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(values: pa.Array, size: int, classes: bytes, seed: int = 0) -> list[np.ndarray]:
    """The hash of each text's shingles, place by place; of fewer words all of them are one shingle."""
    flat, at = data(values)
    flat = np.frombuffer(flat.tobytes().translate(classes), np.uint8)
    starts, ends = spans(flat, at, classes)
    hashes = span_hashes(flat, starts, ends, seed)
    n = len(hashes)
    bounds = np.searchsorted(starts, at)
    if n >= size:
        rolled = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            rolled = mix(rolled * _PLACES[8] ^ hashes[j : n - size + 1 + j])
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= size:
            out.append(rolled[i : j - size + 1])
        elif j > i:
            few = np.full(1, j - i, np.uint64)
            for at_word in range(i, j):
                few = mix(few * _PLACES[8] ^ hashes[at_word : at_word + 1])
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(values: pa.Array, size: int, classes: bytes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = [np.sort(s) for s in shingle_hashes(values, size, classes)]
    return [s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s for s in out]


def set_digests(values: pa.Array, size: int, classes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's set, and 128 bits of it: sums over its shingles of two hashes with seeds of their own."""
    sets, sums = [], np.zeros((len(values), 2), np.uint64)
    for i, (s, t) in enumerate(zip(shingle_hashes(values, size, classes), shingle_hashes(values, size, classes, 1), strict=True)):
        found, first = np.unique(s, return_index=True)
        sets.append(found)
        sums[i] = mix(found ^ _PLACES[10]).sum(dtype=np.uint64), t[first].sum(dtype=np.uint64)
    return sets, sums


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set under 128 multiplications (upper halves); empty sets are left out by callers."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) <= 1 << 15):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets[start:end]])[:-1]]).astype(np.int64)
        work = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _SEEDS[k], out=work)
            out[start:end, k] = np.minimum.reduceat(work, begins) >> np.uint64(32)
        start = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; a key holds its band, so that bands never meet."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _PLACES[9]
    for j in range(ROWS):
        mixed = mix(mixed + rows[:, :, j] * _PLACES[j])
    return mixed


@functools.lru_cache
def least_matches(percent: int, miss: float) -> list[int]:
    """For each prefix of BATCH, 2 * BATCH, ... minima, the fewest matches with which a pair goes on.

    The prior of the similarity is uniform on a grid; the posterior of s >= percent / 100 after m of n matches
    comes from the binomial likelihood.
    """
    grid = (np.arange(1000) + 0.5) / 1000
    over = grid >= percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        while m < n:
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[over].sum() >= miss * like.sum():
                break
            m += 1
        out.append(m)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    x, y = len(a), len(b)
    if 100 * min(x, y) < percent * max(x, y):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (x + y - shared)


def unpruned(x: np.ndarray, y: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs (x[i], y[i]) of signatures that no batch of minima prunes, and how many minima match."""
    kept, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n, low in enumerate(least_matches(percent, miss)):
        part = slice(n * BATCH, (n + 1) * BATCH)
        matches += np.count_nonzero(x[kept, part] == y[kept, part], axis=1)
        good = matches >= low
        kept, matches = kept[good], matches[good]
    return kept, matches


def across(sig: np.ndarray, left: np.ndarray, right: np.ndarray, parts: np.ndarray, path: list[int], percent: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of left x right in different parts that pass the pruning, and their matches; of a pair that
    meets in several bands only the bucket of its first one, or first ones where that bucket was split, yields it."""
    keys = band_keys(sig)
    for begin in range(0, len(left), 64):
        rows = left[begin : begin + 64]
        i, j = np.nonzero(parts[rows][:, None] != parts[right][None, :])
        i, j = rows[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good, matches = unpruned(sig[x], sig[y], percent, miss)
            x, y = x[good], y[good]
            if len(x):
                shared = keys[x, : path[-1] + 1] == keys[y, : path[-1] + 1]
                first = shared[:, path].all(axis=1) & (np.count_nonzero(shared, axis=1) == len(path))
                yield x[first], y[first], matches[first]


def connecting(sets: list[np.ndarray], parts: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], percent: int, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Verified links among ``pairs`` that join all that verified links of them join: of about ``most`` at a time the best matches first, and a pair
    whose ends are joined by then needs no test."""
    part = np.unique(parts, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def join() -> None:
        x, y, matches = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(-matches, kind="stable")
        x, y = x[order], y[order]
        while len(x):
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
            for i, j in zip(x[:256].tolist(), y[:256].tolist(), strict=True):
                if part[i] != part[j] and similar(sets[i], sets[j], percent):
                    part[part == part[j]] = part[i]
                    links.append((i, j))
            x, y = x[256:], y[256:]

    for found in pairs:
        held.append(found)
        if sum(len(x) for x, _, _ in held) >= most:
            join()
    if held:
        join()
    return links


def near_dedup(docs: DataFrame, *, size: int = 5, percent: int = 80, miss: float = 1e-4, letters_only: bool = True, block: int = 512, wide: int = 16, text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: key, n_shingles, component_id (the smallest key of its group) and kept; with ``extra`` also those
    columns and ``group_row``, a number of the row's group that holds without keys, null for an empty set.

    A text's set is its distinct shingles of ``size`` words; fewer words are one shingle; a null or empty text has
    an empty set, is linked with nothing and is kept. ``letters_only`` takes words of letters and digits, else
    of all but white space; A-Z count as a-z. Rows are linked at 100 * intersection >= percent * union of
    their sets. A null key takes part but is nobody's component while its group has a key; of rows that share the group's smallest key
    all are kept, as kept is doc_id = component_id (a group without any key: component null, all kept). Other columns are ignored; no
    rows give no rows.

    What moves: the texts once, for the members of buckets of two or more; 25 bands of 16 bytes for each class; a
    signature and a set for each candidate pair that meets. A bucket of any size is cut to blocks of ``block``
    members, and those of its largest component meet only the blocks of the others, so a million near copies and one stranger
    are sent once. Shingles are compared by 64-bit hashes without polynomial structure; texts are one class if two such hashes agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    classes = ALNUM if letters_only else SOLID
    base = scratch.put(docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("text"), F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"extra_{c}") for c in extra]))
    others = base.select("row", *[f"extra_{c}" for c in extra])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, digest = set_digests(b.column("text"), size, classes)
            digest = digest.view(np.int64)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), BANDS), np.uint64)
            if full:
                keys[full] = band_keys(signatures([sets[i] for i in full]))
            flat = pa.array(keys.view(np.int64).reshape(-1))
            bands = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands], ["id", "row", "n_shingles", "digest_a", "digest_b", "bands"])

    rows = scratch.put(base.mapInArrow(digests, "id long, row long, n_shingles long, digest_a long, digest_b long, bands array<long>"))
    digest = ["n_shingles", "digest_a", "digest_b"]
    groups = scratch.put(rows.where("n_shingles > 0").groupBy(*digest).agg(F.min("row").alias("class"), F.min("id").alias("least")))
    bands = rows.where("n_shingles > 0").join(groups.select(F.col("class").alias("row")).hint("merge"), "row").select("row", F.posexplode("bands").alias("at", "band"))
    shared = scratch.put(bands.groupBy("at", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = scratch.put(bands.join(shared.hint("merge"), ["at", "band"]))
    links = _links(base.select("row", "text"), buckets, rows.select("row", "bands"), scratch, size, percent, miss, classes, block, wide)
    if not extra:
        scratch.drop(base)
    parts = components(links, scratch).select(F.col("node").alias("class"), "component")
    named = scratch.put(groups.join(parts, "class", "left").select(*digest, "least", F.coalesce("component", "class").alias("component")))
    leasts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    leasts = scratch.put(named.join(leasts, "component").select(*digest, "component_id", F.col("component").alias("group_row")))
    if extra:
        rows = rows.join(others.hint("merge"), "row")
    out = rows.select("id", *digest, *[f"extra_{c}" for c in extra]).join(leasts, digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *(["group_row"] if extra else []), *[F.col(f"extra_{c}").alias(c) for c in extra])


def _links(base: DataFrame, buckets: DataFrame, bands: DataFrame, scratch: Scratch, size: int, percent: int, miss: float, classes: bytes, block: int, wide: int) -> DataFrame:
    """Verified links (a, b) that join all that verified links of banded candidates join."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), size, classes)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([s.tobytes() for s in signatures(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "sig", "shingles"])

    central = scratch.put(buckets.groupBy("row").agg(F.sum("n").alias("near")))
    held = scratch.put(base.select("row", "text").join(central.select("row").hint("merge"), "row").mapInArrow(kept, "row long, sig binary, shingles binary"))
    sig = held.select("row", "sig")
    whole = held.select("row", "shingles")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("x", "y"))
            yield b.select(["a", "b"]).take(pa.array(unpruned(x, y, percent, miss)[0]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def meet(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        x, y = (of.select(F.col("row").alias(k), F.col(column).alias(v)).hint("merge") for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def columns(group: pa.Table):
        rows, parts, side = (group[c].to_numpy() for c in ("row", "part", "side"))
        signs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        same = len(left) == len(right) == len(side)
        return rows, parts, across(signs, left, left if same else right, parts, group["path"][0].as_py(), percent, miss)

    def needed(group: pa.Table) -> pa.Table:
        """The rows of a block that some pair across components needs."""
        group = group.combine_chunks()
        _, _, pairs = columns(group)
        wanted = np.zeros(group.num_rows, bool)
        for x, y, _ in pairs:
            wanted[x] = wanted[y] = True
        return group.drop_columns(["sig"]).filter(pa.array(wanted))

    def joined(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows, parts, pairs = columns(group)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        links = connecting(sets, parts, pairs, percent)
        return pa.table({"a": pa.array([rows[i] for i, _ in links], pa.int64()), "b": pa.array([rows[j] for _, j in links], pa.int64())})

    weighed = buckets.join(central, "row")
    hubs = weighed.groupBy("at", "band").agg(F.max(F.struct("near", (-F.col("row")).alias("minus"))).alias("hub"))
    stars = buckets.join(hubs.select("at", "band", (-F.col("hub.minus")).alias("hub")), ["at", "band"]).where("row <> hub")
    stars = scratch.put(stars.select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct())
    pairs = scratch.put(meet(stars, sig, "sig").mapInArrow(prune, "a long, b long"))
    links = scratch.put(meet(pairs, whole, "shingles").mapInArrow(verify, "a long, b long"))

    def labelled(of: DataFrame, links: DataFrame) -> DataFrame:
        parts = components(links, scratch).select(F.col("node").alias("row"), "component")
        return scratch.put(of.join(parts.hint("merge"), "row", "left").select("at", "band", "row", F.coalesce("component", "row").alias("part"), F.array("at").alias("path")))

    def measured(level: DataFrame, block: int) -> DataFrame:
        """Of each bucket with two components: the largest one, and how many blocks it and the others fill."""
        mixed = level.groupBy("at", "band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("at", "band")
        sizes = level.join(mixed, ["at", "band"]).groupBy("at", "band", "part").agg(F.count(F.lit(1)).alias("members"))
        largest = sizes.groupBy("at", "band").agg(F.sum("members").alias("all"), F.max(F.struct("members", "part")).alias("big"))
        blocks = lambda n: F.ceil(n / block).cast("int")
        return scratch.put(largest.select("at", "band", F.col("big.part").alias("big"), blocks(F.col("all") - F.col("big.members")).alias("others"), blocks(F.col("big.members")).alias("bigs")))

    def compared(found: DataFrame) -> DataFrame:
        """Links of all pairs across components in buckets: a bucket's largest component comes after the others' blocks; its blocks meet theirs, never each other."""
        open_ = found.withColumn("inside", F.col("part") == F.col("big")).join(sig.hint("merge"), "row")
        share = F.pmod(F.xxhash64("row"), F.when(F.col("inside"), F.col("bigs")).otherwise(F.col("others"))).cast("int")
        open_ = open_.withColumn("mine", share + F.when(F.col("inside"), F.col("others")).otherwise(0))
        # block i meets every block j >= i; side 0 is i's, 1 is j's, 2 where both are the same
        last = F.when(F.col("inside"), F.col("others")).otherwise(F.col("others") + F.col("bigs")) - 1
        one = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j"), F.when(k == F.col("mine"), 2).when(k > F.col("mine"), 0).otherwise(1).alias("side")))
        tasks = open_.select("at", "band", "path", "row", "part", "sig", F.explode(one).alias("t")).select("at", "band", "path", "row", "part", "sig", "t.*")
        block_of = ["at", "band", "i", "j"]
        left = scratch.put(tasks.groupBy(*block_of).applyInArrow(needed, "at int, band long, path array<int>, row long, part long, i int, j int, side int"))
        return left.join(held.hint("merge"), "row").groupBy(*block_of).applyInArrow(joined, "a long, b long")

    level, narrow, rest = labelled(buckets, links), [], None
    while True:
        largest = measured(level, block)
        narrow.append(level.join(largest.where(F.col("others") <= wide), ["at", "band"]))
        many = largest.where(F.col("others") > wide)
        if many.isEmpty():
            break
        rest = many.select("at", "band") if rest is None else rest
        later = level.join(many.select("at", "band"), ["at", "band"]).join(bands.hint("merge"), "row").select("at", "band", "row", "part", "path", F.posexplode("bands").alias("next", "key")).where(F.col("next") > F.element_at("path", -1))
        level = scratch.put(later.select("at", F.xxhash64("band", "next", "key").alias("band"), "row", "part", F.concat("path", F.array("next")).alias("path")))
    links = scratch.put(links.unionByName(compared(reduce(DataFrame.unionByName, narrow))))
    if rest is None:
        return links
    # the splits join most of a wide bucket; what they leave apart meets in full, in larger blocks that are sent fewer times
    level = labelled(buckets.join(rest, ["at", "band"], "left_semi"), links)
    more = compared(level.join(measured(level, WIDER * block), ["at", "band"]))
    return scratch.put(links.unionByName(more))
