"""Phrases whose words stand together more often than their parts would by themselves.

Three passes over the texts, each a single map over whole texts:

1. words are counted by language, which gives their numbers and the size of the sketch;
2. each task counts its phrases into a count-min sketch of two rows. Sketches are merged block by block, each block in one task that holds
   64 Ki counters, and of a merged block only one bit a counter goes on: whether it reached the least count;
3. phrases whose counters all did, and whose parts did too, are counted exactly. A counter never falls short of a phrase's count, so
   no frequent phrase is lost, and one that only seemed frequent goes by its exact count.

Scores and what longer phrases subsume are joins of the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _ODD, Scratch, data, equal_spans, mix, partitions, slices, span_hashes, spans

#: Bytes of words after A-Z are lower-cased, all that ends a word or a piece of text as a space; and which bytes end a piece.
_SPLIT = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
WORD = bytes(0x20 if b in b" \t" or b in _SPLIT else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ENDS = np.array([b in _SPLIT for b in range(256)])
BLOCK = 1 << 16
ROWS = 2
#: Counters of a row of the sketch, at most: as bits two rows of them are 32 MB.
MOST_COUNTERS = 1 << 27
#: Bytes of text that a task counts at once.
AT_ONCE = 4 << 20


@dataclass
class Grams:
    """The phrases of ``size`` words in a batch: which distinct phrase is where, and for each distinct one its hash and how often it occurs."""

    size: int
    at: np.ndarray  # the number of the first word of each phrase
    code: np.ndarray  # the distinct phrase there
    first: np.ndarray  # of each distinct phrase, a place in ``at``
    hashes: np.ndarray
    counts: np.ndarray


class Batch:
    """Words of texts, one after the other, and the phrases they make. Words and phrases of two languages are never the same."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        flat, at = data(texts)
        coded = languages.dictionary_encode()
        self.languages = coded.dictionary.to_pylist()
        self.low = np.frombuffer(flat.tobytes().translate(WORD), np.uint8)
        self.begin, self.end = spans(self.low, at)
        text = np.searchsorted(at, self.begin, side="right") - 1
        self.language = np.asarray(coded.indices)[text].astype(np.int64)
        # words follow each other if no end of a piece and no end of a text is between them
        piece = np.cumsum(ENDS[flat])[self.begin] if len(flat) else self.begin
        self.joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])

    def words(self) -> Grams:
        """Told apart by hashes whose bytes are compared; where a hash is two words' the later one gets another number. The sketch takes the first
        hash of each, which is the same in every batch."""
        each = np.array([hash_of(x) for x in self.languages], np.uint64)[self.language] if len(self.begin) else np.zeros(0, np.uint64)
        plain = hashes = mix(span_hashes(self.low, self.begin, self.end) ^ each)
        sizes, seed = self.end - self.begin, 0
        while True:
            code, found = pd.factorize(hashes)
            first = firsts(code, len(found))
            other = first[code]
            wrong = (sizes != sizes[other]) | (self.language != self.language[other])
            wrong |= ~equal_spans(self.low, self.begin, self.low, self.begin[other], np.where(wrong, 0, sizes))
            if not wrong.any():
                return Grams(1, np.arange(len(hashes)), code, first, plain[first], np.bincount(code, minlength=len(found)))
            far, seed = np.flatnonzero(wrong), seed + 1
            hashes = hashes.copy()
            hashes[far] = mix(span_hashes(self.low, self.begin[far], self.end[far], seed) ^ each[far])

    def longer(self, shorter: Grams, words: Grams) -> Grams:
        """Phrases of one word more than ``shorter``: two numbers of distinct parts tell them apart."""
        last = shorter.at + shorter.size - 1
        on = np.flatnonzero((last + 1 < len(self.begin)) & np.append(self.joined, False)[np.minimum(last, len(self.joined))]) if len(last) else np.zeros(0, np.int64)
        keys = shorter.code[on].astype(np.int64) * max(1, len(words.first)) + words.code[last[on] + 1]
        code, found = pd.factorize(keys)
        first = firsts(code, len(found))
        hashes = mix(shorter.hashes[shorter.code[on[first]]] * _ODD ^ words.hashes[words.code[last[on[first]] + 1]])
        return Grams(shorter.size + 1, shorter.at[on], code, first, hashes, np.bincount(code, minlength=len(found)))

    def phrase(self, gram: Grams, which: np.ndarray) -> list[bytes]:
        """The words of distinct phrases, joined by a space."""
        raw, at = self.low.tobytes(), gram.at[gram.first[which]]
        each = [[raw[a:b] for a, b in zip(self.begin[at + k].tolist(), self.end[at + k].tolist(), strict=True)] for k in range(gram.size)]
        return list(map(b" ".join, zip(*each, strict=True)))


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]), 99)[0])


def firsts(code: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return out


def kept(gram: Grams, stays: np.ndarray) -> Grams:
    """Only the distinct phrases that stay, numbered anew."""
    to = np.cumsum(stays) - 1
    on = np.flatnonzero(stays[gram.code])
    place = np.full(len(gram.at), -1, np.int64)
    place[on] = np.arange(len(on))
    return Grams(gram.size, gram.at[on], to[gram.code[on]], place[gram.first[stays]], gram.hashes[stays], gram.counts[stays])


class Bits:
    """Of each counter of the merged sketch whether it reached the least count."""

    def __init__(self, raw: bytes, width: int):
        self.bits, self.width = np.frombuffer(raw, np.uint8), width

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(ROWS):
            cell = cells(hashes, row, self.width)
            out &= (self.bits[row * (self.width >> 3) + (cell >> 3)] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The two halves of a hash are as good as two hashes."""
    return (hashes >> np.uint64(32 * row) & np.uint64(width - 1)).astype(np.int64)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Texts by about ``AT_ONCE`` bytes: short ones are put together, long ones cut where a piece ends, which no phrase crosses."""
    texts, langs, size = [], [], 0
    for b in slices(rows, "text", AT_ONCE):
        for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
            raw = text.as_buffer()
            for part in cut(raw) if raw is not None and raw.size > AT_ONCE else [raw]:
                if size and size + part.size > AT_ONCE:
                    yield Batch(_strings(texts), pa.array(langs, pa.string()))
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang.as_py())
                size += part.size
    if texts:
        yield Batch(_strings(texts), pa.array(langs, pa.string()))


def _strings(texts: list[pa.Buffer]) -> pa.Array:
    return pa.array([x.to_pybytes() for x in texts], pa.large_binary())


def cut(raw: pa.Buffer) -> Iterator[pa.Buffer]:
    start, flat = 0, np.frombuffer(raw, np.uint8)
    while raw.size - start > AT_ONCE:
        stop = start + AT_ONCE
        while stop < raw.size and not (near := np.flatnonzero(ENDS[flat[stop : stop + AT_ONCE]])).size:
            stop += AT_ONCE
        if stop >= raw.size:
            break
        stop += int(near[0]) + 1
        yield raw.slice(start, stop - start)
        start = stop
    yield raw.slice(start)


def phrase_counts(docs: DataFrame, *, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", counters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of every word and phrase of up to ``longest`` words with ``least`` occurrences: (lang, phrase, size, a), and of all words: (lang, n)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            n = np.bincount(b.language, minlength=len(b.languages))
            yield pa.RecordBatch.from_arrays([pa.array(b.languages, pa.string()), pa.array(n, pa.int64())], ["lang", "n"])

    totals = scratch.put(rows.mapInArrow(numbers, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # about a counter for every two phrases, as far as the bound goes; beyond it more phrases pass and are counted exactly
    width = counters or min(MOST_COUNTERS, max(BLOCK, 1 << int(max(1, total * longest // 4)).bit_length()))
    blocks = width // BLOCK

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            hashes, counts = [], []
            gram = words = b.words()
            for size in range(1, longest + 1):
                gram = gram if size == 1 else b.longer(gram, words)
                hashes.append(gram.hashes)
                counts.append(gram.counts)
            h, n = np.concatenate(hashes), np.minimum(np.concatenate(counts), least).astype(np.uint32)
            for row in range(ROWS):
                cell = cells(h, row, width)
                order = np.argsort(cell)
                cell, count = cell[order], n[order]
                cut = np.searchsorted(cell, np.arange(blocks + 1) * BLOCK)
                there = np.flatnonzero(cut[1:] > cut[:-1])
                low = (cell % BLOCK).astype("<u2").tobytes()
                held = count.astype(np.uint8 if least < 256 else "<u4")
                step = held.dtype.itemsize
                held = held.tobytes()
                ranges = list(zip(cut[there].tolist(), cut[there + 1].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there + row * blocks, pa.int64()), pa.array([low[2 * x : 2 * y] for x, y in ranges], pa.binary()), pa.array([held[step * x : step * y] for x, y in ranges], pa.binary())], ["block", "cells", "counts"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(BLOCK, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for k, low, held in zip(b.column("block").to_pylist(), b.column("cells"), b.column("counts"), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block = k
                    sums[:] = 0
                counts = np.frombuffer(held.as_py(), np.uint8 if least < 256 else "<u4")
                sums += np.bincount(np.frombuffer(low.as_py(), "<u2"), counts, BLOCK).astype(np.int64)
        if block is not None:
            yield out()

    parts = rows.mapInArrow(sketch, "block long, cells binary, counts binary")
    merged = parts.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    bits = np.zeros(ROWS * width >> 3, np.uint8)
    for r in merged.collect():  # at most ROWS * MOST_COUNTERS bits
        bits[r.block * (BLOCK >> 3) : (r.block + 1) * (BLOCK >> 3)] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bits.tobytes())

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = Bits(sent.value, width)
        for b in _batches(batches):
            gram = words = b.words()
            frequent = reached(words.hashes)
            before = None
            for size in range(1, longest + 1):
                if size > 1:
                    gram = b.longer(gram, words)
                    # the part without the last word stays by how gram is made, that without the first is looked up
                    there = np.zeros(len(b.begin) + 1, bool)
                    there[before] = True
                    gram = kept(gram, reached(gram.hashes) & there[gram.at[gram.first] + 1])
                else:
                    gram = kept(gram, frequent)
                before = gram.at
                which = np.arange(len(gram.first))
                langs = pa.DictionaryArray.from_arrays(pa.array(b.language[gram.at[gram.first]], pa.int32()), pa.array(b.languages, pa.string())).cast(pa.string()) if len(which) else pa.array([], pa.string())
                for at in range(0, len(which), 50_000):
                    part = which[at : at + 50_000]
                    phrases = pa.array(b.phrase(gram, part), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs.slice(at, len(part)), phrases, pa.array(np.full(len(part), size), pa.int32()), pa.array(gram.counts[part], pa.int64())], ["lang", "phrase", "size", "a"])

    exact = rows.mapInArrow(survivors, "lang string, phrase string, size int, a long").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    counts = scratch.put(exact)
    sent.unpersist()
    return counts, totals


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, covers: int = 50, most: int = 2000, text: str = "text", lang: str = "lang", counters: int | None = None) -> DataFrame:
    """Phrases of two to ``longest`` words by language, best first: lang, rank, phrase, a, l, r, n, score.

    A phrase with a = f(phrase) >= ``least`` is cut after its first k words into parts of l and r occurrences; its score is the least
    floor(1000000 * a * a / (l * r)) over k, ties to the smallest k. It goes if a longer phrase that holds its words in a row has
    ``covers`` hundredths of its occurrences. Each language's ``most`` best are returned, by score and a descending, then by phrase.

    A null language is ``und``, a null text is empty; rows with equal keys or texts count each for itself; no key is read; other columns are ignored; no rows give
    no rows. Counts are of whole texts of any length. ``counters`` sets the sketch's width (a power of two, 65536 at least), which changes the work and never the result.
    """
    counts, totals = phrase_counts(docs, longest=longest, least=least, text=text, lang=lang, counters=counters)
    scratch = Scratch(docs.sparkSession, "collocations-scored")
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = counts.where("size > 1").withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    have = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    both = cuts.join(have("left", "l"), ["lang", "left"]).join(have("right", "r"), ["lang", "right"])
    # 10^6 * a * a stays below 10^38 up to 10^16 occurrences; a is at most l and r, so the quotient is at most 10^6
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    both = both.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("top div under"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = counts.where("size > 2").withColumn("w", words).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1))).select("lang", part(F.col("s"), F.col("n")).alias("phrase"), F.col("a").alias("over"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covers * F.col("a"))).drop("over")
    left = scratch.put(left)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first of each of many parts of a language, so that no task sorts a whole one
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*best)
    left = left.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
