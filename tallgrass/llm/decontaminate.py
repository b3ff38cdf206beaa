"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-cased words, and words to numbers. Of each window of ten words of a benchmark item the
rarest run of five is a key; one automaton holds the keys, spelt in digits of word numbers, and each text is
scanned once. Around a key that is found the text is held against the windows the key stands for. Hits
are mapped back to words and to byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, mix, slices, spans, utf8, words

KEY = 5
#: Contexts of a key up to which each is compared at a hit; more are looked up by their windows.
FEW = 4
#: Bytes of text that a task holds while it scans them by one part after the other.
HELD = 64 << 20
_DIGIT = 6  # bits of a digit; each place of a word's spelling has digits of its own, so that no key is found between words
OUT = "key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


class Machine:
    """The automaton over items (name, text): keys of ``KEY`` words that every window of ``size`` words holds one of.

    A key's value is a list of (context, offset, items): the words of the windows it stands for, where in them it is, and the
    numbers of the items that have them. An item of fewer words, but not none, is one window and one key.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        import ahocorasick

        self.size, self.key = size, min(KEY, size)
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number) + 1) for w in words(body)] for _, body in items]
        self.width = max(1, -(-len(number).bit_length() // _DIGIT))
        mask = (1 << _DIGIT) - 1
        self.spelt = {w: "".join(chr(1 + (k << _DIGIT) + (n >> _DIGIT * k & mask)) for k in range(self.width)) for w, n in number.items()}
        self.unknown = "\0" * self.width
        spelling = ["", *self.spelt.values()]
        owners: dict[str, dict[tuple[str, int], set[int]]] = {}
        for i, (found, keys) in enumerate(zip(texts, self.chosen(texts), strict=True)):
            spelt = "".join([spelling[n] for n in found])
            for at, n, low, high in keys:
                key = spelt[at * self.width : (at + n) * self.width]
                owners.setdefault(key, {}).setdefault((spelt[low * self.width : high * self.width], at - low), set()).add(i)
        self.machine = ahocorasick.Automaton()
        for key, of in owners.items():
            n = len(key) // self.width
            self.machine.add_word(key, (n, self.windows(n, of) if len(of) > FEW else [(context, offset, tuple(numbers)) for (context, offset), numbers in of.items()]))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def windows(self, n: int, of: dict[tuple[str, int], set[int]]) -> dict[tuple[int, str], tuple[int, ...]]:
        """The windows around a key that many contexts share: (where in it the key is, its words) -> items, so that a hit takes as many look-ups as the key has places in a window."""
        out: dict[tuple[int, str], set[int]] = {}
        for (context, offset), numbers in of.items():
            whole = len(context) // self.width
            size = min(self.size, whole)
            for start in range(max(0, offset + n - size), min(offset, whole - size) + 1):
                out.setdefault((offset - start, context[start * self.width : (start + size) * self.width]), set()).update(numbers)
        return {k: tuple(v) for k, v in out.items()}

    def chosen(self, texts: list[list[int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each item its keys: place, words, and from where to where the windows go that it stands for."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.array([n for t in texts for n in t], np.uint64)
        runs = np.zeros(max(0, len(flat) - self.key + 1), np.uint64)
        for j in range(self.key):
            runs = mix(runs ^ flat[j : len(flat) - self.key + 1 + j])
        _, back, times = np.unique(runs, return_inverse=True, return_counts=True)
        rare = times[back]
        begins = np.cumsum(sizes) - sizes
        for begin, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n < self.size:
                yield [(0, n, 0, n)] if n else []
                continue
            span = self.size - self.key + 1
            order = np.lexsort((runs[begin : begin + n - self.key + 1], rare[begin : begin + n - self.key + 1]))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            least = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(axis=1) + np.arange(n - self.size + 1)
            keys, first, count = np.unique(least, return_index=True, return_counts=True)
            yield [(k, self.key, f, f + c - 1 + self.size) for k, f, c in zip(keys.tolist(), first.tolist(), count.tolist(), strict=True)]

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges that windows cover, merged, and the numbers of the items hit."""
        if self.empty or not found:
            return [], set()
        get, width, unknown = self.spelt.get, self.width, self.unknown
        flat = "".join([get(w, unknown) for w in found])
        hits, of, seen = [], set(), set()
        for end, (n, contexts) in self.machine.iter(flat):
            at = (end + 1) // width - n
            if isinstance(contexts, dict):
                for before in range(min(at, self.size - n) + 1):
                    window = (before, flat[(at - before) * width : (at - before + self.size) * width])
                    if (numbers := contexts.get(window)) is not None:
                        hits.append((at - before, at - before + self.size))
                        if window not in seen:  # a window of many items is told once a text
                            seen.add(window)
                            of.update(numbers)
                continue
            for context, offset, numbers in contexts:
                # how far the text goes along with the context to both sides of the key
                left = right = 0
                while left < offset and at - left and flat[(at - left - 1) * width : (at - left) * width] == context[(offset - left - 1) * width : (offset - left) * width]:
                    left += 1
                rest = min(len(context) // width - offset, len(found) - at) - n
                while right < rest and flat[(at + n + right) * width : (at + n + right + 1) * width] == context[(offset + n + right) * width : (offset + n + right + 1) * width]:
                    right += 1
                if left + n + right >= min(self.size, len(context) // width):
                    hits.append((at - left, at + n + right))
                    of.update(numbers)
        return merged(hits), of


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_machines: dict[str, tuple[Machine, list[str]]] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", part_words: int = 1 << 19, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated, the list of items and
    the ``spans`` hit, as byte offsets into the UTF-8 text; and the columns of ``keep``.

    Null or empty texts have no words and no hits; a null or repeated key is kept, one output row
    for each input row; other columns are ignored. Items with a null key, a null text or no words are never
    hit; items that share a key count once. Without items, or without documents, nothing is hit.

    The benchmark is measured first and cut by its items' hashes into parts of about ``part_words`` words (one longer item stays whole),
    so no automaton grows with either table. A word makes about five nodes of the automaton, never more than ``KEY`` times its digits. Each part is sent by itself; a task has one automaton at a time. Each text is
    read once: where there are several parts a task holds some ``HELD`` bytes of texts and scans them by one part after the other.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("string").alias("item"), utf8(item_text).alias("body"), F.col(item_text).alias("body_text"))
    n_words = items.agg(F.coalesce(F.sum(F.regexp_count("body_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-n_words // part_words))
    rows = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = [f"keep_{c}" for c in keep]
    kept_schema = "".join(f", `keep_{c}` {dict(docs.dtypes)[c]}" for c in keep)
    sent = []
    for part in range(parts):
        held = [(r.item, bytes(r.body)) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]
        name = f"{hashlib.sha256(repr(sorted(held)).encode()).hexdigest()}-{window}"
        sent.append((spark.sparkContext.broadcast(held), name))

    def machine_of(part: int) -> tuple[Machine, list[str]]:
        value, name = sent[part]
        if name not in _machines:
            _machines.clear()
            _machines[name] = (Machine(value.value, window), [x for x, _ in value.value])
            if parts > 1:
                value.__dict__.pop("_value", None)  # the items are in the automaton; the next part's take their place
        return _machines[name]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(slices(batches, "text"), HELD if parts > 1 else 0):
            found: list[list] = [[([], set())] * b.num_rows for b in group]
            for part in range(parts):
                machine, ids = machine_of(part)
                for k, b in enumerate(group):
                    found[k] = [_added(raw, had, machine, ids) for raw, had in zip(b.column("text").to_pylist(), found[k], strict=True)]
            for b, of in zip(group, found, strict=True):
                made = _results(b, of)
                yield pa.RecordBatch.from_arrays([*made.columns, *(b.column(c) for c in kept)], [*made.schema.names, *kept])

    out = rows.mapInArrow(scanned, OUT + kept_schema)
    return out.select(F.col("key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", *[F.col(f"keep_{c}").alias(c) for c in keep])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _added(raw: bytes, had: tuple[list[tuple[int, int]], set[str]], machine: Machine, ids: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges hit and items, with those of one more part."""
    hits, of = machine.scan(words(raw))
    return (merged(had[0] + hits), had[1] | {ids[i] for i in of}) if hits else had


def _results(b: pa.RecordBatch, found: list[tuple[list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")}
    for raw, (hits, of) in zip(b.column("text").to_pylist(), found, strict=True):
        names = sorted(of)
        out["n_words"].append(len(words(raw)))
        out["n_hit"].append(sum(y - x for x, y in hits))
        out["n_items"].append(len(names))
        out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
        out["contaminated"].append(bool(hits))
        if hits:
            flat = np.frombuffer(raw.translate(ALNUM), np.uint8)
            starts, ends = spans(flat, np.array([0, len(flat)]))
            hits = [(int(starts[x]), int(ends[y - 1])) for x, y in hits]
        out["items"].append(names)
        out["spans"].append([{"start": x, "end": y} for x, y in hits])
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    return pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(out[k], t) for k, t in kinds.items())], ["key", *kinds])
