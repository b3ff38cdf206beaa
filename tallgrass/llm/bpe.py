"""Byte pair encoding by backtracking, and decoding by an offset table.

One Aho-Corasick pass over a word gives the longest token at each place. Tokens are taken greedily; a token may follow another
if no merge would have crossed the seam between them (``Merges.fits``), else the next shorter token that begins there is tried, and where none
is left the last token is taken back and its end never tried again. A row of tokens whose neighbours all fit is what merging by rank
gives, and each place is left at most once for each token that begins there, so the time grows with the word's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import data, slices
from .piece_table import PieceTable, plain
from .pieces import PieceCache
from .token_output import WORDS

#: Added to the last character of a word where the vocabulary marks word ends, so that a mark is no character of its own.
FINAL = 0x10000


class Merges:
    """Tokens as strings of symbols, how each was merged, and which pairs of tokens may stand beside each other."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str | None, most: int = 1 << 20):
        self.suffix, self.most = suffix, most
        symbols = {t: self.symbols(t) for t in vocabulary}
        if suffix and any(len(s) == 0 for s in symbols.values()):
            raise ValueError("a token is nothing but the mark of a word's end")
        self.size = {i: len(symbols[t]) for t, i in vocabulary.items()}
        self.whole = {s: vocabulary[t] for t, s in symbols.items()}
        self.rank: dict[tuple[int, int], int] = {}
        born: dict[int, int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocabulary[a], vocabulary[b], self.whole[symbols[a] + symbols[b]]
            if made in born or born.get(x, -1) >= rank or born.get(y, -1) >= rank:
                raise ValueError("each token must come from one merge of earlier tokens")
            self.rank[x, y], born[made], halves[made] = rank, rank, (x, y)
        never = len(merges)
        # what stands at a token's end (side 1) or start (side 0) while it is merged, the last first, and the rank at which it goes
        self.edges: tuple[dict, dict] = ({}, {})
        for i in self.size:
            for side in (0, 1):
                at, until, out = i, never, []
                while True:
                    out.append((at, until))
                    if at not in halves:
                        break
                    at, until = halves[at][side], born[at]
                self.edges[side][i] = out
        self.known: dict[tuple[int, int], bool] = {}
        # a token that other merges keep from being made, or one of its halves, is never in a result
        lost: set[int] = set()
        for i, pair in halves.items():
            if not lost.isdisjoint(pair) or any(p != pair for p in self.crossing(*pair)):
                lost.add(i)
        self.whole = {s: i for s, i in self.whole.items() if i not in lost}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.whole.items():
            self.machine.add_word(s, i)
        self.machine.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for s, i in self.whole.items():
            self.shorter[i] = next((self.whole[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.whole), None)

    def symbols(self, token: str) -> str:
        if not self.suffix or not token.endswith(self.suffix):
            return token
        word = token[: -len(self.suffix)]
        return word[:-1] + chr(ord(word[-1]) + FINAL) if word else ""

    def crossing(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Merges that would join what stands to both sides of the seam of ``a`` and ``b`` while they are merged by themselves. Of equal
        merges the left one comes first: at the rank of a merge to its left the left part is gone, the right part isn't yet."""
        for x, left in self.edges[1][a]:
            for y, right in self.edges[0][b]:
                rank = self.rank.get((x, y))
                if rank is not None and rank < left and rank <= right:
                    yield x, y

    def fits(self, a: int, b: int) -> bool:
        """The table of pairs, filled as pairs are met, of a bounded size."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[a, b] = next(self.crossing(a, b), None) is None
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one word, given as symbols. Symbols that no token has are left out, as merging by rank does without an unknown token."""
        if (one := self.whole.get(word)) is not None:
            return [one]
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        longest = np.full(n + 1, -1, np.int32)
        for end, t in self.machine.iter(word):
            longest[end + 1 - size[t]] = t
        if (longest[:n] < 0).any():
            return self.around_unknown(word)
        dead, out, at, token = bytearray(n + 1), [], 0, int(longest[0])
        while at < n:
            last = out[-1] if out else None
            while token is not None and (dead[at + size[token]] or last is not None and not fits(last, token)):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = int(longest[at])
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def around_unknown(self, word: str) -> list[int]:
        # a symbol that isn't known breaks no merge: those beside it become neighbours
        return self.encode("".join(c for c in word if c in self.whole)) if any(c in self.whole for c in word) else []


class BytePairs:
    """Encoder and decoder of one tokenizers file with a BPE model; a process keeps one for each file.

    The library's own normaliser and pre-tokenizer cut a text into words; the words' ids come from ``Merges``. Special tokens inside a
    text are what they are to the library. Texts of Latin-1 without what may begin a special token go through a table of pieces.
    """

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        made = json.loads(library.to_str())
        model = made["model"]
        if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("only plain byte pair encoding: no dropout, unknown token, prefixes, byte fallback or ignored merges")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        if made["decoder"]:
            raise ValueError("only tokenizers that decode by joining tokens with a space")
        self.normalizer, self.words_of = library.normalizer, library.pre_tokenizer
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.marks = ahocorasick.Automaton()
        for t in self.added:
            self.marks.add_word(t, t)
        if self.added:
            self.marks.make_automaton()
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_pieces = steps == ["NFC", "Replace", "Lowercase"] and patterns[:1] == [WORDS] and model["end_of_word_suffix"] == "</w>" and all(t.startswith("<|") for t in self.added)
        self.table = PieceTable(self.pieces)
        self.cache = PieceCache(lambda words: [self.word(x) for x in words])
        every = {**{t: i for t, i in model["vocab"].items()}, **self.added}
        names = [b""] * (max(every.values()) + 1)
        self.there = np.zeros(len(names), bool)
        for t, i in every.items():
            names[i] = t.encode() + b" "
            self.there[i] = True
        self.name_sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def word(self, word: str) -> bytes:
        """Ids of a word in the pre-tokenizer's alphabet, as little-endian 32-bit numbers."""
        m = self.merges
        return np.array(m.encode(word[:-1] + chr(ord(word[-1]) + FINAL) if m.suffix else word), "<u4").tobytes()

    def ordinary(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.words_of.pre_tokenize_str(text) if w] if self.words_of else [text] if text else []

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """A text cut at added tokens, leftmost and of those the longest first: (ordinary text, None) or ('', id)."""
        start = 0
        if self.added:
            for end, mark in self.marks.iter_long(text):
                if end + 1 - len(mark) > start:
                    yield text[start : end + 1 - len(mark)], None
                yield "", self.added[mark]
                start = end + 1
        if start < len(text):
            yield text[start:], None

    def text(self, text: str) -> bytes:
        out = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
            else:
                words = self.ordinary(part)
                for i in range(0, len(words), 1 << 16):
                    out += map(self.cache.learn(words[i : i + (1 << 16)]).__getitem__, words[i : i + (1 << 16)])
        return b"".join(out)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without special tokens; one of a-z is a word as it is."""
        return [self.word(x) if x.isascii() and x.isalpha() and x.islower() else b"".join(map(self.word, self.ordinary(x))) for x in pieces]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        if not self.by_pieces:
            return [self.text(x) for x in texts.to_pylist()]
        flat, at = data(texts)
        simple = plain(flat, at)
        if simple.all():
            ids, sizes, wrong = self.table.ids(flat, at)
            ids = ids.astype("<u4", copy=False)
            ends = np.cumsum(sizes)
            out = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            for i in wrong.tolist():
                out[i] = self.text(texts[i].as_py())
            return out
        easy = texts.filter(pa.array(simple))
        done = iter(self.encode(easy) if len(easy) else [])
        return [next(done) if s else self.text(texts[i].as_py()) for i, s in enumerate(simple.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, special ones among them; ids that the vocabulary hasn't are left out."""
        ids = ids[ids < len(self.there)]
        ids = ids[self.there[ids]]
        out = []
        for i in range(0, len(ids), 1 << 18):  # an index takes eight bytes for each byte of text
            part = ids[i : i + (1 << 18)]
            sizes = self.name_sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.names[np.repeat(self.name_starts[part] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


_coders: dict[str, BytePairs] = {}


def coder(path: str) -> BytePairs:
    found = _coders.get(path)
    if found is None:
        found = _coders[path] = BytePairs(path)
    return found


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs`` its key and ``ids``: the text's token ids as little-endian 32-bit numbers, one after the other.

    A null text counts as empty and has no ids; null and repeated keys are kept, one output row for each input row; a text of any length
    is encoded whole; other columns are ignored; no rows give no rows. Nothing is shuffled. ``tokenizer`` is a file of the
    tokenizers library that every executor can open; truncation and padding in it are not applied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(tokenizer)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(made.encode(b.column("text")), pa.binary())], ["key", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokenizer: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """For each row its key, its ids and ``text``: what they decode to. Null ids count as none; no ids decode to an empty text; ids beyond the vocabulary are left out; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(tokenizer)
        for b in slices(batches, "ids"):
            texts = [made.decode(np.frombuffer(x.as_py(), "<u4")) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ids"), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "ids", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "key long, ids binary, text string").withColumnRenamed("key", key).withColumnRenamed("ids", ids)


def round_trip(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of what ``encode`` and ``decode`` give: key, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, tokenizer, key=key, text=text), tokenizer, key=key)
    return both.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
