"""Token counts of whole texts with a public tokenizer.

Texts are split at boundaries that no token crosses: a single space between two visible
characters. Pieces are encoded in batches of equal bytes, each distinct piece once per worker as long as a
bounded cache holds it, and only lengths leave the library.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import PieceCache

#: Characters beside a space at which a split isn't surely safe: what some definition of white
#: space holds, controls and format characters.
UNSURE = frozenset(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]))


class Lengths:
    """Token counts of texts; a process keeps one for each tokenizer file."""

    def __init__(self, path: str, batch_bytes: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = PieceCache(self.after_space)
        self.batch_bytes = batch_bytes

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths straight from the library, in batches of about ``batch_bytes``."""
        out: list[int] = []
        start = held = 0
        for i, x in enumerate(texts):
            held += len(x) if x.isascii() else len(x.encode())
            if held >= self.batch_bytes or i + 1 == len(texts):
                out += map(len, self.library.encode_batch_fast(texts[start : i + 1], add_special_tokens=False))
                start, held = i + 1, 0
        return out

    def after_space(self, pieces: list[str]) -> list[int | None]:
        """Lengths of pieces that follow a space; None beside which a split isn't surely safe."""
        sure = [x for x in pieces if x and x[0] not in UNSURE and x[-1] not in UNSURE]
        known = dict(zip(sure, self.encoded([" " + x for x in sure]), strict=True))
        return [known.get(x) for x in pieces]

    def __call__(self, texts: list[str]) -> list[int]:
        split = [x.split(" ") for x in texts]
        get = self.cache.learn(itertools.chain.from_iterable(x[1:] for x in split)).get
        # the first piece has no space before it
        firsts = self.encoded([x[0] for x in split])
        out: list[int] = []
        for x, first, text in zip(split, firsts, texts, strict=True):
            counts = list(map(get, x[1:]))
            if None not in counts and (len(x) == 1 or x[0] and x[0][-1] not in UNSURE):
                out.append(first + sum(counts))
            else:
                out.append(sum(self.encoded(safe_pieces(text, self.batch_bytes))))
        return out


def safe_pieces(text: str, size: int) -> list[str]:
    """Cuts a text into pieces of about ``size`` characters, at safe boundaries only."""
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at != -1 and (at + 1 >= len(text) or text[at - 1] in UNSURE or text[at + 1] in UNSURE):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


_lengths: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Returns key, n_bytes, n_tokens and over_limit for each row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); a null or repeated key is kept as it is, one
    output row for each input row; other columns are ignored; no rows give no rows. A text of any
    length is encoded whole, in pieces between which no token reaches. ``tokenizer`` is a file for
    the tokenizers library that every executor can open; nothing of it is shipped.

    The pieces are those of byte-level BPE with the usual pre-splitting: a space
    belongs to the word after it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths.get(tokenizer) or _lengths.setdefault(tokenizer, Lengths(tokenizer))
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), pa.array(lengths(b.column("text").to_pylist()), pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "key long, n_bytes long, n_tokens long").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
