"""Token ids of texts, written in key order as Simple-8b chunks and read back.

The file format is in ``simple8b``. Chunks are rows of a Parquet table (shard, before, n_ids, data), so any store that
Spark reaches holds them, Spark's commit protocol guards them, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, data, partitions, slices
from .piece_table import PieceTable, plain
from .simple8b import read_chunk, write_chunk

CHUNK_IDS = 1 << 18
#: The word pattern of the public CLIP tokenizer, a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: before: ids of the shard's chunks before this one.
CHUNKS = "shard int, before long, n_ids long, data binary"


class Ids:
    """Ids of texts as little-endian 32-bit numbers.

    For a word tokenizer of the pattern ``WORDS`` texts are cut at white space and before marks, which no word crosses, and each
    distinct piece is encoded once as long as a bounded table holds it. A text that is all Latin-1 and without
    what may begin a special token is lower-cased first, which changes nothing for a tokenizer that lower-cases by
    character; other texts, and all texts of other tokenizers, go to the library whole. Pieces of letters go to the
    library by thousands in one text, where the tokens that end a word tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.table = PieceTable(self.encoded)
        made = json.loads(self.library.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and patterns[:1] == [WORDS] and made["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def singly(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(pieces), 4096) for e in self.library.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Words each of which is one word to the library."""
        out: list[bytes] = []
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[np.minimum(ids, len(self.closes) - 1)]) + 1) * 4
            if len(ends) != len(part):  # not so simple after all
                out += self.singly(part)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[start:end])
                start = end
        return out

    def encoded(self, pieces: list[str]) -> list[bytes]:
        simple = [x.isalpha() and (x.isascii() or max(x) < "\u0250" and "\u0130" not in x) for x in pieces]
        if all(simple):
            return self.together(pieces)
        easy = iter(self.together([x for x, s in zip(pieces, simple, strict=True) if s]))
        other = iter(self.singly([x for x, s in zip(pieces, simple, strict=True) if not s]))
        return [next(easy) if s else next(other) for s in simple]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(x, "<u4") for x in self.singly(texts.to_pylist())]
        flat, at = data(texts)
        simple = plain(flat, at)
        if simple.all():
            ids, sizes, wrong = self.table.ids(flat, at)
            out = np.split(ids, np.cumsum(sizes)[:-1])
            for i in wrong.tolist():
                out[i] = np.frombuffer(self.singly([texts[i].as_py()])[0], "<u4")
            return out
        easy = texts.filter(pa.array(simple))
        done = iter(self(easy) if len(easy) else [])
        hard = iter(self.singly(texts.filter(pa.array(~simple)).to_pylist()))
        return [next(done) if x else np.frombuffer(next(hard), "<u4") for x in simple.tolist()]


_ids: dict[str, Ids] = {}


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end: int | None = 1, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every text, appends ``end`` and writes chunks under ``path`` in ascending key order.

    A null text counts as empty, a null key comes first; rows that share a key stay in the order of their texts'
    hashes. Other columns are ignored; no rows write no chunks. Shards are ranges of keys,
    so a shard grows only with the rows that share one key.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids.get(tokenizer) or _ids.setdefault(tokenizer, Ids(tokenizer))
        shard = TaskContext.get().partitionId()
        tail = np.array([] if end is None else [end], "<u4")
        keys, lengths, held, size, before = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            made = write_chunk(keys, lengths, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before]), pa.array([size]), pa.array([made], pa.binary())], ["shard", "before", "n_ids", "data"])

        for b in slices(batches, "text", 2 << 20):
            for k, ids in zip(b.column("key").to_pylist(), ids_of(b.column("text")), strict=True):
                held += [ids, tail]
                n = len(ids) + len(tail)
                keys.append(k)
                lengths.append(n)
                size += n
                if size >= CHUNK_IDS:
                    yield out()
                    keys, lengths, held, size, before = [], [], [], 0, before + size
        if keys:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key", F.xxhash64("text"))
    rows.mapInArrow(encode, CHUNKS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, *, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """For each document: key, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids.

    Each chunk says how many ids of its shard are before it; only the sums of shards, one row for each partition
    of the writer, come to the driver and are sent to all tasks.
    """
    files = spark.read.schema(CHUNKS).parquet(path)
    sizes = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for s in sorted(sizes):
        starts.append((s, total))
        total += sizes[s]
    base = spark.createDataFrame(starts, "shard int, base long")
    placed = files.select("shard", "before", "data").join(F.broadcast(base), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                keys, lengths, values = read_chunk(raw.as_py())
                ends = np.cumsum(lengths)
                plain = values.astype("<u4")
                view = memoryview(plain).cast("B")
                begins = ends - lengths
                crcs = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(start + begins), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return placed.select((F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(decode, schema)


def tokens_written_and_read(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what ``read_tokens`` finds there."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'token-output').root}/chunks"
    write_tokens(docs, tokenizer, path, key=key, text=text)
    return read_tokens(spark, path, key=key)
