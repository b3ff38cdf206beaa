"""What the operators of this folder share: tables, scratch space and byte-level word splitting."""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch tables -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) a temporary folder is taken and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallgrass-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    Each ``put`` writes a table and reads it again, so a lost executor costs the tasks that were
    running and never the steps before them. ``drop`` frees a table that no later step reads. What is left is
    removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame, small: bool = False) -> None:
        """Frees tables, and the shuffle files of steps that are done: Spark removes those when the driver's garbage is collected. Nothing is collected for ``small`` tables."""
        for t in tables:
            self._delete(t._scratch_path)
        if not small:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception as e:  # the JVM may be gone by now; the folder is temporary anyway
            if self.spark.sparkContext._jsc is not None and "Connection" not in str(e):
                raise

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words as bytes -------------------------------------------------------------------------

#: Bytes of words of class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased. Every byte
#: of a character beyond ASCII is 0x80 or more, so the classes hold for bytes of UTF-8 too.
_LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
ALNUM = bytes(_LETTERS[b + 32] if 0x41 <= b <= 0x5A else _LETTERS[b] for b in range(256))
#: Bytes of words of class [^\x20\x09-\x0D] after A-Z are lower-cased.
SOLID = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def utf8(column: str = "text") -> Column:
    """A text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def words(raw: bytes, classes: bytes = ALNUM) -> list[bytes]:
    """Words of one text; ``classes`` maps every byte outside words to a space."""
    out = raw.translate(classes)
    # a NUL or another control byte is part of SOLID words, so only the space may split
    return out.split() if classes is ALNUM else [w for w in out.split(b" ") if w]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 3 << 18) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes; one longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets(batch.column(column)))
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a string or binary array starts in its data, and where the last ends."""
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind, len(values) + 1, values.offset * np.dtype(kind).itemsize).astype(np.int64)


def data(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and its offsets from 0."""
    at = offsets(values)
    held = values.buffers()[2]
    return (np.frombuffer(held, np.uint8, at[-1] - at[0], at[0]) if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def spans(raw: np.ndarray, at: np.ndarray, classes: bytes = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in concatenated texts; none crosses from one text into the next."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = raw != 0x20
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a finaliser of xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


#: Spans beyond this many bytes are hashed and compared one by one, by C code; the others eight bytes a round, all at once.
LONG = 128
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = raw
    return np.ndarray((len(raw) + 1,), np.uint64, padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Each eight bytes are mixed in by a bijection that is no polynomial, so equally
    long spans of up to eight bytes never collide and no pattern of letters makes longer ones do."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _ODD + np.uint64(seed * 2 + 1))
    words, at, on = eights(raw), starts, None
    for k in range(0, min(int(sizes.max(initial=0)), LONG), 8):
        if k:
            on = np.flatnonzero((sizes > k) & (sizes <= LONG)) if k == 8 else on[sizes[on] > k]
            out[on] = mix(out[on] * _ODD ^ words[starts[on] + k] & _MASKS[np.minimum(sizes[on] - k, 8)])
        else:
            out = mix(out ^ words[at] & _MASKS[np.minimum(sizes, 8)])
    if len(far := np.flatnonzero(sizes > LONG)):
        held, key = memoryview(np.ascontiguousarray(raw)), seed.to_bytes(8, "little")
        whole = [hashlib.blake2b(held[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
        out[far] = np.frombuffer(b"".join(whole), np.uint64)
    return out


def equal_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes of ``a`` from a_at on are those of ``b`` from b_at on, byte by byte."""
    out = np.ones(len(sizes), bool)
    if not len(sizes):
        return out
    x, y = eights(a), eights(b)
    on = np.flatnonzero(sizes <= LONG)
    for k in range(0, min(int(sizes.max()), LONG), 8):
        on = on[sizes[on] > k]
        out[on] &= (x[a_at[on] + k] ^ y[b_at[on] + k]) & _MASKS[np.minimum(sizes[on] - k, 8)] == 0
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = np.array_equal(a[a_at[i] : a_at[i] + sizes[i]], b[b_at[i] : b_at[i] + sizes[i]])
    return out
