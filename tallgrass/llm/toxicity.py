"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are hashed words and word beginnings, each with its share of the text's words. One weight vector
serves all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). The output is
the expected grade.

Labels say only toxic or not. Grades are graded by the labelled texts themselves: words that are much commoner in toxic texts than
in others form a lexicon, and toxic texts are cut into three grades by the share of their words in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Scratch, data, slices, span_hashes, spans, utf8

BITS = 18
#: Bytes of word beginnings that are features beside the whole word.
HEADS = (5, 7)
GRADES = 4
#: Shares are fitted as hundredths.
SCALE = 100.0


def features(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, features) of feature numbers of each word of the texts, and where each text's words start."""
    flat, at = data(values)
    flat = np.frombuffer(flat.tobytes().translate(ALNUM), np.uint8)
    starts, ends = spans(flat, at)
    out = np.empty((len(starts), 1 + len(HEADS)), np.uint32)
    for k, most in enumerate((1 << 30, *HEADS)):
        hashes = span_hashes(flat, starts, np.minimum(ends, starts + most)) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        out[:, k] = (hashes >> np.uint64(7)).astype(np.uint32) & np.uint32((1 << BITS) - 1)
    return out, np.searchsorted(starts, at)


@dataclass
class Ordinal:
    """weights: one for each feature; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(texts, grades - 1) probabilities of a grade over 0, over 1, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


@dataclass
class Sample:
    """Texts as rows of sparse features: row starts, feature numbers, shares; labels and folds."""

    starts: np.ndarray
    index: np.ndarray
    share: np.ndarray
    toxic: np.ndarray

    def blocks(self, most: int = 1 << 19) -> Iterator[tuple[slice, slice]]:
        """Rows, and where their features are, a bounded number of features at a time (a longer row is one block)."""
        first = 0
        while first < len(self.toxic):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, side="right")) - 1)
            yield slice(first, last), slice(int(self.starts[first]), int(self.starts[last]))
            first = last

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.sums(lambda at: w[self.index[at]] * self.share[at])

    def sums(self, of: Callable[[slice], np.ndarray]) -> np.ndarray:
        """For each row the sum of what ``of`` says of its features."""
        out = np.zeros(len(self.toxic))
        for rows, at in self.blocks():
            total = np.concatenate([[0.0], np.cumsum(of(at), dtype=np.float64)])
            ends = self.starts[rows.start : rows.stop + 1] - at.start
            out[rows] = total[ends[1:]] - total[ends[:-1]]
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold each feature, among toxic ones and among others."""
        out = np.zeros((2, 1 << BITS), np.int64)
        for rows, at in self.blocks():
            toxic = np.repeat(self.toxic[rows] == 1, np.diff(self.starts[rows.start : rows.stop + 1]))
            for k in (0, 1):
                out[k] += np.bincount(self.index[at][toxic == (k == 0)], minlength=1 << BITS)
        return out[0], out[1]


def grades(s: Sample) -> np.ndarray:
    """0 for other texts; 1 to 3 for toxic ones by their share of words that toxic texts use much more."""
    hot = s.toxic == 1
    inside, outside = s.counts()
    odds = (inside + 0.1) / max(1, hot.sum()) / ((outside + 0.1) / max(1, (~hot).sum()))
    load = s.dot(((odds > 8) & (inside >= 3)).astype(float))
    out = np.zeros(len(hot), np.int64)
    if hot.any():
        cuts = np.quantile(load[hot], [1 / 3, 2 / 3])
        out[hot] = 1 + (load[hot] > cuts[0]) + (load[hot] > cuts[1])
    return out


def telling(s: Sample, least: int = 3, sure: float = 4.0) -> np.ndarray:
    """Features of at least ``least`` texts whose presence says toxic or not: a log odds ratio of over ``sure`` standard errors."""
    hot = s.toxic == 1
    a, b = (n + 0.5 for n in s.counts())
    c, d = hot.sum() + 1 - a, (~hot).sum() + 1 - b
    z = (np.log(a / c) - np.log(b / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return (np.abs(z) > sure) & (a + b >= least + 1)


def fit(s: Sample, y: np.ndarray, *, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Ordinal:
    """Maximum likelihood with an L2 penalty over the telling features, by Adam over the whole sample.

    Toxic texts weigh as much as all others together. The thresholds are a first one and gaps that stay positive.
    """
    chosen = telling(s)
    kept = s.sums(lambda at: chosen[s.index[at]]).astype(np.int64)
    held = [(s.index[at][k], s.share[at][k]) for _, at in s.blocks() for k in [chosen[s.index[at]]]]
    every, share = (np.concatenate(x) if x else np.zeros(0, np.float32) for x in (list(c) for c in zip(*held, strict=True)))
    names, index = np.unique(every, return_inverse=True)
    small = Sample(np.concatenate([[0], np.cumsum(kept)]), index, share * SCALE, s.toxic)
    rows = np.repeat(np.arange(len(y)), np.diff(small.starts))
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean()) / len(y)
    x = np.concatenate([np.zeros(len(names)), [1.0, 0.5, 0.5]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, theta = x[: len(names)], x[len(names) :]
        gaps = np.exp(theta[1:])
        cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(gaps)])
        scores = small.dot(w)
        a = np.where(y < GRADES - 1, _sigmoid(cuts[np.minimum(y, GRADES - 2)] - scores), 1.0)
        b = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - scores), 0.0)
        p = np.maximum(a - b, 1e-9)
        da, db = weight * a * (1 - a) / p, weight * b * (1 - b) / p
        to_cut = np.array([(db * (y == k + 1)).sum() - (da * (y == k)).sum() for k in range(GRADES - 1)])
        g = np.concatenate([np.bincount(small.index, (da - db)[rows] * small.share, len(names)) + decay * w, [to_cut.sum()], [to_cut[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[names] = x[: len(names)] * SCALE
    theta = x[len(names) :]
    return Ordinal(full, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, most_features: int, *, text: str = "text", key: str = "doc_id") -> Sample:
    """Features of at most ``most`` labelled texts, those whose keys have the smallest hashes, and of these as many as have
    ``most_features`` features together. Both are cut on executors; only the sample comes to the driver."""
    wanted = labels.where("toxic is not null").select(F.col(key).cast("long").alias("key"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("key is not null")
    wanted = wanted.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key", F.lit(5)), "key").limit(most)
    rows = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text")).join(F.broadcast(wanted), "key")
    # of a key's texts the least one, however many there are
    rows = rows.groupBy("key", "toxic").agg(F.min("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found, bounds = features(b.column("text"))
            index, share = [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                f, n = np.unique(found[i:j], return_counts=True)
                index.append(f.astype(np.uint32).tobytes())
                share.append((n / max(1, j - i)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("toxic"), pa.array(index, pa.binary()), pa.array(share, pa.binary())], ["key", "toxic", "index", "share"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    made = scratch.put(rows.mapInArrow(sparse, "key long, toxic int, index binary, share binary").withColumn("draw", F.xxhash64("key", F.lit(5))))
    before = F.sum(F.octet_length("index") / 4).over(Window.orderBy("draw", "key"))
    last = made.select("draw", "key", "index").select("draw", "key", before.alias("held")).where(F.col("held") <= most_features).agg(F.max(F.struct("draw", "key")).alias("last")).first()["last"]
    if last is not None:
        made = made.where((F.col("draw") < last["draw"]) | (F.col("draw") == last["draw"]) & (F.col("key") <= last["key"]))
    got = (made if last is not None else made.limit(0)).drop("draw").orderBy("key").toArrow()
    # the columns' bytes are the arrays: nothing is copied
    (index, at), (share, _) = (data(got[c].combine_chunks()) if got.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64)) for c in ("index", "share"))
    return Sample(at // 4, index.view(np.uint32), share.view(np.float32), np.array(got["toxic"].to_pylist(), np.int64))


def train(docs: DataFrame, labels: DataFrame, *, most: int = 10_000, most_features: int = 6_000_000, text: str = "text", key: str = "doc_id") -> Ordinal:
    """The model of a bounded sample: at most ``most`` labelled texts with ``most_features`` features together.

    Labels that are null, or of a null key or one without a text, count for nothing; of a key's labels the greatest holds, of its texts the
    least. Null and empty texts have no features; a text of any length counts by the shares of its words. Without toxic texts
    in the sample, or without others, the model finds none.
    """
    s = labelled_sample(docs, labels, most, most_features, text=text, key=key)
    if not (s.toxic == 1).any() or not (s.toxic == 0).any():
        return Ordinal(np.zeros(1 << BITS, np.float32), np.array([30.0, 31.0, 32.0]))
    return fit(s, grades(s))


def severity(docs: DataFrame, model: Ordinal, *, cut: float = 0.5, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row: key, expected_severity (0 to 3), p_toxic, grade and toxic (p_toxic >= cut), and the columns of ``keep``.

    A null or empty text, or one without words, has severity 0. Null and repeated keys are kept, one output row for each
    input row; other columns are ignored; no rows give no rows. What is sent to tasks is the model, 1 MB whatever the data.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Ordinal(*sent.value)
        for b in slices(batches, "utf8"):
            found, bounds = features(b.column("utf8"))
            total = np.concatenate([[0.0], np.cumsum(learned.weights[found].sum(axis=1, dtype=np.float64))])
            n = np.diff(bounds)
            over = learned.above((total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1))
            over[n == 0] = 0
            whole = np.concatenate([np.ones((len(n), 1)), over, np.zeros((len(n), 1))], axis=1)
            grade = np.argmax(whole[:, :-1] - whole[:, 1:], axis=1)
            made = [pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(grade.astype(np.int32)), pa.array(over[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays([b.column("key"), *made, *(b.column(f"keep_{c}") for c in keep)], ["key", "expected_severity", "p_toxic", "grade", "toxic", *(f"keep_{c}" for c in keep)])

    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    rows = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("utf8"), *kept)
    kinds = dict(docs.dtypes)
    schema = "key long, expected_severity double, p_toxic double, grade int, toxic boolean" + "".join(f", `keep_{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(score, schema).select(F.col("key").alias(key), "expected_severity", "p_toxic", "grade", "toxic", *[F.col(f"keep_{c}").alias(c) for c in keep])
