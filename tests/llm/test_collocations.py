"""Phrases against plain counting, and what the sketch lets through."""

import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from tallgrass.llm import collocations as module
from tallgrass.llm.collocations import Batch, collocations, phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und"][tuple(w[i : i + size])] += 1
    return f, n


def plain(rows, longest=3, least=10, covers=50, most=2000):
    f, n = counted(rows, longest)
    out = []
    for lang, counts in f.items():
        every = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in every.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            over = [b for q, b in every.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covers * a for b in over):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = Random(9)
    common = [f"w{i}" for i in range(12)] + ["É", "é", "New", "york", "\x00", "\x1c", "a　b", "x" * 200]
    out = [(None, "en"), ("", "de"), (" \t\n", None), ("one", "fr"), ("New York City. new york city! NEW\tYORK  city\r" * 8, None), ("new york\n" * 30, "und"), ("a b. c", "en")]
    for _ in range(120):
        out.append(("".join(rng.choice(common) + rng.choice(["  ", " ", " ", "\t", ". ", ", ", "\n"]) for _ in range(rng.randrange(200))), rng.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("size", [{}, {"longest": 4, "least": 3, "covers": 80}, {"longest": 2, "most": 5}, {"least": 300}])
def test_against_plain_counting(spark, rows, size):
    made = spark.createDataFrame([(t, x, 1, "z", "q") for t, x in rows], "text string, lang string, a int, phrase string, n string").repartition(3)
    assert Counter(tuple(r) for r in collocations(made, **size).collect()) == plain(rows, **size)


def test_a_full_sketch_changes_nothing(spark):
    """With far more phrases than counters most that are rare seem frequent; exact counts decide."""
    rng = Random(6)
    rows = [(" ".join(f"w{rng.randrange(20_000)}" for _ in range(30_000)) + " often seen" * 3, lang) for lang in ("en", "en", "de", None)]
    got, totals = phrase_counts(spark.createDataFrame(rows, "text string, lang string"), least=4, counters=1 << 16)
    f, n = counted(rows, 3)
    assert {(r.lang, r.phrase): r.a for r in got.collect()} == {(x, " ".join(p)): a for x, c in f.items() for p, a in c.items() if a >= 4}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_words_whose_hashes_are_equal(monkeypatch):
    """Bytes decide which words are equal."""
    real = module.span_hashes
    monkeypatch.setattr(module, "span_hashes", lambda raw, a, b, seed=0: real(raw, a, b, seed) % np.uint64(3 if seed < 4 else 2**63))
    made = Batch(pa.array([b"one two three one two four five six", b"one"], pa.large_binary()), pa.array(["en", "de"]))
    words = made.words()
    pairs = made.longer(words, words)
    assert sorted(zip(made.phrase(words, np.arange(len(words.first))), words.counts.tolist(), strict=True)) == [(b"five", 1), (b"four", 1), (b"one", 1), (b"one", 2), (b"six", 1), (b"three", 1), (b"two", 2)]
    assert dict(zip(made.phrase(pairs, np.arange(len(pairs.first))), pairs.counts.tolist(), strict=True))[b"one two"] == 2


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(module, "AT_ONCE", 1000)
    rng = Random(4)
    text = "".join(rng.choice(["a", "b", "c", "é"]) + rng.choice([" ", " ", " ", "."]) for _ in range(5000))
    assert [x.to_pybytes() for x in module.cut(pa.py_buffer(b"x" * 5000))] == [b"x" * 5000]
    parts = [x.to_pybytes() for x in module.cut(pa.py_buffer(text.encode()))]
    assert b"".join(parts) == text.encode() and len(parts) > 5 and all(p.endswith(b".") for p in parts[:-1])
    made = [b for b in module._batches(iter([pa.RecordBatch.from_pydict({"text": [text, ""], "lang": ["en", "en"]})]))]
    assert sum(len(b.begin) for b in made) == len(re.findall(r"[^ .]+", text))


def test_no_rows(spark, none):
    assert collocations(none).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    """2,000,000 * 2,000,000 * 10^6 doesn't fit a long."""
    text = "x y. " * 500_000
    rows = [(text, "en")] * 4
    got = [tuple(r) for r in collocations(spark.createDataFrame(rows, "text string, lang string")).collect()]
    assert got == [("en", 1, "x y", 2_000_000, 2_000_000, 2_000_000, 4_000_000, 1_000_000)]
