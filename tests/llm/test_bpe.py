"""Ids and decoded texts against the tokenizers library, and the encoder against plain merging."""

import hashlib
import json
from collections import Counter
from random import Random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tallgrass.llm.bpe import BytePairs, Merges, decode, encode, round_trip
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "<|endoftext|>", "a<|startoftext|><|endoftext|> b <|ENDOFTEXT|>", "ΣΑΣ İ é é 你好", "it's I'LL we'Ve 12 345", " 　x\x1cy\x00", "a" * 5000, "ab" * 3000 + "</w>", "</w> a</w>",
    "\U0001f600" * 300, "Straße­ ÀÉ×÷", "<|", "ﬁ ǅ ﷺ", " ", "\n\t",
]


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH), Tokenizer.from_file(PATH)


def test_texts_as_the_library_has_them(pairs):
    made, library = pairs
    rng, tokens = Random(1), [t.replace("</w>", "") for t in pairs[1].get_vocab(with_added_tokens=False)]
    texts = list(ODD)
    for _ in range(2000):
        texts.append("".join(rng.choice("abcdefghinorstu") for _ in range(rng.randrange(1, 40))))
        texts.append("".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))))
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(rng.randrange(1, 60))))
    for text, got in zip(texts, made.encode(pa.array(texts)), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert made.decode(np.frombuffer(got, "<u4")).decode() == library.decode(want, skip_special_tokens=False)


def merged(word, vocabulary, merges):
    """Plain merging: of the lowest rank, of those the leftmost, until none is left."""
    ranks, parts = {tuple(m): k for k, m in enumerate(merges)}, list(word)
    while True:
        best = min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return [vocabulary[p] for p in parts]
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


def test_any_merges():
    """Random small vocabularies, whose merges overlap more than a real one's, some tokens unreachable."""
    rng = Random(2)
    for _ in range(300):
        vocabulary, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rng.randrange(1, 25)):
            a, b = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append([a, b])
        made = Merges(vocabulary, merges, None, most=7)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            assert made.encode(word) == merged(word, vocabulary, merges)
        assert made.encode("xaxbx") == merged("ab", vocabulary, merges) and made.encode("x") == []


def test_time_grows_with_the_length(pairs):
    """A word of a million letters: the encoder leaves each place a bounded number of times."""
    made, _ = pairs
    word = "ab" * 250_000
    assert len(np.frombuffer(made.text(word), "<u4")) == len(np.frombuffer(made.text(word[:1000]), "<u4")) * 500


def test_refused_models(tmp_path):
    model = json.loads(Tokenizer.from_file(PATH).to_str())
    for change in ({"dropout": 0.1}, {"ignore_merges": True}):
        at = tmp_path / "t.json"
        at.write_text(json.dumps({**model, "model": {**model["model"], **change}}))
        with pytest.raises(ValueError):
            BytePairs(str(at))


def test_round_trip(spark, docs, odd, none, pairs):
    _, library = pairs
    want = Counter()
    for i, x, *_ in odd:
        ids = library.encode(x or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in round_trip(docs, PATH).collect()) == want
    assert round_trip(none, PATH).count() == 0
    long = spark.createDataFrame([(1, "some words <|endoftext|> é 你 " * 60_000), (2, None)], "doc_id long, text string")
    for r in encode(long, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == (library.encode("some words <|endoftext|> é 你 " * 60_000, add_special_tokens=False).ids if r.doc_id == 1 else [])
    given = spark.createDataFrame([(1, None), (2, b""), (3, np.array([320, 1 << 20, 49407], "<u4").tobytes())], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in decode(given, PATH).collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}
