"""Scores, detections, near passages and pipeline stages against plain versions."""

import re
from collections import Counter, defaultdict
from random import Random

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest
from tallgrass.llm.licenses import BASE, license_scan, rules
from tallgrass.llm.mixing import mix
from tallgrass.llm.substring_dedup import repeated_passages
from tallgrass.llm.toxicity import BITS, SCALE, Ordinal, Sample, features, fit, grades, severity, telling, train

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_scan(text):
    low = (text or "").translate(LOWER)
    w = words(text)
    places = sorted((i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    every = [(m.start(), m.end(), label, priority) for label, priority, _, regex in rules() for m in regex.finditer(low) if m.end() > m.start()]
    taken = []
    for d in sorted(every, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        if not any(t[0] <= d[0] and d[1] <= t[1] for t in taken):
            taken.append(d)
    base = {label for _, label in places}
    score = max([d[3] for d in taken] + [6] * bool(places), default=0) / 9
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {d[2] for d in taken})), score, sorted(taken)


def test_license_scan_against_all_rules(spark, odd):
    rng = Random(3)
    parts = [
        "GNU General Public License, version 3", "the MIT License", "Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "CC BY 4.0", "cc by-sa 3.0", "Permission is hereby granted, free of charge", "All rights reserved.", "public domain",
        "Redistribution and use in source and binary forms", "GNU Lesser General Public License v2.1", "Mozilla Public License 2.0", "the", "software", "license", "\n", "BSD 3-Clause", "as is", "WITHOUT WARRANTY",
    ]
    texts = [x for _, x, *_ in odd] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(60)]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        found = [(d.start, d.end, d.label, d.priority) for d in r.detections]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, found) == plain_scan(texts[r.doc_id])
    assert sum(len(r.detections) for r in got) > 200


def toxic_sample(n=400):
    rng, texts, toxic = Random(4), [], []
    for i in range(n):
        t = [f"calm{rng.randrange(200)}" for _ in range(rng.randrange(10, 80))]
        if i % 4 == 0:
            t += rng.choices(["scoundrel", "vermin", "dunderhead"], k=1 + i % 9)
        texts.append(" ".join(t))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def as_sample(texts, toxic):
    index, share, starts = [], [], [0]
    for t in texts:
        f, n = np.unique(features(pa.array([t.encode()], pa.binary()))[0], return_counts=True)
        index += f.tolist()
        share += (n / len(t.split())).tolist()
        starts.append(len(index))
    return Sample(np.array(starts), np.array(index, np.uint32), np.array(share, np.float32), np.array(toxic))


def test_severity_is_the_models_own(spark, odd):
    """Scores word by word from the model's weights; equal texts of other rows change nothing."""
    texts, toxic = toxic_sample()
    s = as_sample(texts, toxic)
    model = fit(s, grades(s))
    every = [x for _, x, *_ in odd] + texts[:50]
    for r in severity(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), model).collect():
        w = words(every[r.doc_id])
        score = sum(float(model.weights[features(pa.array([x.encode()], pa.binary()))[0]].sum()) for x in w) / max(1, len(w))
        over = [1 / (1 + np.exp(min(40, max(-40, t - score)))) if w else 0.0 for t in model.thresholds]
        assert abs(r.expected_severity - sum(over)) < 1e-4 and abs(r.p_toxic - over[0]) < 1e-4
        each = [a - b for a, b in zip([1, *over], [*over, 0], strict=True)]
        assert r.toxic == (r.p_toxic >= 0.5) and each[r.grade] >= max(each) - 1e-4


def test_fit_is_the_most_likely():
    """The penalised likelihood, computed plainly, doesn't grow in any of many directions from the fitted model."""
    texts, toxic = toxic_sample()
    s = as_sample(texts, toxic)
    y = grades(s)
    model = fit(s, y, steps=1500, rate=0.03)
    chosen = np.flatnonzero(telling(s))

    def loss(weights, cuts):
        scores = s.dot(weights) * SCALE
        p = np.diff(np.concatenate([np.zeros((len(y), 1)), 1 / (1 + np.exp(-(cuts[None, :] - scores[:, None]))), np.ones((len(y), 1))], axis=1), axis=1)[np.arange(len(y)), y]
        weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean()) / len(y)
        return -(weight * np.log(np.maximum(p, 1e-12))).sum() + 1e-3 / 2 * (weights**2).sum()

    w = model.weights.astype(float) / SCALE
    assert set(np.flatnonzero(w)) <= set(chosen) and len(chosen) < 1 << BITS
    best, rng = loss(w, model.thresholds), np.random.default_rng(1)
    for _ in range(200):
        step = np.zeros_like(w)
        step[chosen] = rng.normal(0, 0.05, len(chosen))
        assert loss(w + step, model.thresholds + rng.normal(0, 0.02, 3)) > best - 1e-4


def test_a_model_of_labels_that_disagree(spark):
    rows = [(1, "calm words"), (1, "other words"), (None, "vermin"), (2, "vermin vermin"), (3, None)]
    labels = [(1, 0), (1, 1), (2, None), (None, 1), (9, 1), (3, 0)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert isinstance(model, Ordinal) and (np.diff(model.thresholds) > 0).all()


def test_near_passages_are_found(spark):
    """Recall on passages of 70 words of which two apart differ, at similarities of 0.8 or a little more; in every other case an earlier text quotes a piece."""
    rng, made, n = Random(11), [], 150
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    for k in range(n):
        one = fresh(80)
        other = list(one)
        other[15 + rng.randrange(10)] = "changed"
        other[50 + rng.randrange(10)] = "changed too"
        piece = one[30:52] if k % 2 else []
        for t, part in enumerate((piece, one, other)):
            made.append((3 * k + t, " ".join(fresh(60) + part + fresh(60))))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(2)).collect()}
    found = [k for k in range(n) if 3 * k + 1 in got and 3 * k + 2 in got and got[3 * k + 2].class_id == 3 * k + 1]
    assert len(found) >= 0.9 * n and not any(i % 3 == 0 for i in got)
    print("near passages found", len(found), "of", n)


@pytest.mark.parametrize("pieces", [2, 3, 6])
def test_near_passages_that_an_earlier_text_quotes_in_pieces(spark, pieces):
    """80 words of which one or two apart differ; an earlier text holds all of them in overlapping pieces of 44 words."""
    rng, made, n = Random(11), [], 60
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    for k in range(n):
        one = fresh(80)
        other = list(one)
        other[15 + rng.randrange(10)] = "changed"
        if k % 2:
            other[50 + rng.randrange(10)] = "changed too"
        starts = [round(i * 36 / (pieces - 1)) for i in range(pieces)]
        quoted = [w for at in starts for w in one[at : at + 44] + fresh(30)]
        for t, part in enumerate((quoted, one, other)):
            made.append((3 * k + t, " ".join(fresh(60) + part + fresh(60))))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(2)).collect()}
    found = [k for k in range(n) if 3 * k + 1 in got and 3 * k + 2 in got and got[3 * k + 1].class_id == got[3 * k + 2].class_id]
    assert len(found) >= 0.97 * n


def test_near_passages_among_texts_that_quote_pieces_or_have_links(spark):
    """Two texts with near passages amid an earlier and a later one that quote all of it in pieces; and one near a passage that is linked with a third it isn't near to."""
    rng, made, n = Random(13), [], 40
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    for k in range(n):
        one = fresh(80)
        other = list(one)
        other[38 + rng.randrange(4)] = "changed"
        starts = (0, 18, 36)
        quoted = [[w for at in starts for w in one[at : at + 44] + fresh(30)] for _ in range(2)]
        for t, part in enumerate((quoted[0], one, other, quoted[1])):
            made.append((10 * k + t, " ".join(fresh(60) + part + fresh(60))))
        base = fresh(90)
        near = list(base)
        near[22], near[66] = "x", "y"  # two changes of 90 words
        far = near[:64]
        far[44] = "z"  # of 64 words one differs from the second and two from the first
        for t, part in enumerate((base, near, far, far[:44])):
            made.append((10 * k + 5 + t, " ".join(fresh(60) + part + fresh(60))))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(2)).collect()}
    found = [k for k in range(n) if 10 * k + 1 in got and 10 * k + 2 in got and got[10 * k + 1].class_id == got[10 * k + 2].class_id]
    linked = [k for k in range(n) if 10 * k + 7 in got and got[10 * k + 7].class_id == 10 * k + 5]
    print("near passages found", len(found), "and", len(linked), "of", n)
    assert len(found) >= 0.97 * n and len(linked) >= 0.97 * n


def test_near_passages_of_a_key_that_many_texts_have(spark):
    """90 texts quote 44 words, too few for a link; pairs amid them share 8 words before those too, the last of them changed. Neither the smallest nor the greatest text is like any."""
    rng = Random(23)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    quote, before = some(44), {i: some(7) for i in range(20, 30)}
    made = [(i, " ".join([*some(60), *before.get(i, before.get(i - 30, [])), *some(1), *quote, *some(60)])) for i in range(90)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(2)).collect()}
    assert {i: got[i].class_id for i in got} == {i + n: i for i in before for n in (0, 30)}
    assert all(r.n_repeated_words == 52 for r in got.values())


def test_a_passage_beyond_the_reach_of_a_window(spark):
    """A text of 70,000 words, its copy in a longer one with a word changed here and there, and a text with nothing of it."""
    rng = Random(12)
    long = [f"w{rng.randrange(10**9)}" for _ in range(70_000)]
    other = [f"x{i}" if i % 997 == 500 else w for i, w in enumerate(long)]
    texts = [(1, " ".join(long)), (2, " ".join(["before"] * 3 + other + ["after"])), (3, " ".join(f"y{i}" for i in range(300)))]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()}
    assert set(got) == {1, 2} and got[2].class_id == 1 and got[1].n_repeated_words == 70_000


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, x, lang, s, n) for i, x, lang, s, n, *_ in odd] + [(2, "another text under a dropped key", "en", "s1", 1), (40, "so wait vermin vermin", "en", None, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 15)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, rows[12][1]), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages_on_odd_rows(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    wide = docs.selectExpr("*", "1 as row", "2 as copies", "3 as toxic", "4 as `group`")
    stages = dict(pipeline.STAGES)
    key = lambda r: tuple(r)

    calm = severity(docs, train(docs, spark.read.parquet(f"{at}/labels.parquet")), keep=pipeline.COLUMNS[1:]).where("not toxic").select(*pipeline.COLUMNS)
    assert Counter(map(key, stages["toxicity"](spark, wide, at).collect())) == Counter(map(key, calm.collect()))

    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(r[1])) else frozenset() for r in rows]
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b) and up[i] != up[j]:
                up = [up[j] if v == up[i] else v for v in up]
    groups = defaultdict(list)
    for r, g, s in zip(rows, up, sets, strict=True):
        groups[(g, None) if s else (id(r), 1)].append(r)
    got = Counter(map(key, stages["near_dedup"](spark, wide, at).collect()))
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min(m[0] is None and float("inf") or m[0] for m in members)
        assert sum(got[m] for m in set(members) if (m[0] is None and float("inf") or m[0]) == least) >= 1

    hit = tuple(words(rows[12][1]))
    wins = {hit[k : k + 10] for k in range(max(1, len(hit) - 9))}
    size = min(10, len(hit))
    clean = [r for r in rows if not any(tuple(w[k : k + size]) in wins for w in [words(r[1])] for k in range(len(w) - size + 1))]
    assert Counter(map(key, stages["decontamination"](spark, wide, at).collect())) == Counter(clean)

    taken = Counter()
    for r in mix(docs, extra=("text",)).collect():
        taken[(r.doc_id, r.text)] += r.copies
    mixed = stages["mixing"](spark, wide, at).collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == +taken and {key(r) for r in mixed} <= set(rows)

    out = sorted(stages["token_output"](spark, wide, at).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]


def test_stages_of_no_rows(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
