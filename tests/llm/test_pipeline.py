"""Each stage of the pipeline against a brute-force version on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from tallgrass.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    steps = {}
    for name, stage in pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, SF))
        steps[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == list(pipeline.COLUMNS)
            assert all(before[r.doc_id] == r for r in steps[name])

    # near copies: one of each group stays, by all pairs of the stage's input
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = {}
    for r in steps["toxicity"]:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and up[i] != up[j]:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if v == old else v for k, v in up.items()}
    assert {r.doc_id for r in steps["near_dedup"]} == {i for i in ids if up[i] == i}

    items = [word.findall((r.text or "").lower()) for r in table(spark, SF, "benchmark").collect()]
    wins = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    clean = set()
    for r in steps["near_dedup"]:
        w = word.findall((r.text or "").lower())
        if not any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in steps["decontamination"]} == clean

    copies = Counter(r.doc_id for r in steps["mixing"])
    assert set(copies) <= clean and max(copies.values()) <= 3
    out = steps["token_output"]
    assert Counter(r.doc_id for r in out) == copies
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_run_is_the_stages(spark):
    assert pipeline.run(spark, SF).count() > 0 and len(pipeline.STAGES) == 5
