"""Repairs against a plain search over all edits, whole and cut into runs."""

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from tallgrass.llm import conversations as module
from tallgrass.llm.conversations import CHART, Repair, best_end, charts, damage, repaired_conversations, steps

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, at string, copies int, fault string"


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """The cheapest repair by Dijkstra's algorithm over (rows read, last role, system seen), with whole audits and texts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = first_faults(rows)
    todo = [(0, "", 0, "start", ())]
    while todo:
        cost, audit, i, state, out = heapq.heappop(todo)
        if i == len(rows) and state in ("start", "a"):
            break
        # what may come next in each state, and the state after it
        follow = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        for x, after in follow.items():
            if x != "s":
                heapq.heappush(todo, (cost + 3, audit + "I", i, after, (*out, f"{module.ROLES[x]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for x, after in follow.items():
                    if role[:1] == x:
                        heapq.heappush(todo, (cost + more, audit + "K", i + 1, after, (*out, f"{role}:{text}")))
                    if x != "s":
                        heapq.heappush(todo, (cost + more + 3, audit + "R", i + 1, after, (*out, f"{module.ROLES[x]}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), list(out)


def grouped(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        out[c].append((t, r, x))
    return out


def some(rng, conv, n):
    texts = ["Yes.", "No!", "cut off", "", " ", None, "Why?", "Yes.", "é. \n", "tail .x"]
    return [(conv, rng.choice([i, i, i, i // 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]), rng.choice(texts) if rng.random() < 0.5 else f"t{i}.", "z", 7, "q") for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = Random(8)
    out = [r for c in range(150) for r in some(rng, c, rng.randrange(1, 8))] + some(rng, None, 6)
    out += [(900, 1, "user", "same.", "z", 7, "q")] * 3 + [(901, None, None, None, "z", 7, "q")] * 2 + [(902, -5, "user", "Hi.", "z", 7, "q"), (902, 2**40, "assistant", "Ho.", "z", 7, "q")]
    return out


@pytest.mark.parametrize("run", [4096, 2])
def test_reports(spark, rows, run, monkeypatch):
    """Whole, and cut into runs of two rows."""
    monkeypatch.setattr(module, "RUN", run)
    pack = module._pack
    if run == 2:  # functions by value, so that workers see the length

        def cut(batches, at=pack.__code__, names=pack.__globals__):
            from types import FunctionType

            return FunctionType(at, {**names, "RUN": 2})(batches)

        monkeypatch.setattr(module, "_pack", cut)
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    repair = Repair(made)
    if run == 2:
        assert repair.runs.count() > 250
    got = {r.conv_id: tuple(r)[1:] for r in repair.report().collect()}
    want = {c: plain(x) for c, x in grouped(rows).items()}
    assert len(got) == len(want)
    for c, x in want.items():
        assert got[c] == x[:8], (c, grouped(rows)[c], got[c], x)
    turns = defaultdict(list)
    for r in sorted(repair.turns().collect(), key=lambda r: (r["at"], r.place)):
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: x for c, x in turns.items() if x} == {c: x[8] for c, x in want.items() if x[8]}


def test_damage_and_conversations_without_rows(spark):
    rng, rows = Random(3), []
    for c in [*range(60), None]:
        rows += [(c, t, ["user", "assistant"][t % 2], f"Text {rng.randrange(9)}. More! Cut") for t in range(rng.randrange(1, 4))]
    rows += [(c, None, None, None) for c in range(70, 100)]
    left = defaultdict(list)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x
        left[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: plain(x)[:8] if x else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, x in {**{c: [] for c, *_ in rows}, **left}.items()}
    assert any(not x for x in left.values()) or len(left) < len(want)
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: tuple(r)[1:] for r in repaired_conversations(made).collect()} == want
    assert repaired_conversations(made.limit(0)).count() == 0 and Repair(damage(made.limit(0))).turns().count() == 0


def test_a_long_conversation(spark):
    """One conversation of 20,000 turns and a turn that is repeated 5,000 times: the repair is that of one chart."""
    rng = Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", "", "!"])) for i in range(20_000)]
    rows += [(1, 777, "user", "again and again.")] * 5000 + [(2, i, ["user", "assistant"][i % 2], f"t{i}.") for i in range(4)]
    repair = Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in repair.report().collect()}
    assert repair.runs.where("conv_id = 1").count() >= 5 and got[2].audit == "KKKK"
    one = got[1]
    assert one.duplicate == 4999 and len(one.audit.replace("I", "")) == 25_000 and one.gaps == 0
    ordered = sorted({r for r in rows if r[0] == 1}, key=lambda r: (r[1], r[2], r[3]))
    classes = np.array([2 * "sua".index(r[2][0]) + (r[3][-1] not in ".!?") for r in ordered])
    cost, rank, back = charts(classes, np.array([0, len(classes)]))
    q = best_end(cost[0, 0], rank[0, 0])
    edits = [e[0] for e in steps(classes, back, 0, q)]
    edits[next(k for k, r in enumerate(ordered) if r[3].startswith("again"))] += "D" * 4999
    assert one.audit == "".join(edits) + "I" * len(CHART.ends[q][1]) and one.cost == cost[0, 0, q] + CHART.ends[q][0] + 4 * 4999
