"""Each operator against a brute-force version on odd rows, and on no rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tallgrass.llm import simple8b
from tallgrass.llm.components import components
from tallgrass.llm.common import ALNUM, Scratch, equal_spans, span_hashes
from tallgrass.llm.decontaminate import Machine, contaminated
from tallgrass.llm.exact_dedup import exact_dedup
from tallgrass.llm.licenses import detections, license_scan, rules
from tallgrass.llm.minhash_dedup import band_keys, least_matches, near_dedup, shingle_sets, signatures, similar
from tallgrass.llm.mixing import mix
from tallgrass.llm.substring_dedup import Texts, agreed, aligned, compact_windows, near_keys, passages, repeated_passages, told
from tallgrass.llm.suffix_dedup import repeated_bytes
from tallgrass.llm.token_counts import Lengths, token_counts
from tallgrass.llm.token_output import Ids, read_tokens, tokens_written_and_read, write_tokens
from tallgrass.llm.toxicity import severity, train

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def words(text, regex=LETTERS):
    return regex.findall((text or "").translate(LOWER))


def test_exact_dedup(docs, odd, none):
    groups = defaultdict(list)
    for i, x, *_ in odd:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            want[(i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert rows(exact_dedup(docs)) == want
    assert rows(exact_dedup(docs, first=4, widen=2)) == want
    assert exact_dedup(none).count() == 0


def test_decontamination(spark, docs, odd, none):
    items = [(1, "nothing here at all"), (2, odd[0][1][300:700]), (3, None), (4, "one TWO"), (None, odd[0][1]), (5, "!!"), (2, "one two"), (10, odd[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, x in items:
        w = words(x)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                wins[tuple(w[k : k + 10])].add(str(i))
    want = Counter()
    for i, x, *_ in odd:
        w, hit, of = words(x), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    of |= found
        want[(i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit))] += 1
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(contaminated(docs, bench).select(columns)) == want
    assert rows(contaminated(docs, bench, part_words=200).select(columns)) == want
    found = contaminated(docs, bench, keep=("text",)).where("doc_id = 9").first()
    assert [found["text"].encode()[s["start"] : s["end"]] for s in found["spans"]] == [b"one two"]
    assert contaminated(none, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def test_each_text_is_read_once_whatever_the_parts(spark, odd):
    rng = Random(3)
    items = [(i, " ".join(f"i{rng.randrange(500)}" for _ in range(30))) for i in range(40)]
    texts = [(k, items[k % 40][1] if k % 3 else x) for k, (_, x, *_) in enumerate(odd * 10)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2).mapInArrow(counted, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = rows(contaminated(docs, bench, part_words=300).drop("spans", "items"))
    assert read.value == len(texts)
    assert found == rows(contaminated(docs, bench).drop("spans", "items"))


def test_items_of_one_template():
    """Ten thousand items share their rarest words and differ beyond a window of them; a hit takes a few look-ups and tells the right items."""
    import time

    def took(n):
        items = [(str(i), f"before{i} once upon a time there was a very small question about thing{i} and more".encode()) for i in range(n)]
        machine = Machine(items, 10)
        text = b"so before7 once upon a time there was a very small question about thing7 and so on ".split() * 200
        start = time.time()
        hits, of = machine.scan(text)
        return time.time() - start, hits, of

    _, hits, of = took(20)
    assert of == set(range(20)) and hits == sorted(hits) and len(hits) == 200
    assert all(b - a == 14 for a, b in hits)
    assert took(10_000)[0] < 20 * took(100)[0] + 1


def thue_morse(n: int, flip: bool = False) -> str:
    """Letters on which any polynomial modulo a power of two agrees with its complement."""
    return "".join("ab"[(i.bit_count() + flip) & 1] for i in range(n))


def test_hashes_and_equality_of_spans():
    for n in (8, 64, 128, 1024, 2048, 4096):
        raw = np.frombuffer((thue_morse(n) + thue_morse(n, True) + thue_morse(n)).encode(), np.uint8)
        starts = np.array([0, n, 2 * n])
        hashes = span_hashes(raw, starts, starts + n)
        assert hashes[0] == hashes[2] != hashes[1] and span_hashes(raw, starts, starts + n, 1)[0] != hashes[0]
        assert equal_spans(raw, starts, raw, starts[[2, 2, 0]], np.full(3, n)).tolist() == [True, False, True]
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 2, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 20000)
    ends = starts + rng.integers(0, 14, 20000)
    by_bytes = {}
    for h, a, b in zip(span_hashes(raw, starts, ends).tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert by_bytes.setdefault(raw[a:b].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)
    other = rng.integers(0, 3800, 20000)
    same = equal_spans(raw, starts, raw, other, ends - starts)
    assert same.tolist() == [raw[a:b].tobytes() == raw[c : c + b - a].tobytes() for a, b, c in zip(starts, ends, other, strict=True)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_letters_in_patterns_are_no_copies(spark, n):
    """One-word texts that polynomial hashes take for each other: near copies, tokens, passages, repeated bytes."""
    import random

    from tokenizers import Tokenizer

    one, other = thue_morse(n), thue_morse(n, True)
    made = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string").coalesce(1)
    for size, letters in ((4, False), (5, True)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(made, size=size, letters_only=letters).collect()}
        assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {k: zlib.crc32(np.array([*library.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, x in ((1, one), (2, other), (3, one))}
    assert {r.doc_id: r.ids_crc32 for r in tokens_written_and_read(made, path).collect()} == want
    # a passage around it is the only thing that two texts share
    rng = random.Random(4)
    fresh = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    texts = [(k, " ".join([fresh(30), *([x] * 60), fresh(30)])) for k, x in ((1, one), (2, other))]
    assert repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).count() == 0
    # blocks of 128 letters and their complements, between letters that occur once
    parts = [thue_morse(128, f) + thue_morse(128, not f) for f in (False, True)]
    texts = [(k, fresh(6) + x + fresh(6)) for k, x in enumerate(parts)] + [(2, fresh(9) + parts[0] + fresh(4))]
    check_repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), texts)


def test_a_hash_that_two_pieces_share_gives_each_its_own_ids(monkeypatch):
    """With one hash for all long pieces ids still are the library's."""
    import pyarrow as pa
    from tallgrass.llm import piece_table

    monkeypatch.setattr(piece_table, "span_hashes", lambda flat, a, b: np.zeros(len(a), np.uint64))
    texts = ["anythingatall whatsoever small", "whatsoever anythingatall", "small words", "somethingelse"]
    ids = Ids(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        got = ids(pa.array(texts))
        assert [g.tolist() for g in got] == [ids.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_of_odd_letters_and_marks():
    import pyarrow as pa

    rng = Random(12)
    letters = ["a", "b", "s", "t", "re", "ll", "'", "'", ".", ",", "$", "-", "1", "22", "\u00b2", "\u00d7", "\u00f7", "\u00a3", "\u00a0", "\x1c", "\x00", "\u00e9", "\u00c9", "\u00df", "\u00aa", "\t", "\n", "\r", " ", " ", "<", "|", "I", "\u0130", "e\u0301", "\u4f60", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters[: 30 if k % 3 else None]) for _ in range(rng.randrange(60))) for k in range(4000)]
    ids = Ids(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.by_words
    for i in range(0, len(texts), 500):
        for x, got in zip(texts[i : i + 500], ids(pa.array(texts[i : i + 500])), strict=True):
            assert got.tolist() == ids.library.encode(x, add_special_tokens=False).ids, x


def test_machine_against_windows():
    """Random items of few different words: all that windows cover, whatever keys stand for them; and what an automaton holds."""
    rng = Random(7)
    for kinds, size in ((2, 10), (4, 10), (30, 10), (3, 3), (5, 6)):
        for _ in range(60):
            items = [(str(i), " ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30, 60]))).encode()) for i in range(6)]
            text = [f"w{rng.randrange(kinds + 1)}".encode() for _ in range(150)]
            for _, x in items:
                if x and rng.random() < 0.5:
                    at = rng.randrange(100)
                    text[at : at + 25] = x.split()[rng.randrange(3) :][:25]
            hit, of = set(), set()
            for i, (_, x) in enumerate(items):
                w = x.split()
                for k in range(max(0, min(1, len(w)), len(w) - size + 1)):
                    win = w[k : k + size]
                    for at in range(len(text) - len(win) + 1):
                        if text[at : at + len(win)] == win:
                            hit |= set(range(at, at + len(win)))
                            of.add(i)
            ranges, found = Machine(items, size).scan(text)
            assert {k for a, b in ranges for k in range(a, b)} == hit and found == of
    body = " ".join(f"w{rng.randrange(50_000)}" for _ in range(100_000)).encode()
    stats = Machine([("1", body)], 10).machine.get_stats()
    assert stats["nodes_count"] < 6 * 100_000 and stats["total_size"] < 40 * len(body)


@pytest.mark.parametrize("size,letters", [(4, False), (5, True)])
def test_near_dedup(docs, odd, none, size, letters):
    sets = []
    for _, x, *_ in odd:
        w = words(x, LETTERS if letters else SOLID)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(odd)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (k, *_) in enumerate(odd):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    want = Counter()
    for i, (k, *_) in enumerate(odd):
        c = least.get(top(i)) if sets[i] else k
        want[(k, len(sets[i]), c, k == c)] += 1
    for block in (2048, 2):
        assert rows(near_dedup(docs, size=size, letters_only=letters, block=block)) == want
    assert near_dedup(none).count() == 0


def test_near_dedup_finds_links_among_many_versions(spark):
    """Versions of one text, each some words away from the one before: links across what a single hub joins."""
    import random

    rng = Random(3)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    made = []
    for i in range(60):
        text = list(text)
        for _ in range(2):
            text[rng.randrange(300)] = f"v{rng.randrange(5000)}"
        made.append((i, " ".join(text)))
    sets = [{tuple(x.split()[k : k + 4]) for k in range(297)} for _, x in made]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    want = {i: min(j for j in range(60) if up[j] == up[i]) for i in range(60)}
    got = near_dedup(spark.createDataFrame(made, "doc_id long, text string"), size=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_dedup_among_pages_of_one_template(spark):
    """Pages at a similarity of about 0.6 share buckets without being linked; split buckets still join those that are, and send fewer rows than blocks would."""
    rng = Random(8)
    template = [f"t{i}" for i in range(150)]
    made = []
    for i in range(1200):
        own = [f"p{i}x{k}" for k in range(45)]
        made.append(template + own if i % 4 else template + made[-1][150:-1] + ["end"] if i else template + own)
    texts = [(i, " ".join(x)) for i, x in enumerate(made)]
    sets = [{tuple(x[k : k + 4]) for k in range(len(x) - 3)} for x in made]
    assert 0.5 < len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.75
    up = list(range(len(made)))
    for i in range(4, len(made), 4):
        assert 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])
        up[i] = up[i - 1]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for block, wide in ((16, 2), (512, 16)):
        assert {r.doc_id: r.component_id for r in near_dedup(frame, size=4, block=block, wide=wide).collect()} == dict(enumerate(up))


def test_near_dedup_joins_pairs_that_share_one_band_of_a_wide_bucket(spark):
    """Every pair that shares a band and is similar enough is joined, however many blocks its bucket fills and however few bands it shares."""
    rng = Random(21)
    made = []
    for _ in range(40):
        template = [f"t{rng.randrange(10**6)}" for _ in range(24)]
        made += [[f"x{rng.randrange(10**6)}" if rng.random() < 0.12 else w for w in template] for _ in range(12)]
    sets = [np.unique(s) for s in shingle_sets(pa.array([" ".join(x).encode() for x in made], pa.binary()), 1, ALNUM)]
    keys = band_keys(signatures(sets))
    up = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and up[i] != up[j] and similar(sets[i], sets[j], 65):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    want = {i: min(j for j in range(len(made)) if up[j] == up[i]) for i in range(len(made))}
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(made)], "doc_id long, text string")
    got = near_dedup(frame, size=1, percent=65, miss=0.0, block=1, wide=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(80, 1e-4)
    assert least == sorted(least) and least[-1] < 0.8 * 125


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(7, 7), (50, 60), (60, 55)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 55: 50, 60: 50}
    assert components(links.limit(0), Scratch(spark, "t")).count() == 0


def check_repeated_bytes(docs, texts):
    raws = [(i, (x or "").encode()) for i, x, *_ in texts]
    seen = Counter(r[p : p + 200] for _, r in raws for p in range(len(r) - 199))
    want = Counter()
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = True
        gone = gone[:-1]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        want[(i, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    assert rows(repeated_bytes(docs)) == want


def test_repeated_bytes(docs, odd, none):
    check_repeated_bytes(docs, odd)
    kept = repeated_bytes(docs, texts=True).where("doc_id = 14").first()
    assert kept["n_removed"] == 900 and bytes(kept["kept_text"]) == b""
    assert repeated_bytes(none).count() == 0


def test_repeated_bytes_of_many_versions(spark, monkeypatch):
    """5000 versions of one text with a byte changed: what is found has no more rows than a few for each phrase, none for each start."""
    rng = Random(17)
    base = [rng.choice("abcdefgh") for _ in range(260)]
    texts = []
    for k in range(5000):
        made = list(base)
        made[rng.randrange(260)] = chr(33 + k % 60) + str(k)
        texts.append((k, "".join(made)))
    put, made = Scratch.put, []

    def seen(self, df):
        out = put(self, df)
        if "w1" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", seen)
    check_repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string").coalesce(4), texts)
    assert made[0] <= 4 * len(texts)


def test_repeated_bytes_of_common_triggers(spark, monkeypatch):
    """Parts of one or two phrases, and every trigger salted; letters that are zero bytes, and many versions of one text."""
    from tallgrass.llm import suffix_dedup

    rng = Random(12)
    base = [rng.choice(("a", "b", "\x00")) for _ in range(900)]
    texts = []
    for k in range(24):
        made = list(base)
        for _ in range(rng.randrange(4)):
            made[rng.randrange(900)] = rng.choice(("c", "\x00", "d"))
        texts.append((k, "".join(made[rng.randrange(300) :])))
    texts += [(30, "\x00" * 450), (31, "x" + "\x00" * 230), (32, "a\x00" * 150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    check_repeated_bytes(df, texts)
    for part in (1, 2):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        monkeypatch.setattr(suffix_dedup, "HOT", 10**9)
        check_repeated_bytes(df, texts)


def test_compact_windows_cover_each_passage_once():
    rng = np.random.default_rng(1)
    for n, width in ((30, 5), (64, 8), (7, 7), (6, 7)):
        h = rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
        seen = Counter()
        for left, c, right in compact_windows(h, width):
            assert right - left + 1 >= width and h[left : right + 1].min() == h[c]
            for i in range(left, c + 1):
                for j in range(max(c, i + width - 1), right + 1):
                    seen[(i, j)] += 1
        assert seen == Counter({(i, j): 1 for i in range(n) for j in range(i + width - 1, n)})


def test_windows_never_leave_a_text():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 8):
        for sizes in ([30], [8, 9, 5, 40, 8], [1, 2, 3], [8] * 5, []):
            sets = [rng.integers(0, 2**64, k, dtype=np.uint64) for k in sizes]
            texts, want = Texts(sets, width), set()
            for i, h in enumerate(sets):
                for c in range(len(h)):
                    left, right = c, c
                    while left and h[left - 1] > h[c]:
                        left -= 1
                    while right + 1 < len(h) and h[right + 1] > h[c]:
                        right += 1
                    if right - left + 1 >= width:
                        want.add((i, left, c, right))
            found = zip(*(x.tolist() for x in texts.windows(texts.shingles)), strict=True)
            got = {(int(texts.of[c]), *(x - int(texts.begins[texts.of[c]]) for x in (left, c, right))) for left, c, right in found}
            assert got == want


def test_repeated_passages(docs, odd, none):
    where = defaultdict(set)
    for k, (_, x, *_) in enumerate(odd):
        w = words(x)
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].add(k)
    exact = {odd[k][0] for ks in where.values() if len(ks) > 1 for k in ks}
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert exact <= set(got) and set(got) <= exact | {3}
    assert got[12].class_id == got[13].class_id == 12 and got[12].n_passages == 1
    assert 80 <= got[12].n_repeated_words <= 84
    assert repeated_passages(none).count() == 0


def test_passages_of_few_different_shingles_end():
    rng = np.random.default_rng(9)
    for kinds in (3, 8, 30, 90):
        for _ in range(200):
            a, b = (rng.integers(0, kinds, rng.integers(5, 120), dtype=np.uint64) for _ in range(2))
            for x, y, s, t in passages(a, b, 6, 80, 3):
                one, other = set(a[x : y + 1].tolist()), set(b[s : t + 1].tolist())
                assert y - x + 1 >= 6 and 100 * len(one & other) >= 80 * len(one | other)


def test_each_document_has_a_class(docs, odd, none):
    got = repeated_passages(docs, every=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd)
    found = {r.doc_id for r in repeated_passages(docs).collect()}
    assert all((r.class_id, r.n_representative_links, r.n_passages, r.n_repeated_words) == (r.doc_id, 0, 0, 0) for r in got if r.doc_id not in found)
    assert repeated_passages(none, every=True).count() == 0


def test_passages_that_an_earlier_text_quotes_in_part(spark):
    rng, made = Random(6), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(60):
        passage = fresh(50)
        for t, part in enumerate((passage[: (40, 45, 49)[k % 3]], passage, passage)):
            made.append((3 * k + t, " ".join(fresh(40) + part + fresh(40))))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: (r.class_id, r.n_passages, r.n_repeated_words) for i, r in got.items()} == {3 * k + t: (3 * k + 1, 1, 50) for k in range(60) for t in (1, 2)}


def test_every_place_and_the_whole_of_a_passage(spark):
    rng = Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    short, more = fresh(60), fresh(60)
    texts = [fresh(30) + short + fresh(90) + short + fresh(70) + short, *(fresh(20 + i) + short + more + fresh(60) for i in range(12)), fresh(10) + short + fresh(10)]
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            seen[tuple(t[p : p + 50])].add((i, p))
    want = defaultdict(set)
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                want[i] |= set(range(p, p + 50))
    made = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: r.n_repeated_words for i, r in got.items()} == {i: len(w) for i, w in want.items()}
    assert got[0].n_passages == 3 and {r.class_id for r in got.values()} == {0}


def test_near_passages_with_one_wide_gap():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**64, 96, dtype=np.uint64)
    other = one.copy()
    other[43:53] = rng.integers(0, 2**64, 10, dtype=np.uint64)
    # 86 of 106 shingles in common, between words that have nothing in common
    a, b = (np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), x, rng.integers(0, 2**64, n, dtype=np.uint64)]) for n, x in ((30, one), (50, other)))
    assert aligned(a, b, 20, 46, 80, 9) == passages(a, b, 46, 80, 9) == [(30, 125, 50, 145)]
    far = np.concatenate([a[:76], rng.integers(0, 2**64, 40, dtype=np.uint64), a[76:]])
    assert aligned(a, far, 0, 46, 80, 9) == [(0, 75, 0, 75)] and aligned(a, far, 40, 46, 80, 9) == [(76, 155, 116, 195)]
    assert sorted(passages(a, far, 46, 80, 9)) == [(0, 75, 0, 75), (76, 155, 116, 195)]


def test_two_values_agree_whatever_they_are(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, (1000, 2), dtype=np.int64).tolist()
    made = spark.createDataFrame([(i, v) for i, pair in enumerate(values) for v in pair] + [(1000, 5), (1000, 5)], "i int, v long")
    for need, want in ((1, 1001), (2, 1000), (3, 0)):
        assert made.groupBy("i").agg(agreed("v", need).alias("agreed")).where("agreed").count() == want


def test_token_counts(docs, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Lengths(path).library
    want = Counter()
    for i, x, *_ in odd:
        n = len(library.encode(x or "", add_special_tokens=False))
        want[(i, len((x or "").encode()), n, n > 512)] += 1
    assert rows(token_counts(docs, path)) == want
    assert token_counts(none, path).count() == 0


def test_tokens_written_and_read(spark, docs, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = [(i, [*library.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, *_ in odd]
    want, start = {}, 0
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens_written_and_read(docs, path).collect())
    for at, key, n, crc in got:
        assert at == start
        start += n
        want.setdefault(key, []).append((n, crc))
    assert Counter((k, n, c) for k, v in want.items() for n, c in v) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    keys = [k for _, k, _, _ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    write_tokens(docs, path, f"{tmp_path}/tokens")
    whole = {tuple(r.ids) for r in read_tokens(spark, f"{tmp_path}/tokens", ids=True).collect()}
    assert whole == {tuple(x) for _, x in ids}
    assert tokens_written_and_read(none, path).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for high in (2, 60, 50_000, 2**40, 2**63):
        for n in (0, 1, 7, 1023, 1024, 1025, 4000):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            if n > 6:
                ids[[2, n - 1]] = 2**64 - 1
            packed, first = simple8b.pack(ids)
            assert (simple8b.unpack(packed, first, n) == ids).all()
            if n > 2000:  # a block alone
                block = packed[first[1] : first[2]]
                assert (simple8b.unpack(block, np.array([0, len(block)], np.uint32), 1024) == ids[1024:2048]).all()
    with pytest.raises(ValueError):
        simple8b.read_chunk(b"x" * 64)


def test_mix(docs, odd, none):
    from tallgrass.llm.mixing import WEIGHTS

    size = lambda x: len(SOLID.findall(x or ""))
    totals = Counter()
    for _, x, _, s, *_ in odd:
        totals[s] += size(x)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(totals.values()) - sum(3 * totals[s] for s in full)
        share = rest / sum(weight[s] for s in order if s not in full)
        target = {s: 3 * totals[s] if s in full else weight[s] * share for s in order}
        if not (more := {s for s in order if s not in full and target[s] > 3 * totals[s]}):
            break
        full |= more
    got = mix(docs, extra=("source",)).collect()
    assert len(got) == len(odd)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5), extra=("source",)).collect()))
    assert mix(none).count() == 0
    assert mix(docs.withColumn("text", docs["lang"].substr(0, 0))).where("target <> 0 or taken <> 0").count() == 0


def test_license_scan(spark, docs, none):
    texts = [
        (1, "Under the GNU General Public License, and the MIT license; mit licenses no. the MIT\nLicense"), (2, None), (3, ""), (4, "cc BY-SA 4.0"), (5, "SPDX-License-Identifier: Apache-2.0"),
        (6, "Licensed under the Apache License, Version 2.0. http://www.apache.org/licenses/LICENSE-2.0"), (7, "x " * 50_000 + "the mit license"), (7, "clean words"),
    ]
    got = {(r.doc_id, r.n_words): r for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(rules()) >= 200
    one = got[(1, 17)] if (1, 17) in got else next(r for r in got.values() if r.doc_id == 1)
    assert (one.n_base, one.first_word, one.last_word, one.base_labels) == (3, 2, 14, "gpl,mit")
    assert got[(2, 0)].first_word is None and got[(3, 0)].labels == "" and got[(3, 0)].score == 0
    assert next(r for r in got.values() if r.doc_id == 4).labels == "cc-by,cc-by-sa"
    assert next(r for r in got.values() if r.doc_id == 5).score == 1
    assert next(r for r in got.values() if r.doc_id == 6).labels == "apache,apache-2.0"
    assert got[(7, 50_003)].n_base == 1 and got[(7, 2)].score == 0
    # a looser rule inside a stricter one's place says nothing
    assert [d[2] for d in detections("the gnu general public license, version 3")] == ["gpl-3.0"]
    assert license_scan(docs).count() == docs.count() and license_scan(none).count() == 0


def test_toxicity_on_held_out_texts(spark, docs, none):
    import random

    rng = Random(2)
    calm, rude = [f"calm{i}" for i in range(300)], ["scoundrelly", "scoundrelish", "dunderhead", "dunderheaded", "vermin"]
    made = []
    for i in range(900):
        text = [rng.choice(calm) for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[rng.randrange(len(text))] = rng.choice(rude)
        made.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    labels = table.where("doc_id < 600").select("doc_id", "toxic")
    model = train(table.drop("toxic"), labels)
    assert (np.diff(model.thresholds) > 0).all()
    held = severity(table, model, keep=("toxic",)).toDF("doc_id", "severity", "p", "grade", "found", "toxic").where("doc_id >= 600").toPandas()
    hit = (held.found & (held.toxic == 1)).sum()
    assert hit >= 0.9 * (held.toxic == 1).sum() and (held.found & (held.toxic == 0)).sum() <= 2
    odd_rows = severity(docs, model)
    assert odd_rows.count() == docs.count() and odd_rows.where("doc_id in (4, 5, 6)").where("expected_severity <> 0 or toxic").count() == 0
    assert severity(none, model).count() == 0
    assert not severity(table, train(table.limit(0), labels)).where("toxic").count()


def test_what_tells_parts_apart():
    rng = np.random.default_rng(8)
    for _ in range(30):
        known = rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64)
        s, width = known[rng.integers(0, len(known), 300)], int(rng.integers(1, 47))
        at = rng.integers(0, 300 - width + 1, 20)
        size = np.array([int(rng.integers(width, 300 - a + 1)) for a in at])
        for a, n, distinct, fewest, bits in zip(at, size, *told(s, at, size, width), strict=True):
            part, held = s[a : a + n].tolist(), [0] * 4
            assert distinct == len(set(part)) and fewest == min(len(set(part[i : i + width])) for i in range(n - width + 1))
            for x in part:
                held[x >> 6 & 3] |= 1 << (x & 63)
            assert bits.tolist() == held
    assert [len(x) for x in told(s[:0], at[:0], size[:0], 5)] == [0, 0, 0]


def test_near_keys_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sets = [rng.integers(0, 2**63, int(n), dtype=np.uint64)[rng.integers(0, max(1, n // 2), n)] for n in rng.integers(1, 90, 8)]
        keys, places = near_keys(sets)
        begins = np.cumsum([0, *map(len, sets)])
        each = [(k, p + begin) for s, begin in zip(sets, begins.tolist(), strict=False) for k, p in zip(*(x.tolist() for x in near_keys([s])), strict=True)]
        assert sorted(zip(keys.tolist(), places.tolist(), strict=True)) == sorted(each)


def test_parts_that_cannot_be_alike_are_not_read(spark, monkeypatch):
    """Texts that say few words over and over meet each other at very many places; parts of them go on to verification only where they may be alike."""
    rng, read, put = Random(15), [], Scratch.put

    def counted(self, df):
        out = put(self, df)
        if dict(df.dtypes).get("part") == "binary":
            read.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    near = [*passage[:30], "changed", *passage[31:]]
    junk = [[rng.choice(["so", "so", "so", "so", "wait"]) for _ in range(400)] for _ in range(12)]
    made = [" ".join(x) for x in (fresh(40) + passage + fresh(40), fresh(70) + near + fresh(20), *junk, *(["so"] * n for n in (300, 310, 320)))]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(2)).collect()}
    assert got[0].class_id == got[1].class_id == 0 and got[0].n_passages == 1 and {got[i].class_id for i in (14, 15, 16)} == {14}
    assert sum(read) < 600, read
