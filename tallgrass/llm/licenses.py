"""License scans by ordered signature rules.

One Aho-Corasick pass finds the rules' keywords; a rule's regex runs only where its keyword is. Detections are
taken in the order of priority, then length, place and label; one that lies inside a detection taken before is suppressed.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, words
from .license_rules import RULES_TEXT

#: Phrases whose places are counted, word by word, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = r"[\s\"'`,;:*#/()<>-]+"
#: Longest keyword first: a line's keyword may have blanks, so it is looked up here.
KEYWORDS = """
as is basis|activities|source and binary|above copyright|permission to use|permission is hereby|buy me a beer|perl itself|x consortium|apache software foundation|all rights reserved
public domain mark|public domain|public license|creative commons|remote network|free documentation|general public|library general|lesser general|except in compliance
substantial portions|dealings in the|advertising materials|source code form|common development|common public|european union|open database|open data commons|community data
academic free|open software|educational community|universal permissive|microsoft public|microsoft reciprocal|q public|server side|business source|change date|commons clause
altered source|reserved font|end user|it and/or
""".replace("\n", "|").strip("|").split("|")


def _spaced(regex: str) -> str:
    """The regex with its blanks as white space and marks; a blank in a class is just that."""
    return regex.replace("[ -]", r"[\x20-]").replace(" ?", f"(?:{_BLANK})?").replace(" ", _BLANK)


@functools.cache
def rules() -> list[tuple[str, int, str, re.Pattern]]:
    """(label, priority, keyword, regex) of each rule, in their order."""
    out, label = [], ""
    for line in RULES_TEXT.strip().splitlines():
        head, _, rest = line.partition(" ")
        if head == "=":
            label = rest
            continue
        keyword = next((k for k in KEYWORDS if rest.startswith(k + " ")), None)
        # two words can be a keyword and the regex's first word too
        keyword = keyword or ("redistribute" if rest.startswith("redistribute ") else rest.split(" ")[0])
        regex = rest if rest.startswith("redistribute ") else rest[len(keyword) + 1 :]
        out.append((label, int(head), keyword, re.compile(_spaced(regex))))
    return out


@functools.cache
def _gate():
    import ahocorasick

    of: dict[str, list[int]] = {}
    for i, (_, _, keyword, _) in enumerate(rules()):
        of.setdefault(max(keyword.split(" "), key=len), []).append(i)  # blanks vary, one word doesn't
    made = ahocorasick.Automaton()
    for keyword, numbers in of.items():
        made.add_word(keyword, numbers)
    made.make_automaton()
    return made


def detections(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in a lower-cased text, by place; none lies inside another."""
    gated = sorted({i for _, numbers in _gate().iter(text) for i in numbers})
    found = []
    for i in gated:
        label, priority, _, regex = rules()[i]
        found += [(m.start(), m.end(), label, priority) for m in regex.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
    taken: list[tuple[int, int, str, int]] = []
    # starts and ends, both ascending, of the taken ones that no other taken one holds
    starts: list[int] = []
    ends: list[int] = []
    for d in found:
        at = bisect.bisect_right(starts, d[0])
        if at and ends[at - 1] >= d[1]:
            continue
        taken.append(d)
        low, high = bisect.bisect_left(starts, d[0]), bisect.bisect_right(ends, d[1])
        starts[low:high], ends[low:high] = [d[0]], [d[1]]
    return sorted(taken)


def base_places(found: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of each place of a base phrase, in order."""
    flat = b" " + b" ".join(found) + b" "
    out, blanks = [], None
    for phrase, label in BASE.items():
        at = flat.find(needle := b" " + phrase.encode() + b" ")
        while at != -1:
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
            out.append((int(np.searchsorted(blanks, at)), label))
            at = flat.find(needle, at + 1)
    return sorted(out)


def license_scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Base phrases are found as consecutive words; rules add detections with character offsets into the text. ``labels`` are both kinds'
    labels, ``score`` is the highest priority found over 9 (a base phrase counts as 6), 0 without any. A null or empty
    text has no words; null and repeated keys are kept, one output row for each input row; other columns are
    ignored; no rows give no rows. Of detections of one priority the longer is taken first, then the earlier, then the label that
    sorts first. A text of any length is scanned whole, in one task; no rows move.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
    columns = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", span)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = [[] for _ in columns]
            for raw in b.column("text").to_pylist():
                found = words(raw)
                places = base_places(found)
                taken = detections(raw.translate(_LOWER).decode("utf-8", "replace"))
                base = {label for _, label in places}
                every = base | {label for _, _, label, _ in taken}
                score = max([p for *_, p in taken] + [6] * bool(places), default=0) / 9
                spans = [{"start": s, "end": e, "label": x, "priority": p} for s, e, x, p in taken]
                for o, v in zip(out, (len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(every)), score, spans), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(v, t) for v, (_, t) in zip(out, columns, strict=True))], ["key", *(n for n, _ in columns)])

    rows = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"))
    made = rows.mapInArrow(scan, "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:int>>")
    return made.withColumnRenamed("key", key)
