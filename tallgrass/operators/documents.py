"""Documents as lines: tables of lines, sections, windows, blocks and spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

PAGE_MARK = r"(?i)^\s*(---+\s*)?page\s+\d+(\s+of\s+\d+)?(\s*---+)?\s*$"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each filled line that is no page mark: key, line_no from 1, line_id L0001.., raw_index, text, is_bullet."""
    split = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("raw_index", "line"))
    kept = split.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(PAGE_MARK))
    n = F.row_number().over(Window.partitionBy(key).orderBy("raw_index"))
    return kept.withColumn("line_no", n).select(key, "line_no", F.format_string("L%04d", "line_no").alias("line_id"), "raw_index", "line", t.is_bullet(F.col("line")).alias("is_bullet"))


def sections(rows: DataFrame, key: str, order: str, is_header: Column, name: Column) -> DataFrame:
    """Adds section_no (0 before the first header) and section, the name its header gives."""
    by = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("section_no", F.sum(is_header.cast("int")).over(by))
    return numbered.withColumn("section", F.last(F.when(is_header, name), ignorenulls=True).over(by))


def section_texts(rows: DataFrame, key: str, order: str, line: str, most: int) -> DataFrame:
    """(key, section_no, section, body): lines joined in order and cut to ``most`` characters."""
    parts = rows.groupBy(key, "section_no", "section").agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("parts"))
    return parts.select(key, "section_no", "section", F.left(F.array_join(F.transform("parts", lambda p: p[line]), "\n"), F.lit(most)).alias("body"))


def windows(counts: DataFrame, key: str, n: str, size: int = 80, overlap: int = 15) -> DataFrame:
    """(key, window_no, first, last): overlapping runs of lines; the last one ends with the document."""
    size = max(20, size)
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - size) / step)).cast("int")
    each = counts.where(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return each.select(key, "window_no", (F.col("window_no") * step + 1).alias("first"), F.least(F.col(n), F.col("window_no") * step + size).cast("int").alias("last"))


def blocks(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Adds block_no: a block begins at each row where ``starts`` holds, and at the first row."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("block_no", F.sum(F.when(starts | (F.row_number().over(by) == 1), 1).otherwise(0)).over(by))


def headed_blocks(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Adds block_no, where a header goes on: a header right after a header with no body line between them joins its block.

    A fold over each document's lines in order, as whether a header opens a block depends on the block before.
    """
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, kind))).alias("all"))
    empty = F.struct(F.lit(0).alias("no"), F.lit(False).alias("bare"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        header = x[kind] == "header"
        no = F.when((s.no == 0) | (header & ~s.bare), s.no + 1).otherwise(s.no)
        return F.struct(no.alias("no"), header.alias("bare"), F.concat(s.out, F.array(no)).alias("out"))

    folded = packed.select(key, "all", F.aggregate("all", empty, step).out.alias("nos"))
    each = folded.select(key, F.explode(F.arrays_zip("all", "nos")).alias("z"))
    return rows.join(each.select(key, F.col(f"z.all.{order}").alias(order), F.col("z.nos").alias("block_no")), [key, order])


def normal_spans(spans: DataFrame, counts: DataFrame, key: str, least: float) -> DataFrame:
    """Spans whose lines exist and whose confidence is at least ``least``; reversed ones are turned round.

    spans: key, span_type, start_line, end_line, confidence; counts: key, n.
    """
    inside = spans.join(counts, key).where("start_line between 1 and n and end_line between 1 and n").where(F.col("confidence") >= least)
    return inside.select(key, "span_type", F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"), "confidence")


def distinct_spans(spans: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Drops of two spans of one type that overlap by ``share`` of the shorter the one of lower (confidence, length).

    Spans are met from high to low and compared with those kept before, so the choice is greedy; a pairwise
    join would drop too much. A task holds what it kept of one document; Spark sorts the rows.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = choose  # no document yet
        # spans of the document that were kept, by type and by each bin of 64 lines that they reach; only those can overlap
        held: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for batch in batches:
            kept: list[int] = []
            for i, (doc, kind, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "span_type", "start_line", "end_line")), strict=True)):
                if doc != now:
                    now, held = doc, {}
                bins = [(kind, n) for n in range(a // 64, b // 64 + 1)]
                if all(min(b, y) - max(a, x) + 1 < share * min(b - a + 1, y - x + 1) for n in bins for x, y in held.get(n, ())):
                    kept.append(i)
                    for n in bins:
                        held.setdefault(n, []).append((a, b))
            yield batch.take(pa.array(kept, pa.int64()))

    length, none = F.col("end_line") - F.col("start_line"), F.coalesce(F.isnan(F.col("confidence").cast("double")), F.lit(True))
    ordered = spans.repartition(key).sortWithinPartitions(key, none, F.desc("confidence"), length.desc(), "start_line", "end_line")
    return ordered.mapInArrow(choose, spans.schema)


def capped_spans(spans: DataFrame, key: str, caps: dict[str, int], other: int) -> DataFrame:
    """At most so many spans of a type in a document, in the order of their places."""
    n = F.row_number().over(Window.partitionBy(key, "span_type").orderBy("start_line", "end_line"))
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("span_type")), F.lit(other))
    return spans.withColumn("nth", n).where(F.col("nth") <= cap).drop("nth")


def docx_text(files: DataFrame) -> DataFrame:
    """(path, text) of Word files read as binaryFile: paragraphs and tables in document order, tables as Markdown, headers and footers last."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def body(node) -> Iterator[str]:
        for child in node:
            if child.tag == f"{ns}p":
                yield "".join(x.text or "" for x in child.iter(f"{ns}t"))
            elif child.tag == f"{ns}tbl":
                cells = [[" ".join("".join(x.text or "" for x in p.iter(f"{ns}t")) for p in c.iter(f"{ns}p")).strip() for c in r.iter(f"{ns}tc")] for r in child.iter(f"{ns}tr")]
                for i, row in enumerate(cells):
                    yield "| " + " | ".join(row) + " |"
                    if not i:
                        yield "|" + " --- |" * len(row)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for raw in pdf["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        parts = ["word/document.xml", *sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")))]
                        found = []
                        for name in parts:
                            root = ElementTree.fromstring(z.read(name))
                            found += [x for x in body(root[0] if name.endswith("document.xml") else root) if x.strip()]
                        texts.append("\n".join(found))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "content").mapInPandas(read, "path string, text string")
