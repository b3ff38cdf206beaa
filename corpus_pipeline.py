"""A training corpus from raw documents: five stages, each written and read again before the next.

1. toxicity: documents that the ordinal model finds toxic go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. decontamination: documents that hold ten consecutive words of a benchmark item go.
4. mixing: each document is taken as often as the source mix says; copies are rows, those without a copy go.
5. token_output: what is left is written as token ids and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import Scratch, table
from tallgrass.llm.decontaminate import contaminated
from tallgrass.llm.minhash_dedup import near_dedup
from tallgrass.llm.mixing import mix
from tallgrass.llm.token_output import tokens_written_and_read
from tallgrass.llm.toxicity import severity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model, trained on the labelled texts among them, doesn't find toxic.

    Null and empty texts stay; null and repeated keys are rows like any other; without labels nothing goes; no rows give no rows. Columns
    beside those of documents are dropped.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return severity(docs, model, keep=COLUMNS[1:]).where("not toxic").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of its smallest doc_id, null last, and of rows that share that the first.

    Rows are told apart by their number, not by doc_id, so other texts under a dropped row's key stay. Texts without words are
    no copies of each other: all stay. No rows give no rows. Columns beside those of documents are dropped.
    """
    numbered = Scratch(spark, "near-copies").put(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = Scratch(spark, "near-copies-found").put(near_dedup(numbered, size=5, percent=80, extra=("row",)).select("doc_id", "group_row", "row"))
    first = found.where("group_row is not null").groupBy("group_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    stays = found.where("group_row is null").select("row").unionByName(first.select("first.row"))
    return numbered.join(stays.hint("merge"), "row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of ten words of a benchmark item.

    Null and empty texts stay; null and repeated keys are rows like any other; without items nothing goes; no rows give no rows. Columns
    beside those of documents are dropped.
    """
    return contaminated(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken k times is k rows with its doc_id.

    Null and empty texts weigh nothing and stay once; a null source is the last; rows that share a key are taken each for itself; no rows
    give no rows. Columns beside those of documents are dropped.
    """
    numbered = Scratch(spark, "mixed").put(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    taken = mix(numbered, extra=("row",)).where("copies > 0").select("row", "copies")
    return numbered.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids as written and read back: doc_id, start, n_tokens, ids_crc32. A null text is empty and has the end id alone;
    a null key comes first, copies of a document one after the other; no rows give no rows."""
    return tokens_written_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: Trained and randomised stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
