"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A decision is on a row: rows are told apart by id, source and text together, so that rows with
a null id or that share an id are judged each by itself, and only rows that agree in all three share a
decision. Null texts have no words and are rejected by the quality rules; an empty table stays empty;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visorq.llm._shared import discard, materialize, row_key, small_batches, split_by_slots
from visorq.llm.bpe import bpe
from visorq.llm.decontaminate import decontaminate
from visorq.llm.line_dedup import dedup_lines
from visorq.llm.near_dup import near_duplicates
from visorq.llm.quality_rules import quality_rules
from visorq.llm.queries import tokenizer_path

#: Quality verdicts depend on sums over hosts and later stages on 64-bit hashes and merge tables, which
#: SQL can't express; tests hold the result against brute force.
ORACLE_SQL = None


_KEY = ("__r1", "__r2")


def _without(docs: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``rejected`` doesn't return; it gets doc_id, source, text and the row's key,
    and returns rows with the key."""
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", *row_key("doc_id", "source", "text"))
    gone = materialize(rejected(keyed.drop("row")).select(*_KEY).distinct(), "rejected")
    likely, rest = split_by_slots(keyed, F.col("__r1"), gone, F.col("__r1"))
    return likely.join(gone, [*_KEY], "left_anti").select("row.*").unionByName(rest.select("row.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda rows: quality_rules(rows, carry=_KEY).filter(~F.col("kept")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda rows: near_duplicates(rows, carry=_KEY).filter(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda rows: decontaminate(rows, items, carry=_KEY).filter("n_hit > 0"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe(docs, tokenizer_path()).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
