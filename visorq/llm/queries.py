"""The operators' queries over the standard tables, with production parameters."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared
from ._shared import table


def tokenizer_path() -> str:
    """The public byte-level vocabulary; another file by VISORQ_TOKENIZER."""
    if at := os.environ.get("VISORQ_TOKENIZER"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    index = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe

    _shared.small_batches(spark)
    coded = bpe(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_KINDS, secret_scan, span_digest

    found = secret_scan(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(span_digest(base).cast("binary"), 256).alias("base_sha256"), span_digest(F.col("found")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def pii_key() -> bytes:
    """The secret of the pseudonyms: VISORQ_PII_KEY, or a new one for this process, which nobody can undo later."""
    return os.environ["VISORQ_PII_KEY"].encode() if "VISORQ_PII_KEY" in os.environ else _SESSION_KEY


_SESSION_KEY = secrets.token_bytes(32)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii

    _shared.small_batches(spark)
    return pii(table(spark, sf_dir, "documents"), pii_key())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_words

    done = removed_words(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_bytes

    done = removed_bytes(table(spark, sf_dir, "documents"))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return done.select("doc_id", "n_bytes", "n_removed", n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def queries():
    """All registered queries of this subpackage but the pipeline, which lives beside the package."""
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_warc, op3_bpe, op4_secret_scan, op5_decontaminate, op6_near_duplicates, op7_pii, op8_quality_rules,
        op9_substring_dedup, op10_line_dedup, op11_quality_cnn, op12_centroids, op13_hard_negatives,
    )}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
