"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets word, symbol, line and repetition counts and a base verdict. Rule failures are then
summed by host (map-side combined, so a host with a third of all rows costs one row per task), the
failure rates of the hosts are shrunk with an empirical beta prior, and the verdict on the host is
joined back to its documents.

Defined cases: a null or empty text has no words and fails the base rule; documents with a null host
form one host of their own; repeated rows are counted and returned one by one; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_by_counts, materialize

SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(grams: Column, size: int) -> Column:
    """Words inside windows that occur twice or more: sort (window, place), keep places with an equal
    neighbour, then add up how far each place reaches beyond the one before it."""
    def covered(s: Column) -> Column:
        n = F.size(s)
        at = F.filter(
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda j: F.when(
                    (s[j]["w"] == F.get(s, j - 1)["w"]) | (s[j]["w"] == F.get(s, j + 1)["w"]), s[j]["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.aggregate(
            F.sort_array(at),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    pairs = F.sort_array(F.transform(grams, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(pairs, covered))


def document_metrics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 5, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, the columns named in ``carry``, host and the counts that the rules use."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), *carry, F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    split = base.select(
        "doc_id", *carry, "host", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
    )
    w = F.col("words")
    counted = split.select(
        "doc_id", *carry, "host",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(w) >= window,
            F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])),
        ).alias("grams"),
    )
    return counted.select(
        "doc_id", *carry, "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(_repeated_words(F.col("grams"), window), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 10, max_repeat_percent: int = 20, max_symbol_percent: int = 30, max_dup_line_percent: int = 60,
    max_host_rate: float = 0.6, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, the columns named in ``carry``, counts, base_failed, the host's shrunk failure
    rate and kept.

    A document counts as failed for its host if the base rule, the symbol rule (symbols per word) or
    the duplicate-line rule fails. The prior is Beta(m*s, (1-m)*s): m is the failure rate of all
    documents, s the strength that the spread of the hosts' rates beyond sampling noise implies.
    A host is rejected if (failed + m*s) / (documents + s) exceeds ``max_host_rate``.
    """
    measured = document_metrics(docs, id_col, text_col, host_col, carry=carry)
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > max_symbol_percent * F.col("n_words")) | (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"))
    measured = measured.withColumn("base_failed", base_failed).withColumn("rule_failed", base_failed | soft)
    measured = materialize(measured, "quality")
    named = [F.coalesce("host", F.lit("")).alias("__host"), F.col("host").isNull().alias("__no_host")]
    hosts = measured.groupBy(*named).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    # decimals, so that the sum doesn't depend on the order of the hosts
    failed, docs_of = F.col("host_failed").cast("decimal(19,0)"), F.col("host_docs").cast("decimal(19,0)")
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"),
        F.sum((failed * failed / docs_of).cast("decimal(38,12)")).alias("ff"),
    ).first()
    n = float(total["n"] or 0)
    m = float(total["f"] or 0) / n if n else 0.0
    spread = (float(total["ff"] or 0) / n - m * m) - m * (1 - m) * float(total["hosts"]) / n if n else 0.0
    strength = min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 1e-12 else 1e6
    rate = (F.col("host_failed") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    verdicts = hosts.select("__host", "__no_host", "host_docs", rate.alias("host_rate"))
    judged = join_by_counts(measured.select("*", *named), verdicts, ["__host", "__no_host"], "host_docs", int(n))
    return judged.select(
        "doc_id", *carry, "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("host_rate", 6).alias("host_rate"),
        (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"),
    )
