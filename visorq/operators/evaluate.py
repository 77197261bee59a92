"""Thresholds and binary evaluation of scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Values that one task sorts at the end of a selection, at most.
FEW = 100_000


def nth_smallest(values: DataFrame, col: str, rank: int, few: int = FEW):
    """The value at ``rank`` (from 1) of the column's values that aren't null, exactly; None beyond their number.

    No task holds all values: a mergeable sketch of quantiles gives two values near the rank, one pass counts what lies
    below, between and above them, and the part that holds the rank is cut again until it is small. Each pass
    leaves some ten-thousandths, and drops one value at least, so equal values don't stop it."""
    inside = values.select(F.col(col).alias("x")).filter(F.col("x").isNotNull())
    part, n = inside, inside.count()
    if not 0 < rank <= n:
        return None
    x, below = F.col("x"), 0
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    while n > few:
        at, slack, fine = (rank - below) / n, 2e-4, 10_000
        low, high = part.agg(F.percentile_approx("x", [max(0.0, at - slack), min(1.0, at + slack)], fine)).first()[0]
        a, b = F.lit(low), F.lit(high)
        c = part.agg(
            count(x < a).alias("lt_a"), count(x <= a).alias("le_a"), count(x < b).alias("lt_b"), count(x <= b).alias("le_b"), F.max(F.when(x < a, x)).alias("before_a"),
            F.min(F.when(x > a, x)).alias("after_a"), F.max(F.when(x < b, x)).alias("before_b"), F.min(F.when(x > b, x)).alias("after_b"),
        ).first()
        want = rank - below
        if want <= c["lt_a"]:
            part, n = part.filter(x <= c["before_a"]), c["lt_a"]
        elif want <= c["le_a"]:
            return low
        elif want <= c["lt_b"]:
            part, n, below = part.filter((x >= c["after_a"]) & (x <= c["before_b"])), c["lt_b"] - c["le_a"], below + c["le_a"]
        elif want <= c["le_b"]:
            return high
        else:
            part, n, below = part.filter(x >= c["after_b"]), n - c["le_b"], below + c["le_b"]
    return part.agg(F.element_at(F.sort_array(F.collect_list("x")), rank - below)).first()[0]


def score_thresholds(scores: DataFrame, col: str = "score", k: float = 3.0, percent: float = 99.0, few: int = FEW) -> DataFrame:
    """One row: n, max, mean + k sigma (population), nearest-rank percentile, and what they come from. The scores are
    read a few times, so store them first where they are costly."""
    n = scores.select(F.count(col)).first()[0]
    found = nth_smallest(scores, col, max(1, math.ceil(percent / 100 * n)), few)
    return scores.agg(
        F.max(col).alias("thr_max"), (F.avg(col) + k * F.stddev_pop(col)).alias("thr_sigma"), F.lit(found).cast("double").alias("thr_percentile"),
        F.min(col).alias("min_score"), F.avg(col).alias("mean_score"), F.stddev_pop(col).alias("std_score"), F.count(col).alias("n"),
    )


def thresholds_by_method(scores: DataFrame, col: str = "score", k: float = 3.0, percent: float = 99.0) -> DataFrame:
    """method, threshold, num_samples: a row for each way of setting the threshold."""
    return score_thresholds(scores, col, k, percent).selectExpr(
        "stack(3, 'max_score', thr_max, 'mean_ksigma', thr_sigma, 'percentile', thr_percentile) as (method, threshold)", "n as num_samples")


def _metrics(counts: DataFrame) -> DataFrame:
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"accuracy": safe(tp + tn, tp + fp + tn + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def confusion(samples: DataFrame, threshold: float, truth: str = "truth", score: str = "score") -> DataFrame:
    """Counts and rates at ``score >= threshold``."""
    hit = F.col(score) >= threshold
    count = lambda c: F.sum(c.cast("long"))
    return _metrics(samples.agg(
        count(hit & (F.col(truth) == 1)).alias("tp"), count(hit & (F.col(truth) != 1)).alias("fp"),
        count(~hit & (F.col(truth) != 1)).alias("tn"), count(~hit & (F.col(truth) == 1)).alias("fn"),
    ))


def threshold_sweep(samples: DataFrame, steps: int = 1000, truth: str = "truth", score: str = "score") -> DataFrame:
    """Metrics at steps + 1 evenly spaced thresholds from the least to the largest score.

    Each sample is put into its step by arithmetic, the steps are counted with one aggregation, and
    running sums over the steps + 1 rows give all confusion counts: no sample meets a threshold row.
    """
    ends = samples.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    lo, hi = ends.first()
    spark = samples.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    if lo is None:
        return _metrics(grid.select("i", *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")], F.lit(0.5).alias("threshold"))).limit(0)
    at = lambda i: F.lit(lo) + F.lit(hi - lo) * i / steps
    # the last step whose threshold the score reaches; division can be off by one, so it is put right
    guess = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((F.col(score) - lo) / (F.lit(hi - lo) if hi > lo else F.lit(1.0)) * steps).cast("int")))
    own = F.when((guess < steps) & (F.col(score) >= at(guess + 1)), guess + 1).when((guess > 0) & (F.col(score) < at(guess)), guess - 1).otherwise(guess)
    if hi == lo:
        own = F.lit(steps)
    per = samples.groupBy(own.alias("i")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) != 1).cast("long")).alias("n"))
    up = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = grid.join(per, "i", "left").fillna(0, ["p", "n"])
    counts = full.select(
        "i", at(F.col("i")).alias("threshold"), F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"),
        (F.sum("n").over(all_rows) - F.sum("n").over(up)).alias("tn"), (F.sum("p").over(all_rows) - F.sum("p").over(up)).alias("fn"),
    )
    return _metrics(counts)


def best_threshold(samples: DataFrame, steps: int = 1000) -> DataFrame:
    """The first threshold of the largest F1; 0.5 where no F1 is above zero."""
    best = threshold_sweep(samples, steps).agg(F.max(F.struct("f1", (-F.col("i")).alias("j"), "threshold")).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def roc(samples: DataFrame, truth: str = "truth", score: str = "score", parts: int = 64) -> DataFrame:
    """score, tp, fp: cumulative counts at each distinct score from the largest down.

    Equal scores are first combined; the running sums are taken inside score ranges and then shifted by
    the totals of the ranges above, so no task sorts all scores.
    """
    per = samples.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) != 1).cast("long")).alias("n"))
    bounds = sorted(set(per.approxQuantile("score", [i / parts for i in range(1, parts)], 0.005)), reverse=True)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("score") < b)) if bounds else F.lit(0)
    cut = per.withColumn("part", part)
    spans = cut.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.select("part", F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"))
    own = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(base, "part").select("score", (F.col("bp") + F.sum("p").over(own)).alias("tp"), (F.col("bn") + F.sum("n").over(own)).alias("fp"), "p", "n")


def auc(samples: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids: each step adds its negatives times the mean true count."""
    area = roc(samples).agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("a"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    both = F.col("pos") * F.col("neg")
    return area.select(F.when(both > 0, F.col("a") / both).otherwise(0.0).alias("auc"), F.col("pos"), F.col("neg"))
