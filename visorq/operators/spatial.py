"""Overlap joins by place: boxes meet through grid cells, so a crowded frame is never paired as a whole.

Boxes are put on levels by their longer side, each level's cells being twice as wide as those of the level below. On its own
level and on all above a box touches at most four cells. Of two boxes that overlap the smaller one meets the larger on the
larger one's level; they may share several cells there and are reported by the one that holds the corner where
their overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import discard, stored

KEYS = ("frame_id", "label")
_CORNERS = ("x1", "y1", "x2", "y2")


def with_corners(det: DataFrame) -> DataFrame:
    return det.withColumns(dict(zip(_CORNERS, G.corners(*(F.col(c) for c in ("cx", "cy", "w", "h"))), strict=True)))


def overlap_pairs(boxes: DataFrame, keys: tuple[str, ...] = KEYS, id_col: str = "det_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The keys, id_a < id_b, iou and, of both, what ``carry`` names (with _a and _b): all pairs of the same keys whose
    overlap has an area. boxes: the keys, the id, x1, y1, x2, y2. Boxes without an area overlap nothing."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    real = boxes.filter("x2 > x1 and y2 > y1").select(*keys, F.col(id_col).alias("id"), *carry, *_CORNERS, side.alias("side"))
    base = real.agg(F.percentile_approx("side", 0.5)).first()[0] or 1.0
    leveled = real.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("side") / base))).cast("int"))
    levels = sorted(r["level"] for r in leveled.select("level").distinct().collect())  # few: they count doublings

    def cells(rows: DataFrame, level: Column, name: str) -> DataFrame:
        out = rows.withColumn("on", level)
        width = F.lit(base) * F.pow(F.lit(2.0), F.col("on"))
        at = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
        out = out.withColumn("gx", at("x1", "x2")).withColumn("gy", at("y1", "y2"))
        held = [F.col(c).alias(f"{c}_{name}") for c in ("id", "level", *carry, *_CORNERS)]
        return out.select(*keys, "on", "gx", "gy", *held)

    large = cells(leveled, F.col("level"), "l")
    small = cells(leveled, F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("level"))), "s")
    low = lambda c: F.greatest(F.col(f"{c}_l"), F.col(f"{c}_s"))
    high = lambda c: F.least(F.col(f"{c}_l"), F.col(f"{c}_s"))
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("on"))
    here = (F.floor(low("x1") / width) == F.col("gx")) & (F.floor(low("y1") / width) == F.col("gy"))
    meet = (low("x1") < high("x2")) & (low("y1") < high("y2"))
    once = (F.col("level_s") < F.col("level_l")) | (F.col("id_s") < F.col("id_l"))
    other = (F.col("id_s") != F.col("id_l"))
    pairs = large.join(small, [*keys, "on", "gx", "gy"]).filter(meet & here & once & other)
    first = F.col("id_l") < F.col("id_s")
    corner = lambda n: [F.col(f"{c}_{n}") for c in _CORNERS]
    both = [x for c in ("id", *carry) for x in (F.when(first, F.col(f"{c}_l")).otherwise(F.col(f"{c}_s")).alias(f"{c}_a"), F.when(first, F.col(f"{c}_s")).otherwise(F.col(f"{c}_l")).alias(f"{c}_b"))]
    return pairs.select(*keys, *both, G.iou_corners(corner("l"), corner("s")).alias("iou"))


def suppressed(boxes: DataFrame, iou: float, keys: tuple[str, ...] = KEYS, id_col: str = "det_id", by: str = "confidence") -> DataFrame:
    """The keys and id of the boxes that greedy suppression drops, for frames of any number of boxes.

    Better boxes go before worse (``by``, then the smaller id). A box that no better box left conflicts with stays, and drops all
    it conflicts with; then the next round looks at the conflicts that are left. The result is the greedy one; a
    round is a few joins over conflicts, and rounds are as many as the longest chain of decisions."""
    pairs = overlap_pairs(boxes, keys, id_col, (by,)).filter(F.col("iou") > iou)
    a_first = (F.col(f"{by}_a") > F.col(f"{by}_b")) | ((F.col(f"{by}_a") == F.col(f"{by}_b")) & (F.col("id_a") < F.col("id_b")))
    left = stored(pairs.select(*keys, F.when(a_first, F.col("id_a")).otherwise(F.col("id_b")).alias("better"), F.when(a_first, F.col("id_b")).otherwise(F.col("id_a")).alias("worse")), "conflicts")
    gone = []
    while left.first() is not None:
        worse = left.select(*keys, F.col("worse").alias("better")).distinct()
        lost = stored(left.join(worse, [*keys, "better"], "left_anti").select(*keys, "worse").distinct(), "suppressed")
        gone.append(lost)
        # conflicts with a box that is dropped are over, whichever side it is on; so are those of boxes that stay
        rest = left.join(lost, [*keys, "worse"], "left_anti")
        before, left = left, stored(rest.join(lost.withColumnRenamed("worse", "better"), [*keys, "better"], "left_anti"), "conflicts")
        discard(before)
    discard(left)
    out = boxes.select(*keys, F.col(id_col)).limit(0)
    for lost in gone:
        out = out.unionByName(lost.withColumnRenamed("worse", id_col))
    return out
