"""Detection analytics: decoding, confidence filter, NMS, fusion, target assignment, losses, mAP."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import stored
from . import spatial

DET = "frame_id long, det_id long, label string, confidence double, cx double, cy double, w double, h double"


def confidence_filter(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    return det.filter(F.col("confidence") >= threshold)


def _suppress(box: list[tuple], iou: float) -> list[int]:
    """Places of the boxes that stay, of boxes (x1, y1, x2, y2) sorted best first."""
    kept: list[int] = []
    for i, (x1, y1, x2, y2) in enumerate(box):
        area = (x2 - x1) * (y2 - y1)
        for k in kept:
            u1, v1, u2, v2 = box[k]
            inter = max(0.0, min(x2, u2) - max(x1, u1)) * max(0.0, min(y2, v2) - max(y1, v1))
            if inter / (area + (u2 - u1) * (v2 - v1) - inter + 1e-6) > iou:
                break
        else:
            kept.append(i)
    return kept


#: Boxes of a frame and label that one task suppresses; rows of a lot of frames, at most about.
CROWD, LOT_ROWS = 5_000, 100_000


def nms(det: DataFrame, iou: float = 0.45, confidence: float = 0.5, crowd: int | None = None) -> DataFrame:
    """Greedy per-label suppression inside each frame, by confidence and then det_id.

    Frames are dealt in lots, at least four per shuffle partition and more where there are many rows, and each
    lot decides its frames one after the other. A frame with more than ``crowd`` boxes of a label is decided in distributed
    rounds (``spatial.suppressed``) with the same result."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame_id", "label", "confidence", "det_id"], ascending=[True, True, False, True])
        x, y, w, h = (part[c].to_numpy() for c in ("cx", "cy", "w", "h"))
        box = list(zip((x - w / 2).tolist(), (y - h / 2).tolist(), (x + w / 2).tolist(), (y + h / 2).tolist(), strict=True))
        frame, label = part["frame_id"].to_numpy(), part["label"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (frame[1:] != frame[:-1]) | (label[1:] != label[:-1]), [True]))).tolist()
        keep = [a + i for a, b in zip(cut, cut[1:]) for i in (_suppress(box[a:b], iou) if b - a > 1 else (0,))]
        return part.iloc[keep].drop(columns="lot")

    likely = confidence_filter(det, confidence).select("frame_id", "det_id", "label", "confidence", "cx", "cy", "w", "h")
    per = likely.groupBy(*spatial.KEYS).agg(F.count(F.lit(1)).alias("n"))
    n, most = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    lots = max(4 * int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LOT_ROWS))
    dealt = lambda x: x.withColumn("lot", F.pmod(F.xxhash64("frame_id"), F.lit(lots))).groupBy("lot").applyInPandas(run, DET)
    crowd = crowd or CROWD
    if most <= crowd:
        return dealt(likely)
    full = per.filter(F.col("n") > crowd).select(*spatial.KEYS)
    many = likely.join(full, [*spatial.KEYS], "left_semi").dropDuplicates([*spatial.KEYS, "det_id"])
    few = likely.join(full, [*spatial.KEYS], "left_anti")
    lost = spatial.suppressed(spatial.with_corners(many), iou)
    return dealt(few).unionByName(many.join(lost, [*spatial.KEYS, "det_id"], "left_anti").select("frame_id", "det_id", "label", "confidence", "cx", "cy", "w", "h"))


def iou_pairs(det: DataFrame) -> DataFrame:
    """IoU of the pairs of one frame and label, by id."""
    a, b = det.alias("a"), det.alias("b")
    box = lambda t: G.corners(*(F.col(f"{t}.{c}") for c in ("cx", "cy", "w", "h")))
    on = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.det_id") < F.col("b.det_id"))
    return a.join(b, on).select(F.col("a.det_id").alias("id_a"), F.col("b.det_id").alias("id_b"), G.iou_corners(box("a"), box("b")).alias("iou"), G.ciou_loss(box("a"), box("b")).alias("ciou"))


def decode_v8(cells: DataFrame, classes: int, threshold: float = 0.5, bins: int = 16, size: int = 640) -> DataFrame:
    """Cells (frame_id, cell, grid_w, data: 4*bins distance logits, then class logits, scale, pad_x,
    pad_y) to boxes in source pixels. The filter stands before the geometry."""
    d = F.col("data")
    scores = F.transform(F.slice(d, 4 * bins + 1, classes), G.sigmoid)
    best = cells.withColumn("scores", scores).withColumn("confidence", F.array_max("scores")).filter(F.col("confidence") >= threshold)
    best = best.withColumn("class_id", F.array_position("scores", F.col("confidence")).cast("int") - 1)
    dist = [G.softmax_expectation(F.slice(d, i * bins + 1, bins)) for i in range(4)]
    x, y = F.col("cell") % F.col("grid_w") + 0.5, F.expr("cell div grid_w") + 0.5
    stride = F.lit(float(size)) / F.col("grid_w")
    sided = best.withColumns({"l": dist[0], "t": dist[1], "r": dist[2], "b": dist[3], "gx": x, "gy": y, "stride": stride})
    back = lambda v, pad: (F.expr(v) * F.col("stride") - F.col(pad)) / F.col("scale")
    return sided.select(
        "frame_id", "cell", "class_id", "confidence", back("gx + (r - l) / 2", "pad_x").alias("cx"), back("gy + (b - t) / 2", "pad_y").alias("cy"),
        ((F.col("l") + F.col("r")) * F.col("stride") / F.col("scale")).alias("w"), ((F.col("t") + F.col("b")) * F.col("stride") / F.col("scale")).alias("h"),
    )


def decode_v5(cells: DataFrame, classes: int, threshold: float = 0.5) -> DataFrame:
    """Cells whose data hold cx, cy, w, h and class logits."""
    scores = F.transform(F.slice("data", 5, classes), G.sigmoid)
    best = cells.withColumn("scores", scores).withColumn("confidence", F.array_max("scores")).filter(F.col("confidence") >= threshold)
    back = lambda i, pad: (F.get("data", F.lit(i)) - F.col(pad)) / F.col("scale")
    return best.select(
        "frame_id", "cell", (F.array_position("scores", F.col("confidence")).cast("int") - 1).alias("class_id"), "confidence",
        back(0, "pad_x").alias("cx"), back(1, "pad_y").alias("cy"), (F.get("data", F.lit(2)) / F.col("scale")).alias("w"), (F.get("data", F.lit(3)) / F.col("scale")).alias("h"),
    )


def clip_to_image(width: Column | int, height: Column | int, cx: str = "cx", cy: str = "cy", w: str = "w", h: str = "h") -> dict[str, Column]:
    """Integer corners of center boxes inside the image, cut toward zero."""
    width, height = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    return {
        "x1": F.greatest(F.lit(0), (F.col(cx) - F.col(w) / 2).cast("int")), "y1": F.greatest(F.lit(0), (F.col(cy) - F.col(h) / 2).cast("int")),
        "x2": F.least(width - 1, (F.col(cx) + F.col(w) / 2).cast("int")), "y2": F.least(height - 1, (F.col(cy) + F.col(h) / 2).cast("int")),
    }


#: Detections of a task, about.
BOXES = 100_000


def fuse_detections(det: DataFrame, cells: DataFrame, threshold: float, width: int, height: int) -> DataFrame:
    """Largest anomaly score inside each detection's clipped box; empty boxes score 0; strict threshold. A box meets
    only the cells that it touches. The detections say into how many parts each step is dealt, so a task holds no more for more.

    cells: frame_id, y, x, score, where a cell is ``cell`` pixels wide and high (column cell)."""
    n = max(det.sparkSession.sparkContext.defaultParallelism, -(-det.count() // BOXES))
    place, box = ["frame_id", "cell", "y", "x"], ["frame_id", "det_id"]
    boxes = det.withColumns(clip_to_image(width, height)).filter("x1 <= x2 and y1 <= y2").select(*box, "x1", "y1", "x2", "y2")
    grids = cells.select("frame_id", "cell").distinct()
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("cell")), F.floor(F.col(high) / F.col("cell"))))
    touched = boxes.repartition(n, "frame_id").join(grids.repartition(n, "frame_id"), "frame_id").withColumn("y", span("y1", "y2")).withColumn("x", span("x1", "x2")).select(*box, "cell", "y", "x")
    scored = cells.select("frame_id", "cell", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "score")
    met = touched.repartition(n, *place).join(scored.repartition(n, *place), place)
    top = met.select(*box, "score").repartition(n, *box).groupBy(*box).agg(F.max("score").alias("anomaly_score"))
    best = det.repartition(n, *box).join(top, box, "left").withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(0.0)))
    return best.withColumn("is_anomaly", F.col("anomaly_score") > threshold)


def merge_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_scores(how: str, *parts: DataFrame) -> DataFrame:
    """Union of (key, score) tables, then the largest or mean score per key."""
    agg = {"max": F.max, "avg": F.avg}[how]
    return merge_union(*parts).groupBy("key").agg(agg("score").alias("score"))


def assign_targets(targets: DataFrame, strides: tuple[int, ...] = (8, 16, 32), size: int = 640) -> DataFrame:
    """Grid cell of each target's center on each scale; centers outside the grid are clamped."""
    scaled = targets.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides])))
    cell = lambda c: F.least(F.greatest((F.col(c) * size / F.col("stride")).cast("int"), F.lit(0)), F.expr(f"int({size} / stride) - 1"))
    return scaled.withColumn("gx", cell("cx")).withColumn("gy", cell("cy"))


def total_loss(box: Column, cls: Column, dfl: Column) -> Column:
    return 7.5 * box + 0.5 * cls + 1.5 * dfl


def detection_loss(rows: DataFrame, bins: int = 16) -> DataFrame:
    """One row: box, dfl, cls and total loss of assigned cells.

    rows: reg (4 * bins logits, sides l, t, r, b), cls (class logits), gx, gy (the cell's centre as a fraction), grid
    (cells per side), x1, y1, x2, y2 (the target as fractions), target (its class)."""
    side = lambda i: F.slice("reg", i * bins + 1, bins)
    far = [G.softmax_expectation(side(i)) / F.col("grid") for i in range(4)]
    gx, gy, grid = F.col("gx"), F.col("gy"), F.col("grid")
    box = G.ciou_loss((gx - far[0], gy - far[1], gx + far[2], gy + far[3]), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    reach = [(gx - F.col("x1")) * grid, (gy - F.col("y1")) * grid, (F.col("x2") - gx) * grid, (F.col("y2") - gy) * grid]
    inside = [F.greatest(F.lit(0.0), F.least(F.lit(bins - 0.01), t)) for t in reach]
    dfl = sum((G.dfl_loss(side(i), t, bins) for i, t in enumerate(inside)), F.lit(0.0)) / 4
    per_class = F.transform("cls", lambda x, i: G.bce_with_logits(x, (i == F.col("target")).cast("double")))
    cls = F.aggregate(per_class, F.lit(0.0), lambda a, x: a + x) / F.size("cls")
    return rows.agg(F.avg(box).alias("box"), F.avg(dfl).alias("dfl"), F.avg(cls).alias("cls")).withColumn("total", total_loss(F.col("box"), F.col("cls"), F.col("dfl")))


def tensor_valid(shape: str = "shape", data: str = "data") -> Column:
    """Whether an output tensor can be decoded: four dimensions, a batch of one, and data."""
    size = F.size(shape)
    return F.coalesce((size == 4) & (F.get(shape, F.lit(0)) == 1) & F.col(data).isNotNull() & (F.size(data) > 0), F.lit(False))


def label_text(label: Column, confidence: Column, score: Column | None = None) -> Column:
    """The text beside a drawn box: the label and whole percents, cut and not rounded."""
    percent = lambda x: F.concat((x * 100).cast("int").cast("string"), F.lit("%"))
    text = F.concat(label, F.lit(": "), percent(confidence))
    return text if score is None else F.concat(text, F.coalesce(F.concat(F.lit(" score:"), percent(score)), F.lit("")))


def roi_text(label: Column, score: Column, is_anomaly: Column) -> Column:
    return F.concat(label, F.lit(": "), F.when(is_anomaly, "NG ").otherwise("OK "), (score * 100).cast("int").cast("string"), F.lit("%"))


def detection_metrics(det: DataFrame, truth: DataFrame, confidence: float = 0.25, ious: tuple[float, ...] = tuple(0.5 + 0.05 * i for i in range(10))) -> DataFrame:
    """label, map50, map50_95 (the mean over the overlaps), precision and recall at the least overlap and the
    confidence. Every label of the truth has a row."""
    each = average_precisions(det, truth, ious)
    maps = each.groupBy("label").agg(F.max(F.when(F.col("i") == 0, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    sure = det.filter(F.col("confidence") >= confidence)
    counted = matched(sure, truth, ious[0]).groupBy("label").agg(F.sum("tp").alias("hits"), F.count(F.lit(1)).alias("found"))
    total = truth.groupBy("label").agg(F.count(F.lit(1)).alias("truths"))
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return maps.join(total, "label").join(counted, "label", "left").select("label", "map50", "map50_95", share("hits", "found").alias("precision"), F.coalesce(F.col("hits") / F.col("truths"), F.lit(0.0)).alias("recall"))


def _best_truth(det: DataFrame, truth: DataFrame, iou: float) -> DataFrame:
    """det_id, truth_id, confidence, iou: the truth box that a detection overlaps most, ties to the smaller id; overlaps below
    ``iou`` don't count."""
    d, t = det.alias("d"), truth.alias("t")
    box = lambda x: G.corners(*(F.col(f"{x}.{c}") for c in ("cx", "cy", "w", "h")))
    over = d.join(t, (F.col("d.frame_id") == F.col("t.frame_id")) & (F.col("d.label") == F.col("t.label"))).select(
        F.col("d.det_id").alias("det_id"), F.col("d.confidence").alias("confidence"), F.col("t.truth_id").alias("truth_id"), G.iou_corners(box("d"), box("t")).alias("iou")
    ).filter(F.col("iou") >= iou)
    return over.groupBy("det_id").agg(F.max(F.struct("iou", (-F.col("truth_id")).alias("k"), "confidence")).alias("b")).select("det_id", (-F.col("b.k")).alias("truth_id"), "b.confidence", "b.iou")


def matched(det: DataFrame, truth: DataFrame, iou: float = 0.5) -> DataFrame:
    """det_id, label, confidence, tp: a detection goes to the truth box that it overlaps most, and a truth box to
    its most confident detection; overlaps below ``iou`` don't count. Ids are det_id and truth_id."""
    best = _best_truth(det, truth, iou)
    hits = best.groupBy("truth_id").agg(F.max(F.struct("confidence", (-F.col("det_id")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("det_id"), F.lit(1).alias("tp"))
    return det.select("det_id", "label", "confidence").join(hits, "det_id", "left").fillna(0, ["tp"])


def average_precision(det: DataFrame, truth: DataFrame, iou: float = 0.5) -> DataFrame:
    """label, ap: each truth box is matched by the most confident detection that overlaps it enough.

    det and truth share frame_id and label; ids are det_id and truth_id."""
    return average_precisions(det, truth, (iou,)).select("label", "ap")


#: Detections of a stretch of the ranking, about, and stretches at most.
STRETCH, STRETCHES = 50_000, 256


def _stretches(det: DataFrame, stretch: int) -> tuple[Column, Column]:
    """(c, s): the ranking by falling confidence and rising det_id cut into stretches, falling c and then rising s.

    c counts quantiles of the confidence at or below a row's; rows at a quantile itself, which can be many, are cut
    again by quantiles of det_id. No stretch holds much more than its share of all rows, whatever the ties."""
    parts = max(2, min(STRETCHES, -(-det.count() // stretch)))
    at = det.select(F.col("confidence").cast("double").alias("confidence"), F.col("det_id").cast("double").alias("det_id")).approxQuantile(["confidence", "det_id"], [i / parts for i in range(1, parts)], 0.25 / parts)
    conf, ids = (F.array(*[F.lit(x) for x in sorted(set(q))]).cast("array<double>") for q in at)
    below = lambda bounds, x: F.size(F.filter(bounds, lambda b: b <= F.col(x)))
    return below(conf, "confidence"), F.when(F.array_contains(conf, F.col("confidence").cast("double")), below(ids, "det_id")).otherwise(-1)


def average_precisions(det: DataFrame, truth: DataFrame, ious: tuple[float, ...], stretch: int = STRETCH) -> DataFrame:
    """label, i, ap: the average precision at each of the overlaps, numbered from 0.

    The ranking of a label is taken in stretches: running counts inside each are shifted by the totals of those before, and
    the largest later precision is that inside the stretch or of a later one. Precision only rises at a hit, so the
    curve is followed over hits alone, and each stretch is sorted once, whatever the number of overlaps."""
    span = range(len(ious))
    best = _best_truth(det, truth, min(ious)).withColumn("i", F.explode(F.filter(F.array(*[F.when(F.col("iou") >= t, F.lit(i)) for i, t in enumerate(ious)]), lambda x: x.isNotNull())))
    hits = best.groupBy("i", "truth_id").agg(F.max(F.struct("confidence", (-F.col("det_id")).alias("k"))).alias("b")).select("i", (-F.col("b.k")).alias("det_id"))
    c, s = _stretches(det, stretch)
    placed = det.select("det_id", "label", "confidence", c.alias("c"), s.alias("s"))
    own = Window.partitionBy("label", "c", "s").orderBy(F.col("confidence").desc(), "det_id")
    marked = placed.join(hits.groupBy("det_id").agg(F.collect_set("i").alias("hits")), "det_id", "left")
    ranked = marked.withColumn("n", F.row_number().over(own)).withColumns({f"k{i}": F.count(F.when(F.array_contains("hits", i), 1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for i in span})
    ranked = stored(ranked.filter(F.col("hits").isNotNull()).drop("det_id", "confidence"), "ranked")
    # a row per stretch from here to the sums
    key = ["label", "c", "s"]
    order = Window.partitionBy("label").orderBy(F.col("c").desc(), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy("label").orderBy(F.col("c"), F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(ranked.groupBy(*key).agg(*[F.max(f"k{i}").alias(f"k{i}") for i in span]), key, "left")
    base = sums.select(*key, *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"b_{x}") for x in ("n", *(f"k{i}" for i in span))])
    curve = ranked.join(base, key).select(*key, "n", *[F.when(F.array_contains("hits", i), (F.col(f"b_k{i}") + F.col(f"k{i}")) / (F.col("b_n") + F.col("n"))).alias(f"p{i}") for i in span])
    tops = curve.groupBy(*key).agg(*[F.max(f"p{i}").alias(f"p{i}") for i in span]).select(*key, *[F.max(f"p{i}").over(reverse).alias(f"m{i}") for i in span])
    back = Window.partitionBy(*key).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = curve.withColumns({f"t{i}": F.max(f"p{i}").over(back) for i in span}).join(tops, key)
    area = later.groupBy("label").agg(*[F.sum(F.when(F.col(f"p{i}").isNotNull(), F.greatest(f"t{i}", f"m{i}"))).alias(f"s{i}") for i in span])
    total = truth.groupBy("label").agg(F.count(F.lit(1)).alias("truths"))
    each = F.posexplode(F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) / F.col("truths") for i in span])).alias("i", "ap")
    return total.join(area, "label", "left").select("label", each)
