"""Pixel operations on long pixel tables (image_id, row, col, ch, v), and score maps.

Resampling goes from the source: each source cell is joined to the output cells that use it, by an equi
join on a small generated grid of coordinates and weights, and summed map-side; no image meets another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import source_coordinate

#: Channel statistics (R, G, B) of the usual normalisation.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def axis(spark, n_in: int, n_out: int, name: str) -> DataFrame:
    """(in, out, weight): which source cells make up each output cell along one axis."""
    low, high, w = source_coordinate(F.col("id").cast("double"), n_in, n_out)
    grid = spark.range(n_out).select(F.col("id").cast("int").alias("out"), low.alias("low"), high.alias("high"), w.alias("w"))
    taps = grid.select("out", F.explode(F.array(F.struct(F.col("low").alias("i"), (1 - F.col("w")).alias("w")), F.struct(F.col("high").alias("i"), F.col("w").alias("w")))).alias("t"))
    return taps.groupBy("out", "t.i").agg(F.sum("t.w").alias("w")).filter("w > 0").select(F.col("i").alias(f"{name}_in"), F.col("out").alias(name), F.col("w").alias(f"{name}_w"))


def resize(pix: DataFrame, in_h: int, in_w: int, out_h: int, out_w: int, keys: tuple[str, ...] = ("image_id", "ch"), row: str = "row", col: str = "col", v: str = "v") -> DataFrame:
    """Bilinear with half-pixel centers and clamped borders. The two coordinate grids have at most two
    rows per output row or column, whatever the number of images."""
    spark = pix.sparkSession
    src = pix.select(*keys, F.col(row).alias("row_in"), F.col(col).alias("col_in"), F.col(v).alias("v_in"))
    taps = src.join(F.broadcast(axis(spark, in_h, out_h, "row")), "row_in").join(F.broadcast(axis(spark, in_w, out_w, "col")), "col_in")
    return taps.groupBy(*keys, F.col("row").alias(row), F.col("col").alias(col)).agg(F.sum(F.col("v_in") * F.col("row_w") * F.col("col_w")).alias(v))


def normalize(pix: DataFrame, bgr_to_rgb: bool = True) -> DataFrame:
    """Channel swap, /255 and per-channel standardisation, as columns."""
    out = pix.withColumn("ch", 2 - F.col("ch")) if bgr_to_rgb else pix
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("ch") + 1)
    return out.withColumn("v", (F.col("v") / 255 - pick(MEAN)) / pick(STD))


def crop(pix: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    if w <= 0 or h <= 0:
        raise ValueError("empty crop")
    inside = F.col("row").between(y, y + h - 1) & F.col("col").between(x, x + w - 1)
    return pix.filter(inside).withColumns({"row": F.col("row") - y, "col": F.col("col") - x})


def letterbox_pixels(pix: DataFrame, in_h: int, in_w: int, out_h: int, out_w: int, pad: float = 114.0) -> DataFrame:
    """Scaled image in the middle of a padded canvas; an odd remainder goes to the right and bottom."""
    scale = min(out_w / in_w, out_h / in_h)
    new_w, new_h = int(in_w * scale + 0.5), int(in_h * scale + 0.5)
    px, py = (out_w - new_w) // 2, (out_h - new_h) // 2
    inner = resize(pix, in_h, in_w, new_h, new_w).withColumns({"row": F.col("row") + py, "col": F.col("col") + px})
    frame = pix.select("image_id", "ch").distinct().select("image_id", "ch", F.explode(F.sequence(F.lit(0), F.lit(out_h * out_w - 1))).alias("p"))
    canvas = frame.selectExpr("image_id", "ch", f"int(p div {out_w}) as row", f"int(p % {out_w}) as col")
    border = canvas.filter((F.col("row") < py) | (F.col("row") >= py + new_h) | (F.col("col") < px) | (F.col("col") >= px + new_w))
    return inner.unionByName(border.withColumn("v", F.lit(pad)))


def flip(pix: DataFrame, width: int) -> DataFrame:
    """Mirrored left to right."""
    return pix.withColumn("col", width - 1 - F.col("col"))


def tensors(pix: DataFrame, channels: int = 3) -> DataFrame:
    """image_id, shape (channels, height, width) and data in that order, from whole images."""
    at = F.struct("ch", "row", "col", "v")
    listed = pix.groupBy("image_id").agg(F.sort_array(F.collect_list(at)).alias("p"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    return listed.select("image_id", F.array(F.lit(channels), F.col("h"), F.col("w")).alias("shape"), F.col("p.v").alias("data"))


def tiles(sizes: DataFrame, tile: int = 1024, overlap: int = 32) -> DataFrame:
    """Overlapping tiles of each image (image_id, w, h): its columns, tx, ty and clipped top-left and bottom-right corners."""
    step = lambda n: F.least(F.lit(tile), F.col(n))
    grid = sizes.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("h") - 1, step("h")))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("w") - 1, step("w"))))
    return grid.select(
        "image_id", "tx", "ty", F.greatest(F.lit(0), F.col("tx") - overlap).alias("x1"), F.greatest(F.lit(0), F.col("ty") - overlap).alias("y1"),
        F.least(F.col("w"), F.col("tx") + step("w") + overlap).alias("x2"), F.least(F.col("h"), F.col("ty") + step("h") + overlap).alias("y2"), "w", "h",
    )


def scaled_rois(rois: DataFrame, scales: tuple[float, ...] = (1.0, 0.75, 0.5)) -> DataFrame:
    """ROIs (roi_id, x, y, w, h, img_w, img_h) on each scale, cut to the scaled image; empty ones go."""
    many = rois.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    at = lambda c: (F.col(c) * F.col("scale")).cast("int")
    cut = many.select("roi_id", "scale", at("x").alias("x"), at("y").alias("y"), F.least(at("w"), at("img_w") - at("x")).alias("w"), F.least(at("h"), at("img_h") - at("y")).alias("h"))
    return cut.filter("w > 0 and h > 0")


def colorize(scores: DataFrame, most: float | None = None, v: str = "score") -> DataFrame:
    """Adds level (0..255) and the blue, green and red of a jet ramp, computed by rule."""
    top = F.lit(most) if most else F.lit(scores.agg(F.max(v)).first()[0] or 1.0)
    level = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / top)) * 255).cast("int")
    ramp = lambda shift: F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * F.col("level") / 255 - shift)))).cast("int")
    return scores.withColumn("level", level).withColumns({"blue": ramp(1.0), "green": ramp(2.0), "red": ramp(3.0)})


def overlay(value, color, alpha: float, score=None, threshold: float = 0.0):
    """Alpha blend; with a threshold only where the score lies above it."""
    mixed = value * (1 - alpha) + color * alpha
    return F.when(score > threshold, mixed).otherwise(value) if score is not None and threshold > 0 else mixed


def heat_blend(score) -> dict:
    """The four-segment blue-cyan-yellow-red ramp over [0, 3] and its opacity."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 3.0))
    seg = F.least(F.floor(t * 4), F.lit(3))
    f = t * 4 - seg
    pick = lambda a, b, c, d: F.when(seg == 0, a).when(seg == 1, b).when(seg == 2, c).otherwise(d)
    one, zero = F.lit(1.0), F.lit(0.0)
    return {
        "red": pick(zero, zero, f, one), "green": pick(f, one, one, 1 - f), "blue": pick(one, 1 - f, zero, zero),
        "alpha": F.least((score * 60).cast("int"), F.lit(180)),
    }


def mask(score, threshold: float):
    return F.when(score > threshold, 255).otherwise(0)


def score_map(nn: DataFrame, patches: DataFrame) -> DataFrame:
    """Distances (id, dist) at their patch places: image_id, layer_idx, row, col, score."""
    return nn.join(patches, nn["id"] == patches["vec_id"]).groupBy("image_id", "layer_idx", F.col("patch_row").alias("row"), F.col("patch_col").alias("col")).agg(F.min("dist").alias("score"))


def anomaly_map(cells: DataFrame, grid_h: int, grid_w: int, out_h: int, out_w: int) -> DataFrame:
    """Each layer's grid upsampled, then the largest layer per pixel, with floor 0."""
    up = resize(cells, grid_h, grid_w, out_h, out_w, keys=("image_id", "layer_idx"), v="score")
    return up.groupBy("image_id", "row", "col").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))


def patch_rows(maps: DataFrame, channels: int, height: int, width: int) -> DataFrame:
    """Feature maps (image_id, layer_idx, data: channel-major) to one vector per place."""
    place = maps.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))))
    vector = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.get("data", c * (height * width) + F.col("p")))
    return place.select("image_id", "layer_idx", F.expr(f"int(p div {width})").alias("patch_row"), F.expr(f"int(p % {width})").alias("patch_col"), vector.alias("features"))
