"""Anomaly inspection in one call: views of images (tiles, scales, ROIs), features, neighbours, maps, verdicts.

Images are packed blocks (``raster``) or long pixel tables (image_id, row, col, ch, v), which are packed first. A view is a
rectangle of an image on one scale. A backbone turns the pixels of a view into patch vectors; distances to the bank's
nearest rows become a map per view, and maps are fused by their maximum, with floor 0, at their places in the image.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import evaluate, imaging, raster, vectors
from .raster import image_sizes

#: A backbone: a view's pixels (h x w x channels) to one array (side x side x features) per layer, where a patch of NaN
#: is left out. ``grids`` holds the layers' sides.
Backbone = Callable[[np.ndarray], list[np.ndarray]]
#: The scales of the image pyramid, and the overlap of tiles in pixels.
SCALES, OVERLAP = (1.0, 0.75, 0.5), 32


@lru_cache(4096)
def _parts(n: int, grid: int) -> np.ndarray:
    """grid x n: which of n pixels fall into which of the cells."""
    return (np.arange(grid)[:, None] == np.arange(n) * grid // n).astype(float)


def statistics_backbone(grids: tuple[int, ...] = (4, 2)) -> Backbone:
    """A deterministic stand-in for a network: per layer a grid of patches with the mean of each channel."""

    def extract(view: np.ndarray) -> list[np.ndarray]:
        h, w, c = view.shape
        out = []
        for g in grids:
            rows, cols = _parts(h, g), _parts(w, g)
            many = np.outer(rows.sum(1), cols.sum(1))[:, :, None]
            total = cols @ (rows @ view.reshape(h, w * c)).reshape(g, w, c)
            out.append(np.where(many > 0, total / np.maximum(many, 1), np.nan))
        return out

    extract.grids = grids
    return extract


def tile_views(sizes: DataFrame, max_tile: int = 1024, multi_scale: bool = False, overlap: int = OVERLAP) -> DataFrame:
    """image_id, view, scale, x, y, w, h (in the scaled image), to_x, to_y, to_w, to_h (in the image), img_w, img_h, tag.

    Images larger than ``max_tile`` (0: none) are cut into tiles; with ``multi_scale`` each tile, or the whole
    image, is seen on the smaller scales as well. Tiles that are empty on a scale go."""
    large = (F.col("w") > max_tile) | (F.col("h") > max_tile) if max_tile > 0 else F.lit(False)
    tiled = imaging.tiles(sizes.filter(large), max_tile, overlap) if max_tile > 0 else None
    size = (F.col("w").alias("img_w"), F.col("h").alias("img_h"))
    rects = sizes.filter(~large).select("image_id", *(F.lit(0).alias(c) for c in ("x1", "y1")), F.col("w").alias("x2"), F.col("h").alias("y2"), *size)
    if tiled is not None:
        rects = rects.unionByName(tiled.select("image_id", "x1", "y1", "x2", "y2", *size))
    scales = SCALES if multi_scale else SCALES[:1]
    each = rects.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    cut = lambda c: F.floor(c * F.col("scale")).cast("int")
    scaled = lambda n: F.bround(F.col(n) * F.col("scale")).cast("int")
    x, y = cut(F.col("x1")), cut(F.col("y1"))
    # a whole image is resized to its scaled size, a tile is cut from the scaled image
    full = (F.col("x1") == 0) & (F.col("y1") == 0) & (F.col("x2") == F.col("img_w")) & (F.col("y2") == F.col("img_h"))
    w = F.when(full, scaled("img_w")).otherwise(F.least(cut(F.col("x2") - F.col("x1")), scaled("img_w") - x))
    h = F.when(full, scaled("img_h")).otherwise(F.least(cut(F.col("y2") - F.col("y1")), scaled("img_h") - y))
    rows = each.select(
        "image_id", "scale", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.col("x1").alias("to_x"), F.col("y1").alias("to_y"),
        (F.col("x2") - F.col("x1")).alias("to_w"), (F.col("y2") - F.col("y1")).alias("to_h"),
        "img_w", "img_h", F.lit(None).cast("string").alias("tag"),
    ).filter("w > 0 and h > 0")
    return _numbered(rows, ["scale", "to_y", "to_x"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds view, the row's number in its image."""
    from pyspark.sql import Window

    return rows.withColumn("view", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)) - 1)


class Numbering:
    """Numbers of patches made of their places, and back."""

    def __init__(self, views: DataFrame, grids: tuple[int, ...]):
        self.views = (views.agg(F.max("view")).first()[0] or 0) + 1
        self.layers, self.side = len(grids), max(grids)

    def number(self, patches: DataFrame) -> DataFrame:
        """Adds vec_id."""
        at = (F.col("image_id").cast("long") * self.views + F.col("view")) * self.layers + F.col("layer_idx")
        return patches.withColumn("vec_id", ((at * self.side + F.col("patch_row")) * self.side + F.col("patch_col")).cast("long"))

    def places(self, found: DataFrame) -> DataFrame:
        """image_id, view, layer_idx, patch_row, patch_col, dist of (id, dist)."""
        rest, cols = "id", []
        for name, n in (("patch_col", self.side), ("patch_row", self.side), ("layer_idx", self.layers), ("view", self.views)):
            cols.append(F.expr(f"int(pmod({rest}, {n}))").alias(name))
            rest = f"(({rest} - pmod({rest}, {n})) div {n})"  # whole numbers throughout: a double has too few digits
        return found.select(F.expr(rest).alias("image_id"), *reversed(cols), "dist")


def verdicts(scores: DataFrame, threshold: float) -> DataFrame:
    """image_id, anomaly_score, the largest score, and is_anomaly, strictly above the threshold."""
    return scores.groupBy("image_id").agg(F.max("score").alias("anomaly_score")).withColumn("is_anomaly", F.col("anomaly_score") > threshold)


def blocks_of(images: DataFrame) -> DataFrame:
    """The images as stored blocks, which every later step reads; blocks stay as they are."""
    return images if "data" in images.columns else stored(raster.pack(images), "blocks")


def extract(images: DataFrame, views: DataFrame, backbone: Backbone, numbers: Numbering | None = None) -> DataFrame:
    """vec_id, image_id, view, tag, layer_idx, patch_row, patch_col, features: the views' patches."""
    names = ("image_id", "view", "tag", "layer_idx", "patch_row", "patch_col", "features")
    schema = "image_id long, view int, tag string, layer_idx int, patch_row int, patch_col int, features array<double>"

    def patches_of(views: Iterator[tuple[dict, np.ndarray]]) -> Iterator[list[np.ndarray]]:
        for view, pixels in views:
            for layer, a in enumerate(backbone(pixels)):
                row, col = np.nonzero(~np.isnan(a).any(2))
                same = np.full(len(row), 1)
                yield [same * view["image_id"], same * view["view"], np.full(len(row), view["tag"], object), same * layer, row, col, a[row, col]]

    def kernel(views: Iterator[tuple[dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # layers may have features of different lengths; a batch holds many views of one length
        for width, run in groupby(patches_of(views), lambda x: x[-1].shape[1]):
            while held := list(_upto(run, 200_000)):
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                features = pa.ListArray.from_arrays(pa.array(np.arange(len(cols[0]) + 1, dtype=np.int32) * width), pa.array(cols[-1].ravel()))
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([*(pa.array(c.tolist() if k == pa.string() else c.astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds)), features], names=[*names])

    patches = raster.map_views(blocks_of(images), raster.source_rectangle(views), kernel, schema)
    return (numbers or Numbering(views, backbone.grids)).number(patches)


def _upto(parts: Iterator[list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """The next parts of an iterator, until they hold ``most`` numbers."""
    size = 0
    for x in parts:
        yield x
        size += x[-1].size
        if size >= most:
            return


def patchcore_scores(images: DataFrame, bank: DataFrame, backbone: Backbone | None = None, params: dict | None = None, maps: bool = False) -> DataFrame:
    """Scores of the images' views (``raster.view_scores``), by the PatchCore node's parameters.

    bank: vec_id, features. params, with their defaults: search_algorithm brute_force, faiss_nlist 100, faiss_nprobe
    16, index_path (none), max_tile_size 1024 (0: no tiles), multi_scale 0, overlap 32."""
    params, backbone = params or {}, backbone or statistics_backbone()
    tile, overlap = int(params.get("max_tile_size", 1024)), int(params.get("overlap", OVERLAP))
    blocks = blocks_of(images)
    views = stored(tile_views(image_sizes(blocks), tile, bool(int(params.get("multi_scale", 0))), overlap), "views")
    numbers = Numbering(views, backbone.grids)
    patches = stored(extract(blocks, views, backbone, numbers), "patches")
    algorithm, path = str(params.get("search_algorithm", "brute_force")), params.get("index_path")
    if algorithm.lower() not in ("lsh", "hnsw", "ivf"):  # any other name is brute force
        vectors.check_bank(bank)
        return raster.view_scores(numbers.places(vectors.nn_distances(patches, bank)), views, backbone.grids, maps)
    found = vectors.search(patches, bank, algorithm, path, int(params.get("faiss_nlist", 100)), int(params.get("faiss_nprobe", 16)), checked=True)
    return raster.view_scores(numbers.places(found), views, backbone.grids, maps)


def patchcore_map(images: DataFrame, bank: DataFrame, backbone: Backbone | None = None, params: dict | None = None) -> DataFrame:
    """The PatchCore node's map: image_id, row, col, score. ``raster.fuse`` has it as blocks."""
    return raster.unpack(raster.fuse(patchcore_scores(images, bank, backbone, params, maps=True)), "score").drop("ch")


def patchcore(pixels: DataFrame, bank: DataFrame, threshold: float | None = None, sidecar: str | None = None, backbone: Backbone | None = None, params: dict | None = None) -> DataFrame:
    """The PatchCore node's verdicts: image_id, anomaly_score, is_anomaly. The threshold given goes before that
    of the sidecar file, and 0.5 is taken where there is neither."""
    if threshold is None:
        threshold = read_threshold(pixels.sparkSession, sidecar) if sidecar else None
    # the largest value of the fused map is the largest of its views
    return verdicts(patchcore_scores(pixels, bank, backbone, params), 0.5 if threshold is None else threshold)


def roi_views(rois: DataFrame, sizes: DataFrame, per_image: bool = False) -> DataFrame:
    """Views of ROIs (roi_id, x, y, w, h; with image_id where each image has its own). Fixed ROIs are joined with
    every image. ROIs that reach beyond the image are left out."""
    each = rois if per_image else sizes.select("image_id").crossJoin(F.broadcast(rois))  # fixed ROIs are one configuration
    placed = each.join(sizes.select("image_id", F.col("w").alias("img_w"), F.col("h").alias("img_h")), "image_id")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("img_w")) & (F.col("y") + F.col("h") <= F.col("img_h"))
    rows = placed.filter(inside).select("image_id", "roi_id", F.lit(1.0).alias("scale"), "x", "y", "w", "h", F.col("x").alias("to_x"), F.col("y").alias("to_y"),
                                         F.col("w").alias("to_w"), F.col("h").alias("to_h"), "img_w", "img_h", F.col("roi_id").cast("string").alias("tag"))
    return _numbered(rows, ["roi_id", "y", "x"])


def multi_roi(pixels: DataFrame, rois: DataFrame, banks: DataFrame, threshold: float = 0.5, backbone: Backbone | None = None, per_image: bool = False) -> DataFrame:
    """The multi-ROI node: image_id, roi_id, score, is_anomaly and the image's any_anomaly.

    banks: roi_id, vec_id, features; a ROI without a bank is an error."""
    backbone = backbone or statistics_backbone()
    missing = rois.select("roi_id").distinct().join(banks.select("roi_id").distinct(), "roi_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no bank for the ROIs {[r['roi_id'] for r in missing]}")
    blocks = blocks_of(pixels)
    views = stored(roi_views(rois, image_sizes(blocks), per_image), "views")
    numbers = Numbering(views, backbone.grids)
    patches = stored(extract(blocks, views, backbone, numbers), "patches")
    found = vectors.nn_distances(patches, banks.withColumn("tag", F.col("roi_id").cast("string")), "tag")
    per = raster.view_scores(numbers.places(found), views, backbone.grids)
    per = per.select("image_id", F.col("tag").cast(rois.schema["roi_id"].dataType).alias("roi_id"), "score", (F.col("score") > threshold).alias("is_anomaly"))
    return per.join(per.groupBy("image_id").agg(F.bool_or("is_anomaly").alias("any_anomaly")), "image_id")


def sampled_images(images: DataFrame, ratio: float, id_col: str = "image_id") -> DataFrame:
    """The first ``ratio`` of the images in a shuffled order that is the same in every run; at least one."""
    n = images.count()
    order: Column = F.xxhash64(id_col)
    return images.orderBy(order, id_col).limit(min(n, max(1, int(n * ratio))))


def train_threshold(scores: DataFrame, method: str = "max_score", sigma: float = 3.0, percentile: float = 99.0) -> dict:
    """The threshold file's contents from the images' scores (column score)."""
    row = evaluate.score_thresholds(scores, "score", sigma, percentile).first()
    n = row["n"] if row is not None else 0
    if not n:
        raise ValueError("no valid scores")
    value = {"max_score": row["thr_max"], "mean_ksigma": row["thr_sigma"], "percentile": row["thr_percentile"]}[method]
    out = {"anomaly_threshold": value, "method": method, "num_samples": n, "score_stats": {"min": row["min_score"], "max": row["thr_max"], "mean": row["mean_score"], "std": row["std_score"]}}
    if method == "mean_ksigma":
        out["threshold_params"] = {"sigma": sigma}
    elif method == "percentile":
        out["threshold_params"] = {"percentile": percentile}
    return out


def train(
    pixels: DataFrame, backbone: Backbone | None = None, fraction: float = 0.1, max_features: int = 100_000, sample_ratio: float = 0.2, method: str = "max_score", **how
) -> tuple[DataFrame, DataFrame, dict]:
    """The trainer: (bank, normalisation, threshold file's contents) of normal images. The bank is a coreset of at most
    ``max_features`` patches; the threshold comes from the scores that a sample of the images get with it."""
    backbone = backbone or statistics_backbone()
    blocks = blocks_of(pixels)
    sizes = image_sizes(blocks)
    patches = stored(extract(blocks, tile_views(sizes, 0), backbone), "patches")
    bank, norm = vectors.train_bank(patches, fraction, max_features)
    seen = blocks.join(sampled_images(sizes, sample_ratio).select("image_id"), "image_id")
    scores = stored(verdicts(patchcore_scores(seen, bank, backbone, {"max_tile_size": 0}), 0.0).withColumnRenamed("anomaly_score", "score"), "scores")
    return bank, norm, train_threshold(scores, method, **how)


def train_rois(pixels: DataFrame, rois: DataFrame, backbone: Backbone | None = None, fraction: float = 0.1, max_features: int = 100_000, per_image: bool = False) -> DataFrame:
    """The ROI trainer: banks (roi_id, vec_id, features), a coreset of each ROI's patches over all images. ROIs beyond
    an image are left out of it."""
    backbone = backbone or statistics_backbone()
    blocks = blocks_of(pixels)
    views = roi_views(rois, image_sizes(blocks), per_image)
    pool = stored(extract(blocks, views, backbone).withColumn("roi_id", F.col("tag").cast(rois.schema["roi_id"].dataType)), "patches")
    pool = vectors.hash_sample(pool, max_features, "vec_id", "roi_id")
    picked = vectors.coreset(pool, fraction, "roi_id").select(F.col("id").alias("vec_id"))
    return pool.join(picked, "vec_id").select("roi_id", "vec_id", "features")


def index_of_banks(spark, folder: str, path: str, nlist: int = 100) -> DataFrame:
    """Bank files turned into a stored index at ``path``, for ``patchcore_map`` with search_algorithm ivf; returns the
    bank's rows (vec_id, features), numbered in the order of their places."""
    from pyspark.sql import Window

    from ..sources.files import read_banks

    order = Window.partitionBy("path").orderBy("layer_idx", "patch_row", "patch_col", "features")
    rows = read_banks(spark, folder).withColumn("own", F.row_number().over(order) - 1)
    first = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    base = first.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per file
    bank = rows.join(F.broadcast(base), "path").select((F.col("base") + F.col("own")).cast("long").alias("vec_id"), "features")
    centers, assigned = vectors.train_cells(bank, nlist)
    vectors.save_index(path, centers, assigned)
    return bank


def write_threshold(spark, path: str, contents: dict) -> None:
    """A threshold file beside a bank, one JSON document, through Spark's own file access."""
    spark.createDataFrame([(json.dumps(contents),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_threshold(spark, path: str) -> float | None:
    """The stored threshold; None where there is no readable file or it holds none."""
    from pyspark.errors import PySparkException

    try:
        raw = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
        return float(raw["anomaly_threshold"])
    except (PySparkException, ValueError, KeyError, TypeError):
        return None
