"""File sources and sinks: image folders, label text, ROI and pipeline JSON, memory-bank files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The image extensions that folder scans accept.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


#: Those of detection datasets, told by case.
DATASET_EXTENSIONS = ("jpg", "jpeg", "png", "bmp")
#: The first bytes of JPEG, PNG, BMP and both kinds of TIFF files, in hexadecimal.
IMAGE_MARKS = ("FFD8FF", "89504E47", "424D", "49492A00", "4D4D002A")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files, not recursive; a missing folder has none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def _extension(path: str = "path"):
    return F.element_at(F.split(path, r"\."), -1)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modification time of a folder's images, without their bytes; not recursive."""
    files = _files(spark, folder).select("path", "length", "modificationTime")
    return files.filter(F.lower(_extension()).isin(*IMAGE_EXTENSIONS)).orderBy("path")


def image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The images' bytes, each with label 0. Files that don't begin as an image does are left out."""
    head = F.hex(F.substring("content", 1, 4))
    readable = F.lit(False)
    for mark in IMAGE_MARKS:
        readable = readable | head.startswith(mark)
    return _files(spark, folder).filter(F.lower(_extension()).isin(*IMAGE_EXTENSIONS) & readable).withColumn("label", F.lit(0))


def large_files(images: DataFrame, mb: int = 100, probe: int = 5) -> bool:
    """Whether one of the first files reaches the size from which features are taken image by image."""
    row = images.select("path", "length").orderBy("path").limit(probe).agg(F.max(F.floor(F.col("length") / 1048576) >= mb)).first()
    return bool(row[0])


def stem(path):
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def parse_label_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Adds cls, cx, cy, w, h; drops lines that don't parse or hold an impossible box."""
    p = F.split(F.trim(F.col(line_col)), r"\s+")
    part = lambda i, t: F.expr(f"try_cast(get(split(trim({line_col}), '\\\\s+'), {i}) as {t})")
    out = lines.withColumns({"cls": part(0, "double").cast("int"), "cx": part(1, "double"), "cy": part(2, "double"), "w": part(3, "double"), "h": part(4, "double")})
    ok = F.col("cls").isNotNull() & (F.size(p) >= 5) & (F.col("w") > 0) & (F.col("h") > 0) & F.col("cx").between(0, 1) & F.col("cy").between(0, 1)
    return out.filter(ok)


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.text(folder).withColumn("stem", stem(F.col("_metadata.file_path")))
    return parse_label_lines(lines)


def detection_dataset(spark: SparkSession, images: str, labels: str | None = None) -> DataFrame:
    """path, stem and boxes array<struct<cls,cx,cy,w,h>> of the images that have a label file of the same stem
    with a valid line in it."""
    found = _files(spark, images).select("path", stem(F.col("path")).alias("stem")).filter(_extension().isin(*DATASET_EXTENSIONS))
    texts = _files(spark, labels or images).filter(_extension() == "txt").select(stem(F.col("path")).alias("stem"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("value"))
    boxes = parse_label_lines(texts).groupBy("stem").agg(F.collect_list(F.struct("cls", "cx", "cy", "w", "h")).alias("boxes"))
    return found.join(boxes, "stem").select("path", "stem", "boxes")


def coco_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The same of a COCO file: boxes are corner and size in pixels there; images without a valid box are dropped."""
    raw = spark.read.option("multiLine", True).json(path)
    images = raw.select(F.explode("images").alias("i")).select("i.id", F.col("i.file_name").alias("path"), F.col("i.width").alias("iw"), F.col("i.height").alias("ih"))
    notes = raw.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("id"), F.col("a.category_id").cast("int").alias("cls"), F.col("a.bbox").cast("array<double>").alias("b"))
    x, y, w, h = (F.get("b", F.lit(i)) for i in range(4))
    box = F.struct("cls", ((x + w / 2) / F.col("iw")).alias("cx"), ((y + h / 2) / F.col("ih")).alias("cy"), (w / F.col("iw")).alias("w"), (h / F.col("ih")).alias("h"))
    boxes = notes.filter((w > 0) & (h > 0)).join(images, "id").select("id", box.alias("b")).groupBy("id").agg(F.collect_list("b").alias("boxes"))
    return images.join(boxes, "id").select("path", stem(F.col("path")).alias("stem"), "boxes")


def image_pixels(spark: SparkSession, data: bytes, width: int, height: int, channels: int = 3, image_id: int = 0) -> DataFrame:
    """One image given as bytes, row by row, as a pixel table."""
    if len(data) != width * height * channels or not data:
        raise ValueError(f"{len(data)} bytes for {width} x {height} x {channels}")
    v = np.frombuffer(data, np.uint8)
    place = np.arange(len(v))
    frame = pd.DataFrame({"image_id": image_id, "row": place // (width * channels), "col": place // channels % width, "ch": place % channels, "v": v.astype(float)})
    return spark.createDataFrame(frame, "image_id long, row int, col int, ch int, v double")


def num_classes(dataset: DataFrame) -> int:
    """The largest class of a dataset's boxes and one."""
    return (dataset.select(F.max(F.array_max(F.transform("boxes", lambda b: b["cls"])))).first()[0] or -1) + 1


def roi_config_json(config: dict) -> str:
    """A configuration as ``parse_roi_config`` reads it: per image, or for many ROIs."""
    rois = [{k: r[k] for k in ("id", "x", "y", "width", "height")} for r in config.get("rois", [])]
    if "roi_source" not in config:
        return json.dumps({"image": config.get("image", ""), "rois": rois}, indent=2)
    out = {"backbone": config["backbone"], "roi_source": config["roi_source"]}
    named = {"fixed": "rois", "per_image_file": "per_image_rois_dir", "per_image_list": "per_image_rois_file"}[config["roi_source"]]
    out[named] = rois if named == "rois" else config.get(named, "")
    return json.dumps(out | {k: config[k] for k in ("train", "inference", "model_dir")}, indent=2)


def image_rois_json(rois: DataFrame) -> DataFrame:
    """(image, json): the per-image ROI file of each image, from rows (image, roi_id, x, y, w, h)."""
    one = F.struct(F.col("roi_id").alias("id"), "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    return rois.groupBy("image").agg(F.sort_array(F.collect_list(one)).alias("rois")).select("image", F.to_json(F.struct("image", "rois")).alias("json"))


#: The defaults of a configuration.
ROI_DEFAULTS = {
    "backbone": {"type": "opencv_dnn", "backend_type": "onnxruntime", "layers": "layer2,layer3", "input_size": 224},
    "train": {"coreset_fraction": 0.1, "max_features": 100_000}, "inference": {"anomaly_threshold": 0.5}, "model_dir": "./models",
}


def parse_roi_config(text: str, path: str = "") -> dict:
    """A per-image ROI file or a multi-ROI configuration, checked, with defaults."""
    raw = json.loads(text)
    for r in raw.get("rois", []):
        if not r.get("id") or r.get("width", 0) <= 0 or r.get("height", 0) <= 0:
            raise ValueError(f"bad ROI {r}")
    if "roi_source" not in raw and "backbone" not in raw:
        return {"image": raw.get("image", path), "rois": raw.get("rois", [])}
    source = raw.get("roi_source", "fixed")
    if source not in ("fixed", "per_image_file", "per_image_list"):
        raise ValueError(f"unknown roi_source {source}")
    if source == "fixed" and not raw.get("rois"):
        raise ValueError("a fixed ROI source needs at least one ROI")
    out = {k: ROI_DEFAULTS[k] | raw.get(k, {}) for k in ("backbone", "train", "inference")}
    out |= {"roi_source": source, "rois": raw.get("rois", []), "model_dir": raw.get("model_dir", ROI_DEFAULTS["model_dir"])}
    return out | {k: raw[k] for k in ("per_image_rois_dir", "per_image_rois_file") if k in raw}


def rois_frame(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(r["id"], int(r["x"]), int(r["y"]), int(r["width"]), int(r["height"])) for r in config["rois"]]
    return spark.createDataFrame(rows, "roi_id string, x int, y int, w int, h int")


#: The marks of a bank file, with and without a version field.
BANK_MAGIC, BANK_MAGIC_LEGACY = 0x50434F56, 0x50434F52


def encode_bank(rows: list[tuple], mean: list[float] | None = None, std: list[float] | None = None) -> bytes:
    """A bank file of (features, layer, row, col)."""
    dim = len(rows[0][0]) if rows else 0
    out = [struct.pack("<IIIIB", BANK_MAGIC, 1, len(rows), dim, mean is not None)]
    if mean is not None:
        out.append(struct.pack(f"<{2 * dim}f", *mean, *std))
    out += [struct.pack(f"<{dim}fiii", *f, a, b, c) for f, a, b, c in rows]
    return b"".join(out)


def decode_bank(data: bytes) -> tuple[pd.DataFrame, list[float] | None, list[float] | None]:
    magic = struct.unpack_from("<I", data)[0]
    if magic == BANK_MAGIC:
        _, _, num, dim, has = struct.unpack_from("<IIIIB", data)
        at = 17
    elif magic == BANK_MAGIC_LEGACY:
        _, num, dim = struct.unpack_from("<III", data)
        has, at = 0, 12
    else:
        raise ValueError("not a bank file")
    mean = std = None
    if has:
        both = np.frombuffer(data, "<f4", 2 * dim, at)
        mean, std, at = both[:dim].tolist(), both[dim:].tolist(), at + 8 * dim
    rec = np.frombuffer(data, np.dtype([("f", "<f4", (dim,)), ("p", "<i4", (3,))]), num, at)
    frame = pd.DataFrame({"features": [x.tolist() for x in rec["f"].reshape(num, dim)], "layer_idx": rec["p"][:, 0], "patch_row": rec["p"][:, 1], "patch_col": rec["p"][:, 2]})
    return frame, mean, std


def bank_files(bank: DataFrame, by: str | None = None, normalize: bool = False) -> DataFrame:
    """(name, content): a bank file per value of ``by``, from rows features, layer_idx, patch_row, patch_col. Banks
    are what a coreset left, so one fits a task. normalize: with the mean and deviation of its rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["layer_idx", "patch_row", "patch_col"], kind="stable")
        rows = list(zip(part["features"], part["layer_idx"], part["patch_row"], part["patch_col"], strict=True))
        v = np.stack(part["features"].to_numpy())
        std = np.sqrt((v.var(0, ddof=1) if len(v) > 1 else np.zeros(v.shape[1])) + 1e-8)
        return pd.DataFrame({"name": [part["name"].iloc[0]], "content": [encode_bank(rows, *((v.mean(0).tolist(), std.tolist()) if normalize else ()))]})

    named = bank.select((F.col(by).cast("string") if by else F.lit("bank")).alias("name"), F.col("features").cast("array<double>").alias("features"), "layer_idx", "patch_row", "patch_col")
    return named.groupBy("name").applyInPandas(run, "name string, content binary")


def write_bank_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, path, bytes) of the files, which tasks write as <folder>/<name>.bin where pyarrow reaches the store.
    A file is written under another name first and then renamed, so a repeated task does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                store, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                store.create_dir(at, recursive=True)
                part = f"{at}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{at}/{name}.bin")
                out.append((name, f"{folder}/{name}.bin", len(content)))
            yield pd.DataFrame(out, columns=["name", "path", "bytes"])

    return files.mapInPandas(run, "name string, path string, bytes long")


def read_banks(spark: SparkSession, folder: str) -> DataFrame:
    """Bank files of a folder as rows, decoded on the executors, one file per row at a time. mean and std are those
    of the file, null where it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                frame, mean, std = decode_bank(content)
                n = len(frame)
                yield frame.assign(path=path, mean=[mean] * n, std=[std] * n)[["path", "features", "layer_idx", "patch_row", "patch_col", "mean", "std"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, features array<double>, layer_idx int, patch_row int, patch_col int, mean array<double>, std array<double>")
