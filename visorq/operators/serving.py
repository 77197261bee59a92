"""Serving and training bookkeeping: micro-batches, registry, eviction, batches, stopping, schedules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micro_batches(requests: DataFrame, model: str, ts: str, id_col: str, most: int = 32, delay: str = "1 day") -> DataFrame:
    """Requests by model in batches of at most ``most`` inside each delay window."""
    slot = F.window(F.col(ts).cast("timestamp"), delay)["start"]
    rows = requests.select(F.col(model).alias("model"), slot.alias("slot"), F.col(id_col).alias("request_id"), F.col(ts).alias("ts"))
    order = Window.partitionBy("model", "slot").orderBy("ts", "request_id")
    return rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / most).cast("long"))


def timed_batches(requests: DataFrame, model: str, ts: str, id_col: str, most: int = 32, delay_ms: int = 5) -> DataFrame:
    """model, request_id, ts, batch, size and flush: requests in the batches that a server makes which waits for ``most``
    requests or for ``delay_ms`` after the first one, whichever is sooner, and then takes what there is.

    flush is full or late. A model's queue is one sequence by its nature: its requests are sorted by Spark and pass one
    task in a stream that holds the open batch only. Ties go by id."""
    schema = "model string, request_id long, ts timestamp_ntz, batch long, size int, flush string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the open batch
        number, owner, deadline = 0, None, 0

        def close(flush: str) -> pa.RecordBatch:
            nonlocal held, number
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            n, held = whole.num_rows, []
            same = (pa.array(np.full(n, number)), pa.array(np.full(n, n, np.int32)), pa.array([flush] * n))
            number += 1
            return pa.record_batch([whole.column("model"), whole.column("request_id"), whole.column("ts"), *same], names=["model", "request_id", "ts", "batch", "size", "flush"])

        for rows in batches:
            models, at = rows.column("model").to_pylist(), rows.column("us").to_numpy()
            i = 0
            while i < rows.num_rows:
                if models[i] != owner:
                    if held:
                        yield close("late")
                    owner, number = models[i], 0
                count = sum(x.num_rows for x in held)
                if count and at[i] > deadline:
                    yield close("late")
                    count = 0
                if not count:
                    deadline = at[i] + 1000 * delay_ms
                upto = min(i + most - count, rows.num_rows)
                j = i
                while j < upto and at[j] <= deadline and models[j] == owner:
                    j += 1
                held.append(rows.slice(i, j - i))
                if count + j - i == most:
                    yield close("full")
                i = j
        if held:
            yield close("late")

    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    rows = requests.select(F.col(model).cast("string").alias("model"), F.col(id_col).cast("long").alias("request_id"), F.col(ts).cast("timestamp_ntz").alias("ts"), us.alias("us"))
    return rows.repartition("model").sortWithinPartitions("model", "us", "request_id").mapInArrow(run, schema)


def latest_versions(registry: DataFrame) -> DataFrame:
    """name, version, path of the newest version of each model."""
    return registry.groupBy("name").agg(F.max(F.struct("version", "path")).alias("m")).select("name", "m.version", "m.path")


def lru_evict(slots: DataFrame, need: float, by: str = "group", strict: bool = False) -> DataFrame:
    """The idle slots to evict, oldest first, until ``need`` is freed; eviction runs per group. ``enough``
    says whether the group's idle slots free that much; with ``strict`` it is an error where they don't."""
    idle = slots.filter("ref_count = 0")
    order = Window.partitionBy(by).orderBy("last_used", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = idle.withColumns({"freed": F.sum("vram").over(order), "enough": F.sum("vram").over(Window.partitionBy(by)) >= need}).filter(F.col("freed") - F.col("vram") < need)
    if strict:
        short = F.concat(F.lit("eviction frees too little of the "), F.lit(str(need)), F.lit(" MB asked for"))
        out = out.withColumn("enough", F.when(F.col("enough"), True).otherwise(F.raise_error(short).cast("boolean")))
    return out


def hash_order(id_col: str, seed: int = 12345) -> Column:
    """An order that looks shuffled, the same in every engine: 0 to 2^31 - 1, for ids of any size and sign."""
    return F.pmod(F.pmod(F.col(id_col).cast("long"), F.lit(2147483648)) * 1103515245 + seed, F.lit(2147483648))


def assign_batches(rows: DataFrame, id_col: str, size: int, by: str | None = None, seed: int = 12345, lots: int = 256) -> DataFrame:
    """Position and batch of each row in shuffled order, per group or over the whole table.

    The whole table is cut into ``lots`` ranges of the shuffled order; rows are numbered inside each, and the
    totals of the ranges before, a small table, are added."""
    order = hash_order(id_col, seed)
    if by:
        dealt = rows.withColumn("shard", F.col(by))
        n = F.row_number().over(Window.partitionBy("shard").orderBy(order, id_col)) - 1
        return dealt.withColumns({"pos": n.cast("long"), "batch": F.floor(n / size).cast("long")})
    dealt = rows.withColumn("shard", F.floor(order / F.lit(-(-2147483648 // lots))).cast("int"))
    counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("shard").orderBy(order, id_col)) - 1
    numbered = dealt.withColumn("own", n).join(F.broadcast(base), "shard").withColumn("pos", F.col("base") + F.col("own")).drop("own", "base")
    return numbered.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))


def round_robin(rows: DataFrame, id_col: str, devices: int, by: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(id_col)) - 1
    return rows.withColumn("device", F.pmod(n, F.lit(devices)))


def early_stopping(series: DataFrame, run: str, epoch: str, metric: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """stop_epoch per run: the first epoch with more than ``patience`` epochs since the last improvement.

    The best value only moves by improvements above min_delta, which depends on earlier decisions, so
    each run is folded in order."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(metric).cast("double").alias("m"))))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(a, x):
        better = x["m"] > a["best"] + min_delta
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        return F.struct(F.when(better, x["m"]).otherwise(a["best"]).alias("best"), bad.alias("bad"), F.coalesce(a["stop"], F.when(bad > patience, x["e"])).alias("stop"))

    folded = series.groupBy(F.col(run).alias("run")).agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select("run", F.col("s.stop").alias("stop_epoch"), F.col("s.best").alias("best"))


def warmup_rate(epoch: Column, batches: Column, lr: float, warmup: int = 3, step: int = 100, gamma: float = 0.5) -> Column:
    """Learning rate at an epoch's first batch: linear warm-up, then halved every ``step`` epochs."""
    ramp = F.greatest(F.lit(0.01), (epoch * batches) / (F.lit(warmup) * batches))
    return F.when(epoch < warmup, lr * ramp).otherwise(lr * F.pow(F.lit(gamma), F.floor(epoch / step)))


def device_for(task: Column, mode: Column, has_gpu: Column, free_mb: Column) -> Column:
    """The device rule of the priority modes; training next to inference needs 2048, 6144 and 1024 MB (fixed
    values) free."""
    infer = F.when(mode != "training", "gpu").otherwise("cpu")
    train = F.when(mode == "training", "gpu").when((mode == "balanced") & (free_mb >= 2048 + 6144 + 1024), "gpu").otherwise("cpu")
    return F.when(~has_gpu, "cpu").when(task == "inference", infer).otherwise(train)


def chance(id_col: str, salt: int) -> Column:
    """A number in [0, 1) from an id, the same in every engine."""
    return hash_order(id_col, 12345 + salt * 7919) / F.lit(2147483648.0)


def mosaic_boxes(samples: DataFrame, size: int = 640) -> DataFrame:
    """Boxes of four images at a time around a point of one canvas: mosaic, idx, cls, cx, cy, w, h, and the
    canvas area (x1, y1, x2, y2) that the image fills.

    samples: idx, w, h, boxes array<struct<cls,cx,cy,w,h>> in image fractions. Four images in order make a
    mosaic; its point lies in the middle third, each image is scaled by 0.5 to 1.5, boxes are shifted, cut at the
    canvas and dropped where nothing is left. Of fewer than four images the first is returned as it is."""
    low, high = size // 3, 2 * size // 3
    of_four = samples.withColumns({"mosaic": F.expr("idx div 4"), "q": F.expr("int(idx % 4)")})
    full = of_four.groupBy("mosaic").agg(F.count(F.lit(1)).alias("members"), F.min("idx").alias("head"))
    point = lambda salt: F.floor(low + chance("mosaic", salt) * (high - low + 1)).cast("int")
    rows = of_four.join(full, "mosaic").withColumns({"px": point(1), "py": point(2)})
    new_w, new_h = (F.floor(F.col(c) * (0.5 + chance("idx", 3))).cast("int") for c in ("w", "h"))
    rows = rows.withColumns({"nw": new_w, "nh": new_h}).withColumns({
        "s": F.col("nw") / F.col("w"),
        "x0": F.when(F.col("q") % 2 == 0, F.col("px") - F.col("nw")).otherwise(F.col("px")), "y0": F.when(F.col("q") < 2, F.col("py") - F.col("nh")).otherwise(F.col("py")),
    })
    edge = lambda at, n: (F.greatest(F.lit(0), F.col(at)), F.least(F.lit(size), F.col(at) + F.col(n)))
    (x1, x2), (y1, y2) = edge("x0", "nw"), edge("y0", "nh")
    rows = rows.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    placed = rows.filter("members = 4 and x2 > x1 and y2 > y1").withColumn("b", F.explode("boxes"))
    mid = lambda c, n, at: F.col(f"b.{c}") * F.col(n) * F.col("s") + F.col(at)
    half = lambda c, n: F.col(f"b.{c}") * F.col(n) * F.col("s") / 2
    cut = placed.select(
        "mosaic", "idx", F.col("b.cls").alias("cls"), "x1", "y1", "x2", "y2",
        F.greatest(F.lit(0.0), mid("cx", "w", "x0") - half("w", "w")).alias("l"), F.greatest(F.lit(0.0), mid("cy", "h", "y0") - half("h", "h")).alias("t"),
        F.least(F.lit(float(size)), mid("cx", "w", "x0") + half("w", "w")).alias("r"), F.least(F.lit(float(size)), mid("cy", "h", "y0") + half("h", "h")).alias("u"),
    ).filter("r > l and u > t")
    part = lambda x: x / F.lit(float(size))
    made = cut.select(
        "mosaic", "idx", "cls", part((F.col("l") + F.col("r")) / 2).alias("cx"), part((F.col("t") + F.col("u")) / 2).alias("cy"),
        part(F.col("r") - F.col("l")).alias("w"), part(F.col("u") - F.col("t")).alias("h"), "x1", "y1", "x2", "y2",
    )
    alone = rows.filter("members < 4 and idx = head").withColumn("b", F.explode("boxes"))
    return made.unionByName(alone.select("mosaic", "idx", "b.cls", "b.cx", "b.cy", "b.w", "b.h", F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("w").cast("int").alias("x2"), F.col("h").cast("int").alias("y2")))


def flip_boxes(boxes: DataFrame, id_col: str, share: float = 0.5) -> DataFrame:
    """Boxes with cx in image fractions, mirrored for a share of the ids by chance."""
    return boxes.withColumn("cx", F.when(chance(id_col, 0) < share, 1 - F.col("cx")).otherwise(F.col("cx")))


def hsv_jitter(pixels: DataFrame, id_col: str, h_gain: float = 5.0, s_gain: float = 30.0, v_gain: float = 30.0) -> DataFrame:
    """Pixels (b, g, r in 0..255) with hue shifted and saturation and value scaled by chance per image.

    Hue is in 0..180, saturation and value in 0..255; hue is added to, the others are scaled by 1 + u / 100 and
    cut to 0..255."""
    b, g, r = (F.col(c).cast("double") for c in "bgr")
    most, least = F.greatest(b, g, r), F.least(b, g, r)
    span = most - least
    hue = F.when(span == 0, 0.0).when(most == r, F.pmod(60 * (g - b) / span, F.lit(360.0))).when(most == g, 60 * (b - r) / span + 120).otherwise(60 * (r - g) / span + 240) / 2
    gain = lambda salt, most: (2 * chance(id_col, salt) - 1) * most
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    turned = pixels.withColumns({
        "_h": F.pmod(hue + gain(4, h_gain), F.lit(180.0)), "_s": cut(F.when(most == 0, 0.0).otherwise(255 * span / most) * (1 + gain(5, s_gain) / 100)), "_v": cut(most * (1 + gain(6, v_gain) / 100)),
    })
    sector = F.col("_h") / 30
    f, c = sector - F.floor(sector), F.col("_v") * F.col("_s") / 255
    low, down, up, top = F.col("_v") - c, F.col("_v") - c * f, F.col("_v") - c * (1 - f), F.col("_v")
    pick = lambda *xs: F.element_at(F.array(*xs), F.floor(sector).cast("int") % 6 + 1)
    return turned.withColumns({"r": pick(top, down, low, low, up, top), "g": pick(up, top, top, down, low, low), "b": pick(low, low, up, top, top, down)}).drop("_h", "_s", "_v")


def augment(rows: DataFrame, steps: list) -> DataFrame:
    """The steps, functions of a DataFrame, applied one after the other."""
    for step in steps:
        rows = rows.transform(step)
    return rows


def collate_targets(samples: DataFrame, size: int) -> DataFrame:
    """Rows (batch, batch_idx, cls, cx, cy, w, h) of batches of ``size`` samples in order."""
    return samples.select(F.expr(f"idx div {size}").alias("batch"), F.expr(f"idx % {size}").alias("batch_idx"), F.explode("boxes").alias("b")).select("batch", "batch_idx", "b.*")
