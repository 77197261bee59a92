"""Inspection tables derived from the standard Parquet tables, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 16
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.expr("vec_id div 16").alias("image_id"), k.cast("int").alias("k"), F.expr("int((vec_id % 16) div 8)").alias("layer_idx"),
        F.expr("int((vec_id % 8) div 4)").alias("patch_row"), (F.col("vec_id") % 4).cast("int").alias("patch_col"),
        F.col("embedding").cast("array<double>").alias("features"), "label",
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal patches, from which banks are trained."""
    return patch_features(spark, sf_dir).filter("label < 8")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What maps are made for: all patches, each against the bank without itself."""
    return patch_features(spark, sf_dir)


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches' query set: every row whose id is divisible by 20, against all rows."""
    return patch_features(spark, sf_dir).filter("vec_id % 20 = 0")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 20 as frame_id", "event_id as det_id", "event_type as label", "least(value / 330, 1.0D) as confidence",
        "double((event_id * 37) % 640) as cx", "double((event_id * 53) % 640) as cy", "double(40 + (event_id * 7) % 80) as w", "double(40 + (event_id * 11) % 80) as h",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("toxic").alias("truth"), (F.col("n_chars") / F.lit(20000.0)).alias("score"))


#: Images of a task, about: their pixels are some 200 times the bytes of the rows that they come from.
IMAGES = 1000


def pixels(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    """(image_id, row, col, ch, v): a small synthetic BGR image per supplier.

    An image's pixels lie in one of as many partitions as the images ask for, so what groups them holds no more for more images."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    ids = ids.repartition(max(spark.sparkContext.defaultParallelism, -(-ids.count() // IMAGES)), "image_id")
    grid = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(side * side * 3 - 1))).alias("p"))
    return grid.selectExpr("image_id", f"p div {side * 3} as row", f"(p div 3) % {side} as col", "p % 3 as ch").selectExpr(
        "image_id", "int(row) as row", "int(col) as col", "int(ch) as ch", "double((image_id * 7 + row * 13 + col * 29 + ch * 5) % 256) as v"
    )
