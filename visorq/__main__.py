"""Command line: run a registered query, a graph, threshold training or an evaluation, and write the result.

python -m visorq query NAME SF_DIR OUT            a named query over the standard tables
python -m visorq graph CONFIG.json IN OUT         a processing graph over a Parquet table
python -m visorq train BANK_IN OUT [FRACTION]     a bank's coreset from rows vec_id, features
python -m visorq threshold SCORES OUT [METHOD]    a threshold file from a table with a column score
python -m visorq evaluate SAMPLES OUT             confusion, best threshold and AUC from truth and score
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, patchcore, vectors
from .plans import pipeline, queries


def _write(result: DataFrame, out: str) -> None:
    result.write.mode("overwrite").parquet(out)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    if len(argv) < 3 or argv[0] not in ("query", "graph", "train", "threshold", "evaluate"):
        print(__doc__)
        return 2
    spark = spark or SparkSession.builder.appName("visorq").getOrCreate()
    command, *args = argv
    if command == "query":
        _write(queries.queries()[args[0]](spark, args[1]), args[2])
    elif command == "graph":
        _write(pipeline.execute(pipeline.parse(Path(args[0]).read_text()), spark.read.parquet(args[1])), args[2])
    elif command == "train":
        bank, norm = vectors.train_bank(spark.read.parquet(args[0]), float(args[2]) if len(args) > 2 else 0.1)
        _write(bank, f"{args[1]}/bank")
        _write(norm, f"{args[1]}/norm")
    elif command == "threshold":
        patchcore.write_threshold(spark, args[1], patchcore.train_threshold(spark.read.parquet(args[0]), *args[2:3]))
    else:
        samples = spark.read.parquet(args[0])
        best = evaluate.best_threshold(samples).first()
        row = evaluate.confusion(samples, best["threshold"]).withColumn("threshold", F.lit(best["threshold"]))
        _write(row.crossJoin(evaluate.auc(samples).select("auc")), args[1])  # one row with one row
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
