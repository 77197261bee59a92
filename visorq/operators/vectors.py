"""Vector search: exact, clustered and hashed nearest neighbours, coreset sampling, bank training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .blocks import LOTS, grid_search

#: Rows of a file of a stored index.
SUBLIST = 100_000
#: Rows of a coreset's group that one task selects from; a larger group is selected in distributed rounds.
HELD = 20_000
#: Rows that a round takes to the driver, and the rounds after which distances start from the rows again.
ROUND_ROWS, REBASE = 8192, 20


def check_bank(bank: DataFrame, vec: str = "features") -> tuple[int, int]:
    """(rows, dimension); an empty bank, dimension 0 or mixed dimensions are errors."""
    row = bank.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if not row["n"] or row["a"] != row["b"] or row["a"] <= 0:
        raise ValueError(f"bank of {row['n']} rows with dimensions {row['a']} to {row['b']}")
    return row["n"], row["b"]


def _keyed(rows: DataFrame, name: str, id_col: str, vec: str, group) -> DataFrame:
    return rows.select(group.cast("string").alias("g"), F.col(id_col).cast("long").alias(name), F.col(vec).cast("array<double>").alias("v"))


def check_queries(queries: DataFrame, dim: int, vec: str = "features") -> None:
    """Queries of another dimension than the bank's are an error."""
    row = queries.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if row["a"] is not None and (row["a"] != dim or row["b"] != dim):
        raise ValueError(f"queries of dimension {row['a']} to {row['b']} for a bank of dimension {dim}")


def nn_exact(queries: DataFrame, bank: DataFrame, id_col: str = "vec_id", vec: str = "features", k: int = 1, skip_self: bool = False, checked: bool = False, block_bytes: int | None = None) -> DataFrame:
    """id, rank, nn_id, dist: the k nearest bank rows, ties to the lowest id. skip_self: not the row itself.
    checked: the queries' dimension is known to be the bank's, which spares computing them once more."""
    _, dim = check_bank(bank, vec)
    if not checked:
        check_queries(queries, dim, vec)
    return grid_search(_keyed(queries, "id", id_col, vec, F.lit("")), _keyed(bank, "b", id_col, vec, F.lit("")), k, skip_self, block_bytes=block_bytes).select("id", "nn_id", "dist", "rank")


def nn_by_group(queries: DataFrame, bank: DataFrame, group: str, id_col: str = "vec_id", vec: str = "features", skip_self: bool = False) -> DataFrame:
    """g, id, nn_id, dist: the nearest bank row of the same group (a bank per ROI); a query without one has no row."""
    lots = LOTS * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grid_search(_keyed(queries, "id", id_col, vec, F.col(group)), _keyed(bank, "b", id_col, vec, F.col(group)), 1, skip_self, lots=lots)
    return found.select(F.col("g").cast(queries.schema[group].dataType).alias("g"), "id", "nn_id", "dist")


def nn_distances(queries: DataFrame, bank: DataFrame, group: str | None = None, id_col: str = "vec_id", vec: str = "features") -> DataFrame:
    """id, dist: each query's distance to the nearest bank row (of its group), exactly.

    Patches of like surfaces are equal in great numbers. Where at most half of the queries differ, distinct vectors are
    searched, on both sides, and a query takes the distance of its vector: the comparisons grow with what differs."""
    by = F.lit("") if group is None else F.col(group)
    q, b = _keyed(queries, "id", id_col, vec, by), _keyed(bank, "b", id_col, vec, by)
    lots = 1 if group is None else LOTS * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, kinds = q.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("g", "v"))).first()
    if 2 * kinds > n:
        return grid_search(q, b, lots=lots).select("id", "dist")
    asked = stored(q.groupBy("g", "v").agg(F.min("id").alias("id")), "asked")
    found = grid_search(asked, stored(b.groupBy("g", "v").agg(F.min("b").alias("b")), "kinds"), lots=lots)
    known = asked.join(found.select("g", "id", "dist"), ["g", "id"]).select("g", "v", "dist")
    return q.join(known, ["g", "v"]).select("id", "dist")


def train_cells(bank: DataFrame, nlist: int = 100, seed: int = 7, id_col: str = "vec_id", vec: str = "features", sample: int = 100_000) -> tuple[np.ndarray, DataFrame]:
    """(centroids, bank rows with list_id): k-means fitted on at most ``sample`` rows by a hash of the id,
    all rows assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n, _ = check_bank(bank, vec)
    fit = bank if n <= sample else bank.filter(F.pmod(F.xxhash64(id_col), F.lit(-(-n // sample))) == 0)
    cells = KMeans(k=min(nlist, n), seed=seed, maxIter=10, featuresCol="mv", predictionCol="list_id").fit(fit.select(array_to_vector(vec).alias("mv")))
    centers = np.array(cells.clusterCenters())
    return centers, in_cells(bank, centers, vec)


def in_cells(bank: DataFrame, centers: np.ndarray, vec: str = "features") -> DataFrame:
    """The rows with list_id, their nearest centroid; ties to the smaller number."""
    return bank.withColumn("list_id", F.get(cells_of(bank.sparkSession, centers)(F.col(vec), F.lit(1)), F.lit(0)))


def cells_of(spark, centers: np.ndarray):
    """A function (vector, n): the n nearest centroids. Centroids (nlist vectors) are sent to all tasks."""
    sent = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def nearest_cells(v: pd.Series, n: pd.Series) -> pd.Series:
        c = sent.value
        x = np.stack(v.to_numpy()).astype(float)
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        return pd.Series([row[: n.iloc[0]] for row in np.argsort(d, axis=1, kind="stable").astype(np.int32)])

    return nearest_cells


def save_index(path: str, centers: np.ndarray, assigned: DataFrame, id_col: str = "vec_id", vec: str = "features") -> None:
    """An index as Parquet: the centroids, and the rows in a folder per list, so that a search reads the lists it probes.
    A long list is written by several tasks, in files of at most ``SUBLIST`` rows."""
    spark = assigned.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_id int, center array<double>").write.mode("overwrite").parquet(f"{path}/centers")
    rows = assigned.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("features"), "list_id")
    per_list = rows.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / SUBLIST).cast("int").alias("subs"))
    dealt = rows.join(F.broadcast(per_list), "list_id").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).drop("subs")
    dealt = dealt.repartition("list_id", "sub").drop("sub").sortWithinPartitions("list_id")
    dealt.write.option("maxRecordsPerFile", SUBLIST).mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")


def load_index(spark, path: str) -> tuple[np.ndarray, DataFrame]:
    """(centroids, rows with list_id) of a stored index; raises where there is none."""
    rows = spark.read.parquet(f"{path}/centers").orderBy("list_id").collect()
    return np.array([r["center"] for r in rows]), spark.read.parquet(f"{path}/lists")


def probed_lists(queries: DataFrame, centers: np.ndarray, assigned: DataFrame, nprobe: int, vec: str = "features") -> tuple[DataFrame, DataFrame]:
    """(queries once per list that they probe, rows of these lists). The lists' numbers, at most nlist, go through the
    driver into the scan, so that a stored index is read no further than that."""
    probe = cells_of(queries.sparkSession, centers)
    asked = queries.withColumn("list_id", F.explode(probe(F.col(vec), F.lit(min(nprobe, len(centers))))))
    some = sorted(r["list_id"] for r in asked.select("list_id").distinct().collect())
    return asked, assigned.filter(F.col("list_id").isin(some))


def search_cells(queries: DataFrame, centers: np.ndarray, assigned: DataFrame, nprobe: int = 16, id_col: str = "vec_id", vec: str = "features", skip_self: bool = False) -> DataFrame:
    """id, nn_id, dist: nearest rows among those of the ``nprobe`` nearest cells; probing all is exact.

    A probe is routed to its list: lists are lots of the block grid, so a list meets the queries that probe it and no
    others, and a long list is cut into blocks."""
    asked, rows = probed_lists(queries, centers, assigned, nprobe, vec)
    of_list = F.col("g").cast("int")
    found = grid_search(_keyed(asked, "id", id_col, vec, F.col("list_id")), _keyed(rows, "b", id_col, vec, F.col("list_id")), 1, skip_self, of_list, max(2, len(centers)))
    return found.groupBy("id").agg(F.min(F.struct("dist", "nn_id")).alias("m")).select("id", "m.nn_id", "m.dist")


def ivf_search(queries: DataFrame, bank: DataFrame, nlist: int = 100, nprobe: int = 16, seed: int = 7, id_col: str = "vec_id", vec: str = "features", skip_self: bool = False) -> DataFrame:
    """Approximate nearest neighbour over k-means cells, trained here; see ``save_index`` for keeping them."""
    centers, assigned = train_cells(bank, nlist, seed, id_col, vec)
    check_queries(queries, centers.shape[1], vec)
    return search_cells(queries, centers, assigned, nprobe, id_col, vec, skip_self)


def check_queries(queries: DataFrame, dim: int, vec: str = "features") -> None:
    """Queries of another dimension than the bank's are an error."""
    row = queries.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if row["a"] is not None and (row["a"] != dim or row["b"] != dim):
        raise ValueError(f"queries of dimension {row['a']} to {row['b']} for a bank of dimension {dim}")


def lsh_search(queries: DataFrame, bank: DataFrame, width: float = 4.0, tables: int = 8, seed: int = 7, id_col: str = "vec_id", vec: str = "features", skip_self: bool = False) -> DataFrame:
    """Random-projection buckets, exact distances inside; promises recall only. A query that no bucket answers is
    searched exactly, so none is lost."""
    _, dim = check_bank(bank, vec)
    check_queries(queries, dim, vec)
    spark = queries.sparkSession
    lines = np.random.default_rng(seed).normal(size=(tables, dim))
    sent = spark.sparkContext.broadcast(lines / np.linalg.norm(lines, axis=1, keepdims=True))

    @F.pandas_udf("array<string>")
    def buckets(v: pd.Series) -> pd.Series:
        at = np.floor(np.stack(v.to_numpy()).astype(float) @ sent.value.T / width).astype(np.int64)
        return pd.Series([[f"{t}:{b}" for t, b in enumerate(row)] for row in at])

    q, b = (x.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("features")) for x in (queries, bank))
    dealt = lambda x: x.withColumn("bucket", F.explode(buckets("features")))
    found = nn_by_group(dealt(q), dealt(b), "bucket", skip_self=skip_self)
    found = found.groupBy("id").agg(F.min(F.struct("dist", "nn_id")).alias("m")).select("id", "m.nn_id", "m.dist")
    lost = q.join(found.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")
    return found.unionByName(nn_exact(lost, b, skip_self=skip_self).select("id", "nn_id", "dist"))


def search(
    queries: DataFrame, bank: DataFrame, algorithm: str = "brute_force", index_path: str | None = None, nlist: int = 100, nprobe: int = 16, skip_self: bool = False,
    checked: bool = False,
) -> DataFrame:
    """id, nn_id, dist by the named algorithm, in any case: brute_force, ivf, hnsw (a proximity graph) or lsh; any other
    name is brute force. For ivf and hnsw an index at ``index_path`` is loaded; where there is none it is trained and
    stored there; where ivf's training fails, the search is by brute force."""
    name = algorithm.lower()
    if name == "lsh":
        return lsh_search(queries, bank, skip_self=skip_self)
    if name == "hnsw":
        from pyspark.errors import PySparkException

        from . import graph

        check_bank(bank)
        try:
            made = graph.load(queries.sparkSession, index_path) if index_path else graph.build(bank)
        except PySparkException:  # no stored graph yet
            made = graph.build(bank)
            graph.save(index_path, *made)
        return graph.search(queries, *made, skip_self=skip_self).drop("compared")
    if name == "ivf":
        from pyspark.errors import PySparkException

        try:
            centers, assigned = load_index(queries.sparkSession, index_path) if index_path else train_cells(bank, nlist)
            return search_cells(queries, centers, assigned, nprobe, skip_self=skip_self)
        except (PySparkException, ValueError):
            try:
                centers, assigned = train_cells(bank, nlist)
                if index_path:
                    save_index(index_path, centers, assigned)
                return search_cells(queries, centers, assigned, nprobe, skip_self=skip_self)
            except (PySparkException, ValueError):
                pass
    return nn_exact(queries, bank, skip_self=skip_self, checked=checked).select("id", "nn_id", "dist")


def greedy_coreset(v: np.ndarray, target: int) -> list[int]:
    """Farthest-point order: first the largest norm, then always the row farthest from all chosen; first on ties."""
    n = len(v)
    if target >= n:
        return list(range(n))
    if target <= 0:
        return []
    chosen = [int(np.argmax((v * v).sum(1)))]
    nearest = ((v - v[chosen[0]]) ** 2).sum(1)
    while len(chosen) < target:
        nearest[chosen[-1]] = -1
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((v - v[chosen[-1]]) ** 2).sum(1))
    return chosen


def _lower(v: np.ndarray, near: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the nearest centre, at most ``near``; in slices that fit a core's cache."""
    near = near.copy()
    for i in range(0, len(v), 512):
        part, at = v[i : i + 512], near[i : i + 512]
        for c in centres:
            np.minimum(at, ((part - c) ** 2).sum(1), out=at)
    return near


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _state(rows: DataFrame, ids: list[int], centres: np.ndarray) -> DataFrame:
    """id, v, near: rows with their squared distance to the nearest centre; -1 for the centres themselves."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, c = sent.value
        for batch in batches:
            if batch.num_rows:
                near = _lower(_matrix(batch), batch.column("near").to_numpy(), c)
                near[np.isin(batch.column("id").to_numpy(), own)] = -1
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(near)], names=["id", "v", "near"])

    return rows.mapInArrow(run, "id long, v array<double>, near double")


def _farthest(state: DataFrame, most: int, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(ids, near, vectors, bound): the ``most`` farthest rows of each partition, sorted by id. No other row
    comes before ``bound`` = (near, -id) in the order of selection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, more = None, False
        for batch in batches:
            best = pa.Table.from_batches([batch]) if best is None else pa.concat_tables([best, pa.Table.from_batches([batch])])
            if len(best) > most:
                order = np.lexsort((best["id"].to_numpy(), -best["near"].to_numpy()))[:most]
                best, more = best.take(pa.array(order)), True
        if best is not None and len(best):
            last = np.zeros(len(best), bool)
            last[-1] = more
            yield from best.append_column("last", pa.array(last)).combine_chunks().to_batches()

    # a round's candidates are what goes to the driver: as floats where the rows are
    kind = "array<float>" if single else "array<double>"
    held = state.mapInArrow(run, "id long, v array<double>, near double, last boolean").withColumn("v", F.col("v").cast(kind)).toArrow().sort_by("id").combine_chunks()
    ids, near = held["id"].to_numpy(), held["near"].to_numpy().copy()
    last = np.flatnonzero(held["last"].to_numpy())
    bound = max(((near[i], -ids[i]) for i in last), default=(-np.inf, 0))
    return ids, near, np.concatenate([_matrix(b).astype(float) for b in held.to_batches()]), bound


def _greedy_rounds(rows: DataFrame, want: int) -> list[int]:
    """Ids in the order of ``greedy_coreset`` over rows (id, v) of any number; want is below that number.

    Each round takes the farthest rows of every partition to the driver, which selects among them for as
    long as no other row can come before; distances only fall, so the order is exact. The new centres are
    then sent to all rows. The distances start anew from the rows every REBASE rounds, which bounds the lineage.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = rows.select("id", "v", F.lit(float("inf")).alias("near")).repartition(parts, "id").persist()
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    first, single = base.agg(F.max(norm), F.bool_and(F.col("v").eqNullSafe(F.col("v").cast("array<float>").cast("array<double>")))).first()
    # Spark adds in another order than numpy: rows within rounding of the largest norm are compared by numpy
    heads = base.filter(norm >= F.lit(first * (1 - 1e-9))).select("id", "v").toArrow().sort_by("id").combine_chunks()
    v = np.concatenate([_matrix(b) for b in heads.to_batches()])
    at = int(np.argmax((v * v).sum(1)))
    picked, centres, new = [heads["id"][at].as_py()], [v[at]], 1
    state, rounds = None, 0
    while len(picked) < want:
        last, rounds = state, rounds + 1
        start, since = (base, 0) if last is None or rounds % REBASE == 0 else (last, len(picked) - new)
        state = _state(start, picked[since:], np.stack(centres[since:])).persist()
        ids, near, v, bound = _farthest(state, max(8, ROUND_ROWS // parts), single)
        if last is not None:
            last.unpersist()
        new = 0
        while len(picked) < want:
            i = int(np.argmax(near))
            if (near[i], -ids[i]) < bound:
                break
            picked.append(int(ids[i]))
            centres.append(v[i])
            near[i] = -1
            near, new = np.minimum(near, ((v - v[i]) ** 2).sum(1)), new + 1
    for held in (state, base):
        if held is not None:
            held.unpersist()
    return picked


_LOT = 1 << 31


def hash_sample(rows: DataFrame, most: int, id_col: str, by: str | None = None) -> DataFrame:
    """The first ``most`` rows by a hash of the id, of each ``by``. Rows that surely come later, by their hash and the
    number of rows, are dropped before anything is sorted; where that leaves too few, all are sorted."""
    place = F.pmod(F.xxhash64(id_col), F.lit(_LOT))
    keys = [by] if by else []
    counts = {(r[by] if by else None): r["n"] for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()}
    if not counts:
        return rows
    edge = lambda n: int(min(1.0, (most + 8 * most**0.5 + 100) / n) * _LOT)
    out, large = [], F.lit(False)
    for key, n in counts.items():  # groups beyond the limit, few
        own = F.col(by).eqNullSafe(F.lit(key)) if by else F.lit(True)
        large = large | own
        likely = rows.filter(own & (place < edge(n)))
        if likely.count() < most:
            likely = rows.filter(own)
        out.append(likely.orderBy(place, id_col).limit(most))
    return reduce(DataFrame.unionAll, out, rows.filter(~large))


def coreset(pool: DataFrame, target: int | float, group: str | None = None, id_col: str = "vec_id", vec: str = "features", most: int | None = None) -> DataFrame:
    """g, step, id: the greedy coreset of each group; target is a count or a fraction of the whole group.

    A group of up to HELD rows is selected by one task, a larger one by distributed rounds with the same
    result. ``most`` is the fast sampler's limit: groups are first cut to so many rows by a hash of the id.
    """
    rows = pool.select((F.col(group).cast("string") if group else F.lit("all")).alias("g"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    if most is not None:
        rows = hash_sample(rows, most, "id", "g")

    def wanted(n: int) -> int:
        return target if isinstance(target, int) else max(1, int(n * target))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        picked = greedy_coreset(np.stack(part["v"].to_numpy()), wanted(len(part)))
        return pd.DataFrame({"g": part["g"].iloc[0], "step": range(len(picked)), "id": part["id"].to_numpy()[picked]})

    schema = "g string, step int, id long"
    small, parts = rows, []
    for g, n in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD).collect():
        own = F.col("g").eqNullSafe(F.lit(g))
        mine, small, want = rows.filter(own), small.filter(~own), wanted(n)
        if want >= n:
            numbered = mine.select("id").sort("id").rdd.zipWithIndex().map(lambda x, g=g: (g, x[1], x[0][0]))
            parts.append(pool.sparkSession.createDataFrame(numbered, schema))
        elif want > 0:
            picked = _greedy_rounds(mine.select("id", "v"), want)
            parts.append(pool.sparkSession.createDataFrame([(g, i, x) for i, x in enumerate(picked)], schema))
    return reduce(DataFrame.unionAll, parts, small.groupBy("g").applyInPandas(run, schema))


def norm_params(pool: DataFrame, vec: str = "features") -> DataFrame:
    """Per dimension: mean and sqrt(sample variance + 1e-8)."""
    dims = pool.select(F.posexplode(vec).alias("dim", "x"))
    return dims.groupBy("dim").agg(F.avg("x").alias("mean"), F.sqrt(F.coalesce(F.var_samp("x"), F.lit(0.0)) + 1e-8).alias("std"))


def train_bank(pool: DataFrame, fraction: float = 0.1, max_features: int | None = 100_000, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bank rows, normalisation): hash-sample to max_features (None: all rows), greedy coreset, statistics."""
    capped = pool if max_features is None else hash_sample(pool, max_features, "vec_id")
    picked = coreset(capped, fraction, group)
    return capped.join(picked.select(F.col("id").alias("vec_id"), "g", "step"), "vec_id"), norm_params(capped)
