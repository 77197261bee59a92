import datetime
import json
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visorq.operators import backbone, blocks, detect, evaluate, graph, imaging, model, patchcore, raster, serving, spatial, tables, vectors
from visorq.plans import pipeline as P
from visorq.plans import queries as Q
from visorq.sources import bank_source, files
from visorq.sources import tables as T
from visorq.streaming import serving as stream

SF = "/root/testdata/sf0.001"


def test_nearest_takes_lowest_id_on_ties(spark):
    bank = spark.createDataFrame([(i, [float(i % 5), 0.0, 0.0]) for i in range(10)], "vec_id long, features array<double>")
    q = spark.createDataFrame([(0, [3.0, 0.0, 4.0])], "vec_id long, features array<double>")
    assert [tuple(r) for r in vectors.nn_exact(q, bank).select("nn_id", "dist").collect()] == [(3, 4.0)]


def test_nearest_in_blocks(spark, monkeypatch):
    """A grid of 20 bank blocks; groups of which one is a third of the rows."""
    probes, bank = T.probes(spark, SF), T.bank(spark, SF)
    skewed = lambda x: x.withColumn("roi", F.when(F.col("vec_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("vec_id") % 40)))
    run = lambda: (vectors.nn_exact(probes, bank, k=2).orderBy("id", "rank").collect(), vectors.nn_by_group(skewed(probes), skewed(bank), "roi", skip_self=True).orderBy("g", "id").collect())
    whole = run()
    assert len(whole[1]) == probes.count()
    monkeypatch.setattr(blocks, "BLOCK_BYTES", bank.count() * 64 * 8 // 19)
    got = vectors.nn_exact(probes, bank, k=2)
    plan = got._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Window" in plan
    assert run() == whole


def test_blocks_grow_with_the_rows():
    """What a grid ships, in rows, is a few times its rows up to full blocks: here 40 pairs ship under 14 times the rows."""
    for n in (20_000, 100_000, 600_000):
        nb, nq = blocks._shape(n, n, 8, blocks.BLOCK_BYTES, 40)
        assert nb * nq >= 40 and nb * n + nq * n <= 14 * n
    assert blocks._shape(600_000, 30_000, 512, blocks.BLOCK_BYTES, 40) == (20, 2)


@pytest.mark.parametrize("kind", ["float", "offset", "copies", "lattice", "huge", "double"])
def test_nearest_in_tiles(kind, monkeypatch):
    """The search in tiles of singles against all distances in doubles: values far from the origin, copies, many equal distances."""
    monkeypatch.setattr(blocks, "TILE", 50)
    monkeypatch.setattr(blocks, "SLICE", 20)
    monkeypatch.setattr(blocks, "HELD", 700)
    rng = np.random.default_rng(5)
    b = {"float": rng.normal(size=(400, 8)), "offset": 1e4 + rng.normal(size=(400, 8)), "copies": rng.normal(size=(4, 8))[rng.integers(4, size=400)], "lattice": rng.integers(2, size=(400, 8)).astype(float),
         "huge": rng.normal(size=(400, 8)) * 1e18, "double": rng.normal(size=(400, 8)) * 1e-3 + 1 / 3}[kind]
    b = b if kind == "double" else b.astype(np.float32)
    ids = rng.permutation(1000)[:400]
    q, own = b[:90], ids[:90]
    for k, skip in ((1, True), (3, True), (2, False), (500, True)):
        got = [(int(own[i + r]), int(n), float(d)) for i, row, nn, dist in blocks._nearest_tiled(q, own, b, ids, k, skip) for r, n, d in zip(row, nn, dist, strict=True)]
        full = np.sqrt(((q[:, None].astype(float) - b[None].astype(float)) ** 2).sum(2))
        want = [(int(own[r]), i, d) for r in range(90) for d, i in sorted((float(full[r, j]), int(ids[j])) for j in range(400) if not skip or ids[j] != own[r])[:k]]
        assert got == want


def test_lists_of_an_index_are_pruned_and_routed(spark, tmp_path, monkeypatch):
    """A stored index: only probed lists are read, no vectors are broadcast, a long list is cut into files."""
    monkeypatch.setattr(vectors, "SUBLIST", 10)
    q, rows = T.search_queries(spark, SF).filter("vec_id < 60"), T.patch_features(spark, SF)
    path = f"file://{tmp_path}/index"
    centers, assigned = vectors.train_cells(rows, 12)
    vectors.save_index(path, centers, assigned)
    files_of = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "index/lists").glob("list_id=*")]
    assert len(files_of) == 12 and max(files_of) > 1
    kept, lists = vectors.load_index(spark, path)
    asked, read = vectors.probed_lists(q, kept, lists, 2)
    assert 0 < read.select("list_id").distinct().count() <= 6 and read.count() < rows.count()
    got = vectors.search_cells(q, kept, lists, 2, skip_self=True)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan.replace("PartitionFilters: [isnotnull(list_id", "PartitionFilters: [list_id") and "Cartesian" not in plan
    own = {r.vec_id: set(r.l) for r in asked.groupBy("vec_id").agg(F.collect_list("list_id").alias("l")).collect()}
    held = [(r.vec_id, np.array(r.features), r.list_id) for r in lists.collect()]
    for r in got.collect():
        v = next(x for i, x, _ in held if i == r.id)
        assert r.dist == pytest.approx(min(np.sqrt(((v - x) ** 2).sum()) for i, x, c in held if c in own[r.id] and i != r.id))


def test_graph_finds_neighbours_with_fewer_comparisons(spark, tmp_path):
    for sf, share in ((SF, 0.95), ("/root/testdata/sf0.1", 0.6)):
        exact = {r.id: r.dist for r in Q.queries()["nn_exact"](spark, sf).collect()}
        rows = T.patch_features(spark, sf)
        nodes, edges = graph.build(rows)
        most = edges.groupBy("node").count().agg(F.max("count"), F.count("*")).first()
        assert most[0] <= 32 and most[1] == rows.count()
        got = {r.id: r for r in graph.search(T.search_queries(spark, sf), nodes, edges, skip_self=True).collect()}
        assert len(got) == len(exact)
        assert sum(abs(got[i].dist - d) < 5e-5 for i, d in exact.items()) >= 0.95 * len(exact)
        assert sum(r.compared for r in got.values()) < share * len(exact) * rows.count()
    graph.save(f"file://{tmp_path}/graph", nodes, edges)
    again = vectors.search(T.search_queries(spark, sf).limit(20), rows.limit(1), "HNSW", f"file://{tmp_path}/graph", skip_self=True)
    assert {(r.id, r.nn_id) for r in again.collect()} <= {(i, r.nn_id) for i, r in got.items()}


def test_graph_of_few_rows_and_ties(spark):
    rows = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(5)], "vec_id long, features array<double>")
    got = graph.search(rows, *graph.build(rows), skip_self=True)
    assert sorted((r.id, r.nn_id, r.dist) for r in got.collect()) == [(0, 1, 0.0), (1, 0, 0.0), (2, 3, 0.0), (3, 2, 0.0), (4, 2, 1.0)]


def test_nearest_rank_without_all_values_in_one_task(spark):
    rng = np.random.default_rng(3)
    lists = [rng.normal(size=3000).tolist(), [1.0] * 1500 + rng.normal(size=1500).tolist(), [float(2**i) for i in range(-300, 300)], [5.0] * 400, [1.0, None, 3.0, 2.0]]
    for values in lists:
        df, own = spark.createDataFrame([(v,) for v in values], "score double").repartition(3), sorted(v for v in values if v is not None)
        for rank in {1, 2, len(own) // 3 + 1, len(own) // 2, len(own)}:
            if rank:
                assert evaluate.nth_smallest(df, "score", rank, few=40) == own[rank - 1], (rank, len(own))
        assert evaluate.nth_smallest(df, "score", len(own) + 1, few=40) is None
    got = evaluate.score_thresholds(spark.createDataFrame([(v,) for v in lists[0]], "score double"), percent=90.0, few=40).first()
    assert got.thr_percentile == sorted(lists[0])[2699] and got.n == 3000
    assert evaluate.score_thresholds(df.limit(0)).first().thr_percentile is None


def test_model_inputs(spark):
    rng, images = np.random.default_rng(3), {4: (9, 14), 5: (6, 6), 6: (1, 3)}
    pixels = {i: rng.integers(0, 256, (*shape, 3)).astype(float) for i, shape in images.items()}
    rows = [(i, y, x, c, float(a[y, x, c])) for i, a in pixels.items() for y, x, c in np.ndindex(a.shape)]
    blocks = raster.pack(spark.createDataFrame(rows, "image_id long, row int, col int, ch int, v double"), 4)
    got = {r.image_id: r for r in raster.model_inputs(blocks, 6, 4).collect()}
    assert got.keys() == images.keys()

    def at(a, y, x):
        h, w, _ = a.shape
        sy, sx = min(max((y + 0.5) * h / 6 - 0.5, 0), h - 1), min(max((x + 0.5) * w / 6 - 0.5, 0), w - 1)
        y0, x0 = int(sy), int(sx)
        y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - int(sy), sx - int(sx)
        return (a[y0, x0] * (1 - fy) + a[y1, x0] * fy) * (1 - fx) + (a[y0, x1] * (1 - fy) + a[y1, x1] * fy) * fx

    for i, a in pixels.items():
        want = [[[(at(a, y, x)[2 - c] / 255 - (0.485, 0.456, 0.406)[c]) / (0.229, 0.224, 0.225)[c] for x in range(6)] for y in range(6)] for c in range(3)]
        assert got[i].shape == [3, 6, 6] and np.allclose(got[i].data, np.ravel(want))
    assert raster.model_inputs(blocks.filter("image_id < 0"), 6, 4).count() == 0
    grey = raster.pack(spark.createDataFrame([(1, 0, 0, 0, 7.0)], "image_id long, row int, col int, ch int, v double"))
    with pytest.raises(Exception, match="1 channels"):
        raster.model_inputs(grey, 6).collect()


def test_rasters_of_several_blocks(spark, monkeypatch):
    """The node over images that are cut into blocks of 5, 16 and 512 pixels, and views that reach over many of them."""
    rng = np.random.default_rng(4)
    sizes = {1: (23, 17), 2: (5, 5), 3: (1, 9)}
    images = {i: rng.integers(0, 256, (h, w, 3)).astype(float) for i, (h, w) in sizes.items()}
    rows = [(i, y, x, c, float(a[y, x, c])) for i, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1]) for c in range(3)]
    pix = spark.createDataFrame(rows, "image_id long, row int, col int, ch int, v double").repartition(4)
    bank = spark.createDataFrame([(n, rng.integers(0, 256, 3).astype(float).tolist()) for n in range(9)], "vec_id long, features array<double>")
    params = {"max_tile_size": "6", "overlap": "2", "multi_scale": "1"}
    maps = []
    for side in (512, 16, 5):
        blocks = raster.pack(pix, side).cache()
        assert {(r.image_id, r.w, r.h) for r in raster.image_sizes(blocks, side).collect()} == {(i, w, h) for i, (h, w) in sizes.items()}
        assert sorted(map(tuple, raster.unpack(blocks, side=side).collect())) == sorted(rows)
        monkeypatch.setattr(raster, "BLOCK", side)
        for f in ("pack", "unpack", "image_sizes", "map_views", "view_scores"):
            g = getattr(raster, f)
            monkeypatch.setattr(g, "__defaults__", tuple(side if d in (512, 16, 5) and d is g.__defaults__[-1] else d for d in g.__defaults__))
        maps.append({(r.image_id, r.row, r.col): r.score for r in patchcore.patchcore_map(pix, bank, params=params).collect()})
        top = {r.image_id: r.anomaly_score for r in patchcore.patchcore(blocks, bank, 0.0, params=params).collect()}
        assert top == {i: max(v for k, v in maps[-1].items() if k[0] == i) for i in images}
    assert maps[0].keys() == {(i, y, x) for i, (h, w) in sizes.items() for y in range(h) for x in range(w)}
    assert all(abs(m[k] - v) < 1e-9 for m in maps[1:] for k, v in maps[0].items())
    low, high, w = raster.taps(2, 3, 5, 0.5)
    s = np.clip((np.arange(2, 5) + 0.5) * 0.5 - 0.5, 0, 4)
    assert np.allclose(raster.resample(np.arange(25.0).reshape(5, 5), (low, high, w), (low, high, w)), s[:, None] * 5 + s)


def _boxes(spark, n, side, spread, seed=1):
    rng = np.random.default_rng(seed)
    at, size = rng.uniform(0, spread, (n, 2)), rng.uniform(1, side, (n, 2)) * rng.choice([1, 1, 1, 8], (n, 1))
    rows = [(7, i, "cat", float(c), float(x), float(y), float(w), float(h)) for i, ((x, y), (w, h), c) in enumerate(zip(at, size, rng.integers(50, 100, n) / 100, strict=True))]
    return rows, spark.createDataFrame(rows, detect.DET)


def test_overlap_pairs_by_place(spark):
    rows, df = _boxes(spark, 400, 30, 300)
    rows += [(7, 900, "cat", 0.5, 10.0, 10.0, 0.0, 5.0), (7, 901, "dog", 0.5, 10.0, 10.0, 50.0, 50.0), (7, 902, "cat", 0.5, -50.0, -50.0, 40.0, 1000.0)]
    df = spark.createDataFrame(rows, detect.DET)
    got = {(r.id_a, r.id_b): r.iou for r in spatial.overlap_pairs(spatial.with_corners(df)).collect()}
    want = {}
    for f, i, l, _, x, y, w, h in rows:
        for g, j, k, _, u, v, s, t in rows:
            if (f, l) == (g, k) and i < j and w * h > 0 and s * t > 0:
                a, b = min(x + w / 2, u + s / 2) - max(x - w / 2, u - s / 2), min(y + h / 2, v + t / 2) - max(y - h / 2, v - t / 2)
                if a > 0 and b > 0:
                    want[i, j] = a * b / (w * h + s * t - a * b + 1e-6)
    assert got.keys() == want.keys() and len(got) > 1000 and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert spatial.overlap_pairs(spatial.with_corners(df.limit(0))).collect() == []


def test_suppression_in_rounds_is_the_greedy_one(spark):
    for n, side, spread in ((600, 40, 300), (300, 30, 40)):
        _, df = _boxes(spark, n, side, spread, n)
        one = {r.det_id for r in detect.nms(df, 0.3, 0.6).collect()}
        assert {r.det_id for r in detect.nms(df, 0.3, 0.6, crowd=1).collect()} == one and 5 < len(one) < n


def test_suppression_of_fifty_thousand_boxes_in_one_frame(spark):
    rows, df = _boxes(spark, 50_000, 12, 6000)
    got = {r.det_id for r in detect.nms(df, 0.3, 0.0).collect()}
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][3], i))
    box = np.array([(x - w / 2, y - h / 2, x + w / 2, y + h / 2) for *_, x, y, w, h in rows])
    held, kept = {}, set()
    for i in order:  # greedy, with the kept boxes by cells of 100
        x1, y1, x2, y2 = box[i]
        cells = [(a, b) for a in range(int(x1 // 100), int(x2 // 100) + 1) for b in range(int(y1 // 100), int(y2 // 100) + 1)]
        near = box[list({j for c in cells for j in held.get(c, ())})].reshape(-1, 4)
        inter = np.maximum(0, np.minimum(near[:, 2], x2) - np.maximum(near[:, 0], x1)) * np.maximum(0, np.minimum(near[:, 3], y2) - np.maximum(near[:, 1], y1))
        union = (x2 - x1) * (y2 - y1) + (near[:, 2] - near[:, 0]) * (near[:, 3] - near[:, 1]) - inter + 1e-6
        if not (inter / union > 0.3).any():
            kept.add(i)
            for c in cells:
                held.setdefault(c, []).append(i)
    assert got == kept and len(kept) < 50_000


def test_batches_by_size_and_delay(spark, monkeypatch):
    rng, rows = np.random.default_rng(6), []
    for m, n, gap in (("a", 300, 250), ("b", 200, 3000), ("c", 1, 1)):
        us = np.cumsum(rng.integers(0, gap, n))
        us[5:9] = us[min(5, n - 1)]  # ties
        rows += [(m, 1000 * len(m) + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=int(u))) for i, u in enumerate(us)]
    df = spark.createDataFrame(rows, "model string, id long, ts timestamp_ntz").repartition(5)
    want = {}
    for m in "abc":
        own, batch = sorted((t, i) for k, i, t in rows if k == m), 0
        while own:
            end = own[0][0] + datetime.timedelta(milliseconds=5)
            size = min(32, sum(t <= end for t, _ in own))
            want |= {(m, i): (batch, size, "full" if size == 32 else "late") for _, i in own[:size]}
            own, batch = own[size:], batch + 1
    for records in ("10000", "7"):  # batches that reach over Arrow batches
        with_conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        got = {(r.model, r.request_id): (r.batch, r["size"], r.flush) for r in serving.timed_batches(df, "model", "ts", "id").collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_conf)
        assert got == want and {f for *_, f in want.values()} == {"full", "late"}


def test_stream_flushes_at_size_and_at_the_timer(spark, tmp_path):
    """A full queue goes out at once and whole; one that stays short goes out by its timer."""
    put = lambda name, rows: spark.createDataFrame(rows, "model string, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put("first", [("a", i) for i in range(40)] + [("b", i) for i in range(5)])
    source = spark.readStream.schema("model string, id long").parquet(str(tmp_path / "in"))
    out = stream.timed_batches(source, "model", "id", 32, 4000)
    q = out.writeStream.outputMode("append").format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    read = lambda: {(r.model, r.batch): (r.n, r["size"], r.flush) for r in spark.table("batches").groupBy("model", "batch", "size", "flush").agg(F.count("*").alias("n")).collect()}

    def wait(want, most=90):
        end = time.time() + most
        while time.time() < end and read() != want:
            time.sleep(0.3)
        assert read() == want

    wait({("a", 0): (40, 40, "full"), ("b", 0): (5, 5, "late")})
    put("second", [("b", i) for i in range(100, 133)] + [("a", 50)])
    wait({("a", 0): (40, 40, "full"), ("b", 0): (5, 5, "late"), ("b", 1): (33, 33, "full"), ("a", 1): (1, 1, "late")})
    q.stop()


def test_observed_metrics_come_from_one_job(spark):
    graph, source = P.parse(Q.GRAPH), T.detections(spark, SF)
    frame, metrics = P.observed(graph, source)
    frame.write.format("noop").mode("overwrite").save()
    got = {n: (s, r, b, t) for n, s, r, b, t in metrics()}
    assert {n: r for n, (_, r, _, _) in got.items()} == {r.node_id: r.rows for r in P.node_metrics(graph, source).collect()}
    assert all(s == "ok" and b > 20 * r and t >= 0 for s, r, b, t in got.values())


def test_bank_files_are_read_by_ranges(spark, tmp_path):
    bank_source.register(spark)
    rows = [([float(i), i / 4, -1.0], i % 3, i, i * 2) for i in range(257)]
    df = spark.createDataFrame(rows, "features array<double>, layer_idx int, patch_row int, patch_col int").withColumn("other", F.lit("x"))
    put = lambda d, mode, **o: d.write.format("bank").options(path=str(tmp_path / "b"), **o).mode(mode).save()
    read = lambda path=tmp_path / "b", **o: spark.read.format("bank").options(path=str(path), **o).load()
    put(df.coalesce(1), "append")
    got = read(recordsPerPartition=20)
    assert len(list((tmp_path / "b").glob("*.bin"))) == 1 and got.rdd.getNumPartitions() == 13  # one file, several tasks
    key = lambda d: sorted((tuple(r.features), r.layer_idx, r.patch_row, r.patch_col) for r in d.collect())
    whole = sorted((tuple(f), *p) for f, *p in rows)
    assert key(got) == whole == key(files.read_banks(spark, str(tmp_path / "b")))
    put(df.repartition(3), "overwrite", recordsPerFile=50)
    assert key(read()) == whole and len(list((tmp_path / "b").glob("*.bin"))) >= 6
    files.write_bank_files(files.bank_files(df.withColumn("roi", F.lit("r")), "roi", normalize=True), str(tmp_path / "n")).collect()
    normed = read(tmp_path / "n/r.bin", recordsPerPartition=100).collect()
    assert len(normed) == 257 and all(len(r.mean) == len(r.std) == 3 for r in normed)
    with pytest.raises(Exception, match="one length"):
        put(spark.createDataFrame([([1.0], 0, 0, 0), ([1.0, 2.0], 0, 0, 0)], "features array<double>, layer_idx int, patch_row int, patch_col int").coalesce(1), "append")
    assert not [p for p in (tmp_path / "b").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]  # nothing is left of the failed job
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.bin").write_bytes((tmp_path / "n/r.bin").read_bytes()[:-5])
    with pytest.raises(Exception, match="shorter"):
        read(tmp_path / "bad").collect()
    put(df.limit(0), "overwrite")
    assert read().collect() == []


def test_processors_as_table_functions(spark):
    tables.register(spark)
    _, df = _boxes(spark, 300, 40, 200)
    kept = spark.sql("SELECT det_id, label FROM visorq_nms(TABLE({d}) PARTITION BY (frame_id, label) ORDER BY (confidence DESC, det_id), iou => 0.3)", d=df)
    assert {r.det_id for r in kept.collect()} == {r.det_id for r in detect.nms(df, 0.3, 0.0).collect()}
    with pytest.raises(Exception, match="lacks the columns"):
        spark.sql("SELECT * FROM visorq_nms(TABLE({d}))", d=df.drop("cx")).collect()
    cells = spark.createDataFrame([(1, 4, [10.0, 20.0, 30.0, 40.0, 0.5, 2.0], 0.5, 8, 16), (1, 5, [1.0, 2.0, 3.0, 4.0, -3.0, -2.0], 0.5, 8, 16)],
                                  "frame_id long, cell long, data array<double>, scale double, pad_x int, pad_y int")
    got = spark.sql("SELECT * FROM visorq_decode(TABLE({c}), classes => 2, version => 'v5')", c=cells).collect()
    want = detect.decode_v5(cells, 2).collect()
    assert len(got) == 1 and all(g[c] == pytest.approx(want[0][c]) for g in got for c in want[0].asDict())


def test_trained_backbone_sees_texture_that_means_do_not(spark):
    """Filters over all patches, in tiles of any size; and a defect that leaves every channel's mean as it was."""
    rng = np.random.default_rng(8)
    stripes = lambda: np.tile(np.where(np.arange(16) % 2, 200.0, 50.0)[None, :, None], (16, 1, 3)) + rng.normal(0, 2, (16, 16, 3))
    images = {i: stripes() for i in range(12)}
    images[50] = images[0].transpose(1, 0, 2).copy()  # the stripes lie across
    long = lambda ids: spark.createDataFrame([(i, y, x, c, float(images[i][y, x, c])) for i in ids for y in range(16) for x in range(16) for c in range(3)], "image_id long, row int, col int, ch int, v double")
    good = long(range(12))
    n, first, second = backbone.moments(good, 3)
    x = np.concatenate([backbone.windows(images[i], 3).reshape(-1, 27) for i in range(12)])
    assert n == len(x) and np.allclose(first, x.sum(0)) and np.allclose(second, x.T @ x)
    trained = backbone.train_backbone(good)
    _, filters = backbone.filters_of(n, first, second, 8)
    assert np.allclose(((x - x.mean(0)) @ filters).var(0), 1, atol=1e-6)
    blocks = patchcore.blocks_of(good)
    bank = patchcore.extract(blocks, patchcore.tile_views(raster.image_sizes(blocks), 0), trained).select("vec_id", "features")
    seen = long([3, 50])
    score = lambda own, b: {r.image_id: r.anomaly_score for r in patchcore.patchcore(seen, b, 0.5, backbone=own).collect()}
    got = score(trained, bank)
    assert got[3] < 1e-9 < 1.0 < got[50]
    with pytest.raises(ValueError):
        backbone.moments(good.limit(0), 3)


def test_ids_of_any_size(spark):
    ids = spark.createDataFrame([(i,) for i in (-5, 0, 7, 10**10, 2**50, -(2**62))], "id long")
    got = {r.id: r.o for r in ids.select("id", serving.hash_order("id").alias("o")).collect()}
    assert all(0 <= o < 2**31 and o == (i % 2**31 * 1103515245 + 12345) % 2**31 for i, o in got.items())
    numbers = patchcore.Numbering(spark.createDataFrame([(2,)], "view int"), (4, 2))
    places = [(1125899906854969, 2, 1, 3, 1), (2**50, 0, 0, 0, 0), (3, 1, 0, 2, 3)]
    rows = spark.createDataFrame(places, "image_id long, view int, layer_idx int, patch_row int, patch_col int")
    back = numbers.places(numbers.number(rows).select(F.col("vec_id").alias("id"), F.lit(0.5).alias("dist")))
    assert sorted(tuple(r)[:5] for r in back.collect()) == sorted(places)


def test_empty_bank_is_an_error(spark):
    with pytest.raises(ValueError):
        vectors.nn_exact(T.probes(spark, SF), T.bank(spark, SF).limit(0))


def test_queries_of_another_dimension_are_an_error(spark):
    bank = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, features array<double>")
    with pytest.raises(ValueError):
        vectors.nn_exact(T.probes(spark, SF), bank)


def test_hashed_search_loses_no_query(spark):
    bank = spark.createDataFrame([(i, [float(100 * i), 0.0]) for i in range(5)], "vec_id long, features array<double>")
    q = spark.createDataFrame([(9, [30.0, 1e6]), (10, [401.0, 0.0])], "vec_id long, features array<double>")
    assert {r.id: r.nn_id for r in vectors.lsh_search(q, bank, 0.5, 2).collect()} == {9: 0, 10: 4}


def test_search_dispatch_and_stored_index(spark, tmp_path):
    q, rows = T.search_queries(spark, SF), T.patch_features(spark, SF)
    key = lambda df: sorted((r.id, r.nn_id, round(r.dist, 9)) for r in df.collect())
    exact = key(vectors.search(q, rows, "BRUTE_FORCE", skip_self=True))
    assert key(vectors.search(q, rows, "what", skip_self=True)) == exact
    path = f"file://{tmp_path}/index"
    first = key(vectors.search(q, rows, "IVF", path, nlist=8, nprobe=8, skip_self=True))
    assert first == exact
    centers, lists = vectors.load_index(spark, path)
    assert len(centers) == 8 and lists.count() == rows.count()
    # the stored index is what later searches use, whatever the bank given
    assert key(vectors.search(q, rows.limit(1), "ivf", path, nprobe=8, skip_self=True)) == exact
    # an index that can't be trained falls back to brute force
    one = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, features array<double>")
    got = vectors.search(spark.createDataFrame([(2, [3.0, 4.0])], "vec_id long, features array<double>"), one, "ivf", nlist=4)
    assert [(r.nn_id, r.dist) for r in got.collect()] == [(1, 5.0)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["ivf_search", "ivf_stored", "hnsw_substitute"])
def test_registered_search_finds_the_true_neighbour(spark, name, sf):
    exact = {r.id: r.dist for r in Q.queries()["nn_exact"](spark, sf).collect()}
    hits = sum(r.dist == exact[r.id] for r in Q.queries()[name](spark, sf).collect())
    assert hits >= 0.9 * len(exact)


def test_greedy_coreset():
    v = np.array([[0.0, 0], [1, 0], [10, 0], [0, 9], [5, 5]])
    assert vectors.greedy_coreset(v, 3) == [2, 3, 0]
    assert vectors.greedy_coreset(v, 9) == [0, 1, 2, 3, 4] and vectors.greedy_coreset(v, 0) == []


def test_coreset_of_a_large_group_is_whole(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(0, 9, (20_400, 3)).astype(float), rng.normal(0, 30, (100, 3))])
    pool = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, features array<double>")
    got = vectors.coreset(pool, 0.01).orderBy("step").collect()
    assert [r.id for r in got] == vectors.greedy_coreset(v, 205) and [r.step for r in got] == list(range(205))


def test_training_queries_see_all_normal_rows(spark):
    rows = sorted((r.vec_id, r.embedding, r.label) for r in T.table(spark, SF, "embeddings").filter("label < 8").collect())
    v = np.array([r[1] for r in rows], dtype=float)
    for name, col, want in (("coreset", "id", 32), ("train_bank", "vec_id", len(rows) // 10)):
        got = Q.queries()[name](spark, SF).orderBy("step").collect()
        assert [r[col] for r in got] == [rows[i][0] for i in vectors.greedy_coreset(v, want)]
    per = Counter(r[2] for r in rows)
    assert Q.queries()["coreset_per_roi"](spark, SF).count() == sum(max(1, n // 4) for n in per.values())


def test_fast_sample_takes_all_rows_below_its_limit(spark):
    whole = vectors.coreset(T.bank(spark, SF), 16).orderBy("step").collect()
    assert Q.queries()["fast_sample"](spark, SF).orderBy("step").collect() == whole
    ids = [r.id for r in vectors.coreset(T.bank(spark, SF), 200, most=100).collect()]
    assert len(ids) == len(set(ids)) == 100


def test_fast_sample_asks_all_normal_rows(spark, tmp_path):
    """More rows than the fast sampler's former limit of 20,000: the query answers as its SQL, over all of them."""
    n = 26_000
    rows = spark.range(n).selectExpr("id as vec_id", "array(float(id * 7919 % 10007), float(id * 104729 % 10009), float(id * 31 % 997)) as embedding", "int(id % 10) as label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = np.array([i for i in range(n) if i % 10 < 8])
    assert len(ids) > 20_000
    v = np.stack([ids * 7919 % 10007, ids * 104729 % 10009, ids * 31 % 997], axis=1).astype(float)
    got = Q.queries()["fast_sample"](spark, str(tmp_path)).orderBy("step").collect()
    assert [r.id for r in got] == ids[vectors.greedy_coreset(v, 16)].tolist()


def test_distances_of_equal_vectors(spark):
    """3,000 queries of 7 kinds in two groups meet a bank of 2,000 rows of 5 kinds: 12 distinct vectors are searched."""
    vec = lambda i, n: F.array((F.col(i) % n).cast("double"), (F.col(i) % n % 3).cast("double"))
    side = lambda n, kinds: spark.range(n).select(F.col("id").alias("vec_id"), vec("id", kinds).alias("features"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("roi"))
    q, b = side(3000, 7), side(2000, 5)
    for group, plain in ((None, vectors.nn_exact(q, b)), ("roi", vectors.nn_by_group(q, b, "roi"))):
        got = vectors.nn_distances(q, b, group)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select("id", "dist").collect()))
    seen = []
    search = vectors.grid_search
    try:
        vectors.grid_search = lambda x, y, **how: (seen.append((x.count(), y.count())), search(x, y, **how))[1]
        vectors.nn_distances(q, b, "roi").count()
    finally:
        vectors.grid_search = search
    assert seen == [(14, 10)]


def test_bank_of_all_rows_in_rounds(spark, monkeypatch):
    """No sample before the coreset where none is asked for; candidates of rounds go to the driver as floats, same choice."""
    monkeypatch.setattr(vectors, "HELD", 10)
    monkeypatch.setattr(vectors, "ROUND_ROWS", 64)
    seen, farthest = [], vectors._farthest
    monkeypatch.setattr(vectors, "_farthest", lambda state, most, single: (seen.append(single), farthest(state, most, single))[1])
    bank = T.bank(spark, SF)
    rows = sorted((r.vec_id, r.features) for r in bank.collect())
    want = vectors.greedy_coreset(np.array([v for _, v in rows]), max(1, int(len(rows) * 0.1)))
    got = vectors.train_bank(bank, 0.1, max_features=None)[0].orderBy("step").collect()
    assert [r.vec_id for r in got] == [rows[i][0] for i in want] and seen and all(seen)


def test_coreset_rounds_of_groups(spark, monkeypatch):
    bank = T.bank(spark, SF)
    whole = [vectors.coreset(bank, t, g).orderBy("g", "step").collect() for t, g in ((32, None), (0.25, "label"), (10**6, None))]
    monkeypatch.setattr(vectors, "HELD", 10)
    monkeypatch.setattr(vectors, "ROUND_ROWS", 1)
    monkeypatch.setattr(vectors, "REBASE", 3)
    assert [vectors.coreset(bank, t, g).orderBy("g", "step").collect() for t, g in ((32, None), (0.25, "label"), (10**6, None))] == whole


def test_evaluation_of_one_class_and_of_perfect_scores(spark):
    rows = lambda x: spark.createDataFrame(x, "truth int, score double")
    assert evaluate.auc(rows([(1, 0.9), (1, 0.2)])).first().auc == 0.0
    assert evaluate.auc(rows([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])).first().auc == 1.0
    assert evaluate.best_threshold(rows([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])).first().f1 == 1.0
    assert evaluate.best_threshold(rows([(0, 0.2)])).first().threshold == 0.5


def test_suppression_keeps_what_a_suppressed_box_overlaps(spark):
    rows = [(0, 1, "cat", 0.9, 50.0, 50.0, 40.0, 40.0), (0, 2, "cat", 0.8, 65.0, 50.0, 40.0, 40.0), (0, 3, "cat", 0.7, 80.0, 50.0, 40.0, 40.0), (0, 4, "dog", 0.6, 50.0, 50.0, 40.0, 40.0)]
    kept = detect.nms(spark.createDataFrame(rows, detect.DET), 0.3)
    assert sorted(r.det_id for r in kept.collect()) == [1, 3, 4]


def test_average_precision_of_perfect_detections(spark):
    det = T.detections(spark, SF).limit(50)
    truth = det.select("frame_id", F.col("det_id").alias("truth_id"), "label", "cx", "cy", "w", "h")
    assert all(r.ap == 1.0 for r in detect.average_precision(det, truth).collect())


def test_average_precision_in_stretches(spark):
    """Many ties of confidence, stretches of a few rows, two overlaps at once: as a plain loop has it; and no frame of a window
    runs to the end of a label's rows, which takes the square of their number."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(40)), i, "ab"[int(rng.integers(2))], float(rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()])), float(rng.integers(60)), float(rng.integers(60)), 40.0, 40.0) for i in range(900)]
    det = spark.createDataFrame(rows, detect.DET)
    truth = det.filter("det_id % 3 = 0").select("frame_id", F.col("det_id").alias("truth_id"), "label", (F.col("cx") + 4).alias("cx"), "cy", "w", "h")
    got = {(r.label, r.i): r.ap for r in detect.average_precisions(det, truth, (0.5, 0.75), stretch=7).collect()}
    for i, iou in enumerate((0.5, 0.75)):
        hits = {r.det_id for r in detect.matched(det, truth, iou).filter("tp = 1").collect()}
        for label in "ab":
            ranked = [r[1] in hits for r in sorted((r for r in rows if r[2] == label), key=lambda r: (-r[3], r[1]))]
            precision = np.cumsum(ranked) / np.arange(1, len(ranked) + 1)
            top = np.maximum.accumulate(precision[::-1])[::-1]
            assert np.isclose(got[label, i], top[np.array(ranked)].sum() / sum(r[2] == label and r[1] % 3 == 0 for r in rows))
    plan = detect.average_precision(det, truth)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan


def test_upsampling_two_by_two(spark):
    pix = spark.createDataFrame([(0, 0, r, c, float(2 * r + c)) for r in range(2) for c in range(2)], "image_id int, ch int, row int, col int, v double")
    rows = {(r.row, r.col): r.v for r in imaging.resize(pix, 2, 2, 4, 4).collect()}
    assert rows[0, 0] == 0.0 and rows[3, 3] == 3.0 and rows[1, 1] == 0.75 and rows[0, 1] == 0.25


def test_early_stopping(spark):
    s = spark.createDataFrame([("a", i, m) for i, m in enumerate([0.5, 0.45, 0.44, 0.43])], "run string, epoch int, metric double")
    assert serving.early_stopping(s, "run", "epoch", "metric", 2).first().stop_epoch == 3


def test_graph_errors_and_skipping_edges(spark):
    bad = lambda nodes, edges: json.dumps({"pipeline": {"nodes": nodes, "edges": edges}})
    a, b = {"id": "a", "type": "merge"}, {"id": "b", "type": "merge"}
    for text in (bad([a, b], [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]), bad([{"id": "a", "type": "none"}], []), bad([a], [{"from": "a", "to": "c"}]), bad([a, a], [])):
        with pytest.raises(ValueError):
            P.parse(text)
    g = P.parse(bad([a, b, {"id": "c", "type": "merge"}], [{"from": "a", "to": "b"}, {"from": "b", "to": "c"}, {"from": "a", "to": "c"}]))
    assert P.execute(g, spark.range(3)).count() == 6 and P.parse(P.serialize(g)).layers == g.layers


def test_bank_files(spark, tmp_path):
    rows = [([1.0, 2.0], 0, 1, 2), ([3.0, 4.0], 1, 0, 0)]
    (tmp_path / "a.bin").write_bytes(files.encode_bank(rows, [0.5, 0.5], [1.0, 2.0]))
    got = files.read_banks(spark, str(tmp_path)).orderBy("layer_idx").collect()
    assert [(r.features, r.layer_idx, r.patch_row, r.patch_col) for r in got] == rows
    assert files.decode_bank(files.encode_bank(rows, [0.5, 0.5], [1.0, 2.0]))[1:] == ([0.5, 0.5], [1.0, 2.0])
    assert (got[0].mean, got[0].std) == ([0.5, 0.5], [1.0, 2.0])
    frame = spark.createDataFrame([("r1", *rows[0]), ("r2", *rows[1]), ("r1", *rows[1])], "roi string, features array<double>, layer_idx int, patch_row int, patch_col int")
    written = files.write_bank_files(files.bank_files(frame, "roi", normalize=True), str(tmp_path / "out")).orderBy("name").collect()
    assert [r.name for r in written] == ["r1", "r2"] and all(r.bytes > 17 for r in written)
    again = files.read_banks(spark, str(tmp_path / "out")).collect()
    assert sorted((r.path[-6:], r.features, r.layer_idx) for r in again) == [("r1.bin", [1.0, 2.0], 0), ("r1.bin", [3.0, 4.0], 1), ("r2.bin", [3.0, 4.0], 1)]
    assert next(r.mean for r in again if r.path.endswith("r1.bin")) == [2.0, 3.0]


def test_image_lists_and_labels(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.list_images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]
    assert files.list_images(spark, str(tmp_path / "none")).count() == 0 and files.image_folder(spark, str(tmp_path / "none")).count() == 0
    lines = spark.createDataFrame([("0 .5 .5 .2 .2",), ("x 1 1 1 1",), ("1 .5 .5 0 .1",), ("2 1.5 .5 .1 .1",), ("3 .1",), ("4.0 .5 .5 .1 .1",)], "value string")
    assert [r.cls for r in files.parse_label_lines(lines).collect()] == [0, 4]


def test_image_folder_drops_what_is_no_image(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "b.jpg").write_bytes(bytes.fromhex("FFD8FFE000"))
    (tmp_path / "c.bmp").write_bytes(b"not an image")
    (tmp_path / "d.tif").write_bytes(b"")
    assert sorted(r.path[-5:] for r in files.image_folder(spark, str(tmp_path)).collect()) == ["a.png", "b.jpg"]
    images = files.list_images(spark, str(tmp_path))
    assert not files.large_files(images) and files.large_files(images, mb=0)


def test_detection_dataset(spark, tmp_path):
    images, labels = tmp_path / "i", tmp_path / "l"
    images.mkdir()
    labels.mkdir()
    for n in ("a.jpg", "b.png", "c.bmp", "d.JPG", "e.tiff", "f.jpeg"):
        (images / n).write_bytes(b"x")
    for n, t in (("a", "0 .5 .5 .2 .2\n6.0 .1 .1 .1 .1\nbad"), ("b", "1 .5 .5 0 0"), ("c", ""), ("d", "3 .5 .5 .1 .1"), ("e", "3 .5 .5 .1 .1"), ("z", "9 .5 .5 .1 .1")):
        (labels / f"{n}.txt").write_text(t)
    data = files.detection_dataset(spark, str(images), str(labels))
    assert [(r.stem, [b.cls for b in r.boxes]) for r in data.collect()] == [("a", [0, 6])] and files.num_classes(data) == 7


def test_roi_config():
    with pytest.raises(ValueError):
        files.parse_roi_config('{"rois": [{"id": "", "x": 0, "y": 0, "width": 1, "height": 1}]}')
    with pytest.raises(ValueError):
        files.parse_roi_config('{"backbone": {}}')
    assert files.parse_roi_config('{"rois": []}', "p.png")["image"] == "p.png"
    roi = {"id": "a", "x": 1, "y": 2, "width": 3, "height": 4}
    for text in (json.dumps({"image": "p.png", "rois": [roi]}), json.dumps({"roi_source": "fixed", "rois": [roi], "train": {"max_features": 5}})):
        config = files.parse_roi_config(text)
        assert files.parse_roi_config(files.roi_config_json(config)) == config


def test_roi_json_of_images(spark):
    rois = spark.createDataFrame([("p.png", "b", 1, 2, 3, 4), ("p.png", "a", 0, 0, 9, 9)], "image string, roi_id string, x int, y int, w int, h int")
    text = files.image_rois_json(rois).first()["json"]
    assert [r["id"] for r in files.parse_roi_config(text)["rois"]] == ["a", "b"] and json.loads(text)["rois"][1] == {"id": "b", "x": 1, "y": 2, "width": 3, "height": 4}


def flat_image(image_id, h, w, v, spot=None):
    return [(image_id, r, c, ch, 200.0 if spot and abs(r - spot[0]) < 2 and abs(c - spot[1]) < 2 else v) for r in range(h) for c in range(w) for ch in range(3)]


PIXELS = "image_id long, row int, col int, ch int, v double"


def test_patchcore_finds_the_spot(spark):
    bank = spark.createDataFrame([(i, [10.0 + i] * 3) for i in range(3)], "vec_id long, features array<double>")
    pix = spark.createDataFrame(flat_image(1, 12, 20, 11.0) + flat_image(2, 12, 20, 11.0, (3, 15)), PIXELS)
    for params in ({}, {"max_tile_size": 8, "overlap": 2}, {"multi_scale": 1}, {"max_tile_size": "8", "overlap": "2", "multi_scale": "1"}):
        got = {r.image_id: r for r in patchcore.patchcore(pix, bank, 5.0, params=params).collect()}
        assert got[1].anomaly_score < 1e-9 and not got[1].is_anomaly and got[2].is_anomaly
        heat = patchcore.patchcore_map(pix, bank, params=params).collect()
        assert len(heat) == 2 * 12 * 20
        top = max((r for r in heat if r.image_id == 2), key=lambda r: r.score)
        assert abs(top.row - 3) <= 4 and abs(top.col - 15) <= 5


def test_threshold_file(spark, tmp_path):
    bank = spark.createDataFrame([(1, [10.0] * 3)], "vec_id long, features array<double>")
    pix = spark.createDataFrame(flat_image(1, 8, 8, 11.0), PIXELS)
    path = str(tmp_path / "bank.threshold.json")
    assert patchcore.read_threshold(spark, path) is None
    verdict = lambda **kw: patchcore.patchcore(pix, bank, **kw).first().is_anomaly
    assert verdict(sidecar=path)  # sqrt(3) is above 0.5
    scores = spark.createDataFrame([(float(i),) for i in range(1, 11)], "score double")
    made = patchcore.train_threshold(scores, "percentile", percentile=80.0)
    assert (made["anomaly_threshold"], made["num_samples"], made["threshold_params"]) == (8.0, 10, {"percentile": 80.0})
    patchcore.write_threshold(spark, path, made)
    assert patchcore.read_threshold(spark, path) == 8.0 and not verdict(sidecar=path) and verdict(threshold=1.0, sidecar=path)
    images = spark.range(40).withColumnRenamed("id", "image_id")
    assert patchcore.sampled_images(images, 0.25).count() == 10 and patchcore.sampled_images(images, 0.0).count() == 1
    with pytest.raises(ValueError):
        patchcore.train_threshold(scores.limit(0))


def test_multi_roi(spark):
    pix = spark.createDataFrame(flat_image(1, 12, 20, 11.0) + flat_image(2, 12, 20, 11.0, (3, 15)), PIXELS)
    rois = spark.createDataFrame([("l", 0, 0, 8, 8), ("r", 11, 0, 9, 9), ("out", 15, 0, 9, 9)], "roi_id string, x int, y int, w int, h int")
    banks = spark.createDataFrame([("l", 1, [11.0] * 3), ("r", 1, [11.0] * 3), ("out", 1, [11.0] * 3)], "roi_id string, vec_id long, features array<double>")
    got = {(r.image_id, r.roi_id): (r.is_anomaly, r.any_anomaly) for r in patchcore.multi_roi(pix, rois, banks, 5.0).collect()}
    assert got == {(1, "l"): (False, False), (1, "r"): (False, False), (2, "l"): (False, True), (2, "r"): (True, True)}
    own = spark.createDataFrame([(2, "l", 0, 0, 8, 8), (1, "r", -1, 0, 9, 9)], "image_id long, roi_id string, x int, y int, w int, h int")
    assert [(r.image_id, r.roi_id) for r in patchcore.multi_roi(pix, own, banks, 5.0, per_image=True).collect()] == [(2, "l")]
    with pytest.raises(ValueError):
        patchcore.multi_roi(pix, rois, banks.filter("roi_id <> 'r'"))


def test_trainers(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, r, c, ch, float(rng.integers(0, 60))) for i in range(6) for r in range(8) for c in range(8) for ch in range(3)]
    pix = spark.createDataFrame(rows, PIXELS)
    bank, norm, made = patchcore.train(pix, fraction=0.5, sample_ratio=0.5, method="mean_ksigma", sigma=2.0)
    assert bank.count() == 60 and norm.count() == 3 and made["num_samples"] == 3 and made["threshold_params"] == {"sigma": 2.0}
    bad = spark.createDataFrame(flat_image(9, 8, 8, 250.0), PIXELS)
    assert patchcore.patchcore(bad, bank, made["anomaly_threshold"]).first().is_anomaly
    rois = spark.createDataFrame([("l", 0, 0, 4, 8), ("r", 4, 0, 4, 8), ("out", 6, 0, 4, 8)], "roi_id string, x int, y int, w int, h int")
    banks = patchcore.train_rois(pix, rois, fraction=1.0)
    assert sorted((r.roi_id, r["count"]) for r in banks.groupBy("roi_id").count().collect()) == [("l", 120), ("r", 120)]
    assert {r.score for r in patchcore.multi_roi(pix, rois.filter("roi_id <> 'out'"), banks).collect()} == {0.0}
    places = "features", "layer_idx", "patch_row", "patch_col"
    frame = banks.withColumns({"layer_idx": F.lit(0), "patch_row": F.lit(0), "patch_col": F.lit(0)}).select("roi_id", *places)
    files.write_bank_files(files.bank_files(frame, "roi_id"), str(tmp_path / "banks")).collect()
    rows = patchcore.index_of_banks(spark, str(tmp_path / "banks"), f"file://{tmp_path}/index", 8)
    assert sorted(r.vec_id for r in rows.collect()) == list(range(240))
    whole = {r.image_id: r.anomaly_score for r in patchcore.patchcore(pix, rows, 1.0).collect()}
    params = {"search_algorithm": "IVF", "index_path": f"file://{tmp_path}/index", "faiss_nprobe": "8"}
    assert {r.image_id: pytest.approx(r.anomaly_score) for r in patchcore.patchcore(pix, rows, 1.0, params=params).collect()} == whole


def test_nodes_of_graphs(spark, tmp_path):
    pix = spark.createDataFrame(flat_image(1, 8, 8, 11.0), PIXELS)
    spark.createDataFrame([(1, [10.0] * 3)], "vec_id long, features array<double>").write.parquet(str(tmp_path / "bank"))
    one = lambda kind, **params: json.dumps({"pipeline": {"nodes": [{"id": "n", "type": kind, "params": params}]}})
    row = P.execute(P.parse(one("patchcore", memory_bank_path=str(tmp_path / "bank"), anomaly_threshold="3")), pix).first()
    assert row.node_id == "n" and not row.is_anomaly and abs(row.anomaly_score - 3**0.5) < 1e-9
    frames = spark.createDataFrame([(7, [2, 1, 3], [1.0, 2.0, 3.0, 3.0, 4.0, 5.0])], "frame_id long, shape array<int>, data array<double>")
    out = P.execute(P.parse(one("model", model_path="stub")), frames).first().outputs
    assert [(o.shape, o.data) for o in out] == [([1, 3], [2.0, 3.0, 4.0]), ([1, 1], [3.0])]


def test_idle_models_are_kept_up_to_a_limit():
    made = [model.acquire("m", lambda name: object()) for _ in range(6)]
    for x in made:
        model.release("m", x)
    assert len(model._IDLE["m"]) == model.MOST_IDLE and model.acquire("m", lambda name: None) is made[-1]


def test_skipped_nodes_and_profile(spark):
    P.processor("skip_test")(lambda inputs, params: None)
    text = json.dumps({"pipeline": {"nodes": [{"id": "a", "type": "skip_test"}, {"id": "b", "type": "merge"}, {"id": "c", "type": "merge"}, {"id": "d", "type": "merge"}],
                                    "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "c"}, {"from": "d", "to": "c"}]}})
    graph = P.parse(text)
    assert P.execute(graph, spark.range(4)).count() == 4
    rows = {r.node_id: r for r in P.profile(graph, spark.range(4)).collect()}
    assert (rows["a"].status, rows["b"].status, rows["c"].rows, rows["c"].bytes) == ("skip", "skip", 4, 4 * len('{"id":0}'))
    assert abs(rows["total"].latency_ms - rows["c"].latency_ms - rows["d"].latency_ms) < 1e-6
    with pytest.raises(ValueError):
        P.execute(P.parse(json.dumps({"pipeline": {"nodes": [{"id": "a", "type": "skip_test"}]}})), spark.range(1))


def test_composite_node_and_input_limit(spark):
    inner = {"pipeline": {"nodes": [{"id": "x", "type": "filter", "params": {"confidence_threshold": 0.5}}]}}
    text = json.dumps({"pipeline": {"nodes": [{"id": "c", "type": "composite", "params": {"pipeline": inner}}]}})
    rows = spark.createDataFrame([(0.4,), (0.6,)], "confidence double")
    assert [(r.confidence, r.node_id) for r in P.execute(P.parse(text), rows).collect()] == [(0.6, "c")]
    two = {"nodes": [{"id": "a", "type": "merge"}, {"id": "b", "type": "merge"}, {"id": "m", "type": "merge", "params": {"max_inputs": "1"}}], "edges": [{"from": "a", "to": "m"}, {"from": "b", "to": "m"}]}
    with pytest.raises(ValueError):
        P.execute(P.parse(json.dumps({"pipeline": two})), rows)


def test_eviction_that_frees_too_little(spark):
    slots = spark.createDataFrame([("g", "a", 100, 0, 1), ("g", "b", 100, 0, 2), ("g", "c", 100, 1, 0)], "group string, name string, vram long, ref_count int, last_used long")
    assert [r.name for r in serving.lru_evict(slots, 150, strict=True).orderBy("last_used").collect()] == ["a", "b"]
    assert [r.enough for r in serving.lru_evict(slots, 250).collect()] == [False, False]
    with pytest.raises(Exception, match="frees too little"):
        serving.lru_evict(slots, 250, strict=True).collect()


def test_mosaic_of_few_samples_is_the_first(spark):
    box = lambda i: (i, 100, 50, [(i, 0.5, 0.5, 0.2, 0.2)])
    rows = spark.createDataFrame([box(i) for i in range(7)], "idx long, w int, h int, boxes array<struct<cls:int,cx:double,cy:double,w:double,h:double>>")
    got = serving.mosaic_boxes(rows).collect()
    assert [(r.idx, r.cx, r.x2) for r in got if r.mosaic == 1] == [(4, 0.5, 100)]
    assert all(0 <= r.cx - r.w / 2 and r.cx + r.w / 2 <= 1 and r.w > 0 for r in got)


def test_hsv_jitter_and_chain(spark):
    colours = [(1, 10.0, 20.0, 30.0), (1, 200.0, 100.0, 50.0), (1, 0.0, 0.0, 0.0), (1, 90.0, 90.0, 90.0), (1, 5.0, 250.0, 120.0), (1, 120.0, 5.0, 250.0)]
    pix = spark.createDataFrame(colours, "image_id long, b double, g double, r double")
    same = serving.augment(pix, [lambda d: serving.hsv_jitter(d, "image_id", 0, 0, 0), lambda d: d.withColumn("seen", F.lit(1))]).collect()
    assert all(abs(x - y) < 1e-6 for r, c in zip(same, colours) for x, y in zip((r.b, r.g, r.r), c[1:])) and same[0].seen == 1
    other = serving.hsv_jitter(pix, "image_id").collect()
    assert [round(max(r.b, r.g, r.r) / max(c[1:]), 6) for r, c in zip(other, colours) if max(c[1:]) < 150 and max(c[1:])].count(round(max(other[0].b, other[0].g, other[0].r) / 30, 6)) == 2
    assert all(0 <= x <= 255 for r in other for x in (r.b, r.g, r.r))


def test_windowed_counts_of_a_stream(spark, tmp_path):
    events = T.table(spark, SF, "events")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    counted = stream.windowed_counts(stream.request_stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", late="3650 days")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.window.start)[:10], r.event_type): r.requests for r in spark.table("windows").collect()}
    assert got == {(str(r.day)[:10], r.event_type): r.requests for r in Q.queries()["windowed_requests"](spark, SF).collect()}


def test_stream_matches_batch(spark, tmp_path):
    events = T.table(spark, SF, "events")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    requests = stream.request_stream(spark, str(tmp_path / "in"), events.schema, 2)
    q = stream.score_stream(requests, lambda d: d.withColumn("big", F.col("value") > 100), lambda d, i: d.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == events.count() and got.filter("big").count() == events.filter("value > 100").count()


def test_registry_state(spark, tmp_path):
    rows = [("a", "acquire", 1), ("a", "acquire", 2), ("a", "release", 3), ("b", "acquire", 4)]
    log = spark.createDataFrame(rows, "name string, op string, ts long")
    log.write.parquet(str(tmp_path / "log"))
    state = stream.registry_state(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    q = state.writeStream.outputMode("update").format("memory").queryName("registry").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[:3] for r in spark.table("registry").collect()) == [("a", 1, 3), ("b", 1, 4)]


def test_registry_replaces_when_nobody_holds_the_model(spark, tmp_path):
    rows = [("a", "load", 1, None), ("a", "acquire", 2, None), ("a", "replace", 3, None), ("a", "acquire", 4, None), ("a", "release", 5, None), ("b", "load", 1, 7), ("b", "replace", 2, None),
            ("c", "acquire", 1, None), ("d", "load", 1, None), ("d", "unload", 2, None), ("d", "release", 3, None)]
    log = spark.createDataFrame(rows, "name string, op string, ts long, version long")
    log.write.parquet(str(tmp_path / "one"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "one*"))
    q = stream.registry_state(source).writeStream.outputMode("update").format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    now = lambda: {r.name: (r.version, r.waiting, r.ref_count, r.errors) for r in spark.table("versions").collect()}
    assert now() == {"a": (1, 2, 1, 0), "b": (8, 0, 0, 0), "c": (0, 0, 1, 1), "d": (0, 0, 0, 1)}
    q.stop()


def test_engine(spark):
    engine, seen = stream.Engine(2), []
    with pytest.raises(KeyError):
        engine.infer("m", spark.range(2))
    assert engine.load("m", lambda d: d.withColumn("y", F.col("id") + 1)) == 1
    futures = [engine.submit("m", spark.range(n), seen.append) for n in (1, 2, 3)]
    assert [len(f.result(60)) for f in futures] == [1, 2, 3] and sorted(map(len, seen)) == [1, 2, 3]
    assert engine.load("m", lambda d: d.withColumn("y", F.lit(0))) == 2 and engine.versions() == {"m": 2}
    assert [r.y for r in engine.infer("m", spark.range(2))] == [0, 0]
    engine.unload("m")
    engine.shutdown()
    with pytest.raises(RuntimeError):
        engine.submit("m", spark.range(1)).result(1)


def test_coco_and_images_in_memory(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
            "annotations": [{"image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 10]}, {"image_id": 1, "category_id": 5, "bbox": [0, 0, 0, 9]}], "categories": [{"id": 3}, {"id": 5}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    rows = files.coco_dataset(spark, str(tmp_path / "coco.json")).collect()
    assert [(r.path, r.stem, [tuple(b) for b in r.boxes]) for r in rows] == [("a.jpg", "a", [(3, 0.2, 0.3, 0.2, 0.2)])]
    pix = files.image_pixels(spark, bytes(range(12)), 2, 2, 3).collect()
    assert [(r.row, r.col, r.ch, r.v) for r in pix if r.v in (0, 5, 11)] == [(0, 0, 0, 0.0), (0, 1, 2, 5.0), (1, 1, 2, 11.0)]
    with pytest.raises(ValueError):
        files.image_pixels(spark, b"123", 2, 2, 3)
    t = imaging.tensors(files.image_pixels(spark, bytes(range(12)), 2, 2, 3)).first()
    assert (t.shape, t.data) == ([3, 2, 2], [0.0, 3.0, 6.0, 9.0, 1.0, 4.0, 7.0, 10.0, 2.0, 5.0, 8.0, 11.0])


def test_hash_sample_is_the_first_by_hash(spark):
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("g"))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))
    for n in (100, 1666, 5000, 9000):
        want = [r.vec_id for r in rows.orderBy(place, "vec_id").limit(n).collect()]
        assert sorted(r.vec_id for r in vectors.hash_sample(rows, n, "vec_id").collect()) == sorted(want)
    per = vectors.hash_sample(rows, 50, "vec_id", "g").groupBy("g").count().collect()
    assert sorted(tuple(r) for r in per) == [(0, 50), (1, 50), (2, 50)]


def test_command_line(spark, tmp_path):
    from visorq.__main__ import main

    out = str(tmp_path / "out")
    assert main(["what"], spark) == 2 and main(["query", "box_clip", SF, out], spark) == 0
    assert spark.read.parquet(out).count() == T.detections(spark, SF).count()
    T.samples(spark, SF).write.parquet(str(tmp_path / "samples"))
    main(["evaluate", str(tmp_path / "samples"), out], spark)
    row = spark.read.parquet(out).first()
    assert row.tp + row.fp + row.tn + row.fn == T.samples(spark, SF).count() and 0 <= row.auc <= 1
    main(["threshold", str(tmp_path / "samples"), str(tmp_path / "t.json"), "percentile"], spark)
    assert patchcore.read_threshold(spark, str(tmp_path / "t.json")) is not None
    (tmp_path / "g.json").write_text(json.dumps({"pipeline": {"nodes": [{"id": "n", "type": "filter"}]}}))
    T.detections(spark, SF).write.parquet(str(tmp_path / "det"))
    main(["graph", str(tmp_path / "g.json"), str(tmp_path / "det"), out], spark)
    assert spark.read.parquet(out).filter("node_id = 'n'").count() == T.detections(spark, SF).filter("confidence >= 0.5").count()
    T.bank(spark, SF).select("vec_id", "features").write.parquet(str(tmp_path / "pool"))
    main(["train", str(tmp_path / "pool"), out, "0.05"], spark)
    assert spark.read.parquet(f"{out}/bank").count() == T.bank(spark, SF).count() // 20 and spark.read.parquet(f"{out}/norm").count() == 64


def test_tasks_of_pixels_hold_a_bounded_number_of_images(spark, monkeypatch):
    """Images are dealt by their number, and what groups a pixel's image needs no other deal."""
    monkeypatch.setattr(T, "IMAGES", 1)
    pix = T.pixels(spark, "/root/testdata/sf0.01")
    held = pix.select("image_id").distinct().groupBy(F.spark_partition_id()).count().collect()
    assert pix.rdd.getNumPartitions() == T.table(spark, "/root/testdata/sf0.01", "supplier").count() and max(r["count"] for r in held) < 10
    plan = imaging.letterbox_pixels(pix, 16, 16, 12, 20)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_id" in plan and not re.search(r"hashpartitioning\(image_id#\d+L?, [a-z]", plan)


def test_jittered_pixels_are_grouped_where_they_are_made(spark):
    bgr = T.pixels(spark, SF).groupBy("image_id", "row", "col").pivot("ch", [0, 1, 2]).agg(F.first("v"))
    plan = bgr._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(image_id" in plan


def test_resized_pixels_are_grouped_where_they_are_made(spark):
    plan = imaging.resize(T.pixels(spark, SF), 16, 16, 24, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 + plan.count("Exchange hashpartitioning(out") and "Exchange hashpartitioning(image_id" in plan


def test_fused_detections_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(detect, "BOXES", 100)
    d = T.detections(spark, SF)
    out = detect.fuse_detections(d, Q._grid_cells(d), 0.5, 640, 640)
    assert out.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-d.count() // 100)) > 8
    assert out.columns == [*d.select("frame_id", "det_id").columns, *[c for c in d.columns if c not in ("frame_id", "det_id")], "anomaly_score", "is_anomaly"]


def test_blocks_ship_in_proportion_to_rows():
    """What a search of all rows ships grows with the rows while blocks are not full, not with their square."""
    shipped = []
    for n in (10_256, 102_564, 615_384):
        nb, nq = blocks._shape(n * 8 // 10, n, 8 * 64, blocks.BLOCK_BYTES, 48)
        shipped.append((n * 8 // 10 * nq + n * nb) / n)
    assert max(shipped) <= 1.2 * shipped[0] < 20


def test_a_pair_of_blocks_holds_tiles_and_not_its_whole_product():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    side = lambda n, name: pa.table({"g": [""] * n, name: np.arange(n), "v": pa.FixedSizeListArray.from_arrays(rng.normal(size=n * 8).astype(np.float32), 8).cast(pa.list_(pa.float32()))})
    bank, queries = side(20_000, "b"), side(4_000, "id")
    tracemalloc.start()
    found = blocks._search_pair(bank, queries, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 12_000 and peak < 4_000 * 20_000 * 8 / 10


def test_average_precision_sorts_no_whole_label(spark, monkeypatch):
    """The same precision where a label's ranking is cut into many stretches, with many equal confidences."""
    d = T.detections(spark, SF).withColumn("confidence", F.round("confidence", 1))
    whole = {r.label: r.ap for r in detect.average_precision(d, Q._truth(d)).collect()}
    cut = {r.label: r.ap for r in detect.average_precisions(d, Q._truth(d), (0.5,), stretch=20).collect()}
    assert cut.keys() == whole.keys() and all(cut[k] == pytest.approx(whole[k]) for k in whole)


def test_graph_starts_from_groups_of_bounded_size(spark, monkeypatch):
    """A node is shipped to three groups at the start, near copies fill no group, and most of a node's links are right before any round."""
    for name, value in (("LEAF", 20), ("GROUP", 100)):
        monkeypatch.setattr(graph, name, value)
    rows = T.patch_features(spark, "/root/testdata/sf0.01").select("vec_id", "features")
    copies = spark.range(1000, 1500).select(F.col("id").alias("vec_id"), F.lit([0.5] * 64).alias("features"))
    nodes = rows.unionByName(copies).select(F.col("vec_id").alias("id"), F.col("features").alias("v"))
    dealt = graph._groups(nodes, nodes.count(), 1)
    assert dealt.groupBy("id").count().filter("count <> 3").count() == 0
    assert dealt.groupBy("g").count().agg(F.max("count")).first()[0] <= 2 * 100
