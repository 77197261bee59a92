"""JSON-configured processing graphs, compiled to DataFrame transformations."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import detect, imaging, model, patchcore

PROCESSORS: dict[str, Callable[[list[DataFrame], dict], DataFrame]] = {}


def processor(name: str):
    """Registers a processor: (inputs, params) to a DataFrame."""

    def put(f):
        PROCESSORS[name] = f
        return f

    return put


@dataclass
class Node:
    id: str
    type: str
    params: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)


@dataclass
class Graph:
    name: str
    nodes: dict[str, Node]
    layers: list[list[str]]


def parse(text: str) -> Graph:
    """Checks types, edges and cycles; layers are in topological order."""
    raw = json.loads(text)["pipeline"]
    nodes = {}
    for n in raw["nodes"]:
        if n["type"] not in PROCESSORS:
            raise ValueError(f"unknown processor type {n['type']}")
        if n["id"] in nodes:
            raise ValueError(f"node {n['id']} is named twice")
        nodes[n["id"]] = Node(n["id"], n["type"], dict(n.get("params", {})))
    for e in raw.get("edges", []):
        if e["from"] not in nodes or e["to"] not in nodes:
            raise ValueError(f"edge with an unknown node: {e}")
        nodes[e["to"]].inputs.append(e["from"])
    layers, done = [], set()
    while len(done) < len(nodes):
        ready = sorted(n for n in nodes if n not in done and set(nodes[n].inputs) <= done)
        if not ready:
            raise ValueError(f"cycle among {sorted(set(nodes) - done)}")
        layers.append(ready)
        done |= set(ready)
    return Graph(raw.get("name", "unnamed"), nodes, layers)


def serialize(graph: Graph) -> str:
    edges = [{"from": i, "to": n.id} for n in graph.nodes.values() for i in n.inputs]
    return json.dumps({"pipeline": {"name": graph.name, "nodes": [{"id": n.id, "type": n.type, "params": n.params} for n in graph.nodes.values()], "edges": edges}})


def compile_graph(graph: Graph, source: DataFrame, watch: Callable[[str, DataFrame | None], DataFrame | None] = lambda name, frame: frame) -> dict[str, DataFrame | None]:
    """Each node's output, as ``watch`` returns it; nodes without inputs read the source, and any earlier output can be used.

    A processor that returns None is skipped and counts as done; nodes after it see the outputs that there
    are, and are skipped where there are none."""
    out: dict[str, DataFrame | None] = {}
    for layer in graph.layers:
        for name in layer:
            node = graph.nodes[name]
            inputs = [out[i] for i in node.inputs if out[i] is not None] if node.inputs else [source]
            out[name] = watch(name, PROCESSORS[node.type](inputs, node.params) if inputs else None)
    return out


def execute(graph: Graph, source: DataFrame) -> DataFrame:
    """Union of the exit nodes' outputs with the node's id."""
    return _union_of_exits(graph, compile_graph(graph, source))


def _union_of_exits(graph: Graph, out: dict[str, DataFrame | None]) -> DataFrame:
    used = {i for n in graph.nodes.values() for i in n.inputs}
    exits = [out[n].withColumn("node_id", F.lit(n)) for n in graph.nodes if n not in used and out[n] is not None]
    if not exits:
        raise ValueError("every exit node was skipped")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exits)


def node_metrics(graph: Graph, source: DataFrame) -> DataFrame:
    """node_id, rows of each node's output."""
    counts = [d.agg(F.lit(n).alias("node_id"), F.count(F.lit(1)).alias("rows")) for n, d in compile_graph(graph, source).items() if d is not None]
    return reduce(DataFrame.unionAll, counts)


def observed(graph: Graph, source: DataFrame) -> tuple[DataFrame, Callable[[], list[tuple]]]:
    """(the graph's result as of ``execute``, metrics): after one action on the result, ``metrics()`` has what each node's
    rows were in that very job, as (node_id, status, rows, bytes, latency_ms).

    bytes are those of the rows as JSON text; latency is the time from a node's first row to its last. A node that several
    others read runs once for each of them and is measured once."""
    seen: dict[str, Observation | None] = {}
    now = F.expr("cast(java_method('java.lang.System', 'currentTimeMillis') as bigint)")

    def watch(name: str, frame: DataFrame | None) -> DataFrame | None:
        seen[name] = None if frame is None else Observation(f"{name}-{uuid.uuid4().hex}")
        if frame is None:
            return None
        size = F.octet_length(F.to_json(F.struct("*"))) if frame.columns else F.lit(2)
        return frame.observe(seen[name], F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.min(now).alias("first"), F.max(now).alias("last"))

    result = _union_of_exits(graph, compile_graph(graph, source, watch))

    def metrics() -> list[tuple]:
        got = [(name, "skip", {}) if o is None else (name, "ok", o.get) for name, o in seen.items()]
        return [(n, status, m.get("rows") or 0, m.get("bytes") or 0, float((m.get("last") or 0) - (m.get("first") or 0))) for n, status, m in got]

    return result, metrics


def profile(graph: Graph, source: DataFrame) -> DataFrame:
    """node_id, status, rows, bytes and latency_ms of each node, from one run of the whole graph, and a row ``total`` with
    the sum of the latencies."""
    result, metrics = observed(graph, source)
    result.write.format("noop").mode("overwrite").save()
    rows = metrics()
    rows.append(("total", "ok", 0, 0, sum(r[-1] for r in rows)))
    return source.sparkSession.createDataFrame(rows, "node_id string, status string, rows long, bytes long, latency_ms double")


def result_json(det: DataFrame, timestamp: int = 0, latency_ms: float = 0.0, status: int = 0) -> DataFrame:
    """One JSON document per frame, detections in id order: timestamp, latency_ms, status, detections with node_id,
    label, confidence, bbox, and where ``det`` has them measurements (a map) and its anomaly_score."""
    number = lambda c: F.round(c, 4)
    fields = [
        F.col("det_id").cast("string").alias("node_id"), "label", number("confidence").alias("confidence"),
        F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), "w", "h").alias("bbox"),
    ]
    if "measurements" in det.columns:
        some = F.size("measurements") > 0
        fields += [F.when(some, F.col("measurements")).alias("measurements"), F.when(some, F.try_element_at("measurements", F.lit("anomaly_score"))).alias("anomaly_score")]
    listed = F.sort_array(F.collect_list(F.struct(F.col("det_id").alias("k"), F.to_json(F.struct(*fields)).alias("d"))))
    head = f'{{"timestamp":{int(timestamp)},"latency_ms":{float(latency_ms)},"status":{int(status)},"detections":['
    return det.groupBy("frame_id").agg(listed.alias("ds")).select("frame_id", F.concat(F.lit(head), F.array_join(F.transform("ds", lambda x: x["d"]), ","), F.lit("]}")).alias("result"))


@processor("filter")
def _filter(inputs, params):
    return detect.confidence_filter(inputs[0], float(params.get("confidence_threshold", 0.5)))


@processor("nms")
def _nms(inputs, params):
    return detect.nms(detect.merge_union(*inputs), float(params.get("iou_threshold", 0.45)), float(params.get("confidence_threshold", 0.5)))


@processor("merge")
def _merge(inputs, params):
    most = int(params.get("max_inputs", 0))
    if most and len(inputs) > most:
        raise ValueError(f"{len(inputs)} inputs, at most {most} allowed")
    return detect.merge_union(*inputs)


@processor("composite")
def _composite(inputs, params):
    inner = parse(json.dumps(params["pipeline"]) if not isinstance(params["pipeline"], str) else params["pipeline"])
    return execute(inner, detect.merge_union(*inputs)).drop("node_id")


@processor("normalize")
def _normalize(inputs, params):
    return imaging.normalize(inputs[0], str(params.get("bgr_to_rgb", "false")).lower() == "true")


@processor("resize")
def _resize(inputs, params):
    return imaging.resize(inputs[0], *(int(params[k]) for k in ("in_height", "in_width")), int(params.get("height", 640)), int(params.get("width", 640)))


@processor("letterbox")
def _letterbox(inputs, params):
    return imaging.letterbox_pixels(inputs[0], *(int(params[k]) for k in ("in_height", "in_width")), int(params.get("height", 640)), int(params.get("width", 640)))


@processor("yolo_decode")
def _decode(inputs, params):
    f = detect.decode_v8 if params.get("version", "v8") == "v8" else detect.decode_v5
    return f(inputs[0], int(params.get("num_classes", 80)), float(params.get("confidence_threshold", 0.5)))


@processor("fusion")
def _fusion(inputs, params):
    return detect.fuse_detections(inputs[0], inputs[1], float(params.get("anomaly_threshold", 0.5)), int(params["width"]), int(params["height"]))


@processor("sql")
def _sql(inputs, params):
    return inputs[0].sparkSession.sql(params["query"], **{f"input{i}": d for i, d in enumerate(inputs)})


@processor("model")
def _model(inputs, params):
    return model.infer(inputs[0], str(params["model_path"]))


@processor("patchcore")
def _patchcore(inputs, params):
    """Inputs: pixels, and the bank unless ``memory_bank_path`` names one stored as Parquet."""
    bank = inputs[1] if len(inputs) > 1 else inputs[0].sparkSession.read.parquet(params["memory_bank_path"])
    threshold = float(params["anomaly_threshold"]) if "anomaly_threshold" in params else None
    sidecar = f"{params['memory_bank_path']}.threshold.json" if "memory_bank_path" in params else None
    return patchcore.patchcore(inputs[0], bank, threshold, sidecar, params=params)


@processor("multi_roi")
def _multi_roi(inputs, params):
    """Inputs: pixels, ROIs (roi_id, x, y, w, h) and their banks (roi_id, vec_id, features)."""
    return patchcore.multi_roi(inputs[0], inputs[1], inputs[2], float(params.get("anomaly_threshold", 0.5)), per_image="image_id" in inputs[1].columns)
