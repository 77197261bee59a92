"""WARC archives: write with an index, then read selected records by coalesced byte ranges.

Writing: equal payloads are found by digest (a map-side combined aggregation over digests), so that the
record with the smallest page id becomes the response and the others revisit it. Each task writes its
own archive, one gzip member per record, under a name of its own attempt, and returns the index rows
(file, offset, length, URL, digest). The index is stored first; a retried task's earlier file is never
named by it. Reading: the selected index rows are dealt out by the archive bytes that they stand for and
sorted by file and offset, neighbouring byte ranges are coalesced into one read, and each record is parsed
and checked against its digest.

Defined cases: null html is an empty payload; null url is written as an empty target; rows with equal
payload and equal id are all written, and those with the least id are all responses, as there is no other
record that they could refer to; a null id counts as the largest, and where all records of a payload have
none, all are responses; an empty table gives no archive and an empty result; other input columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, join_by_counts, materialize, own_folder, shuffle_partitions, split_by_slots

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
#: Archive bytes that stand together when records are dealt out to readers, read by one task, and read at once.
_TARGET, _TASK, _READ = 4_000_000, 64_000_000, 16_000_000


def filesystem(path: str):
    """(file system, path in it) for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url: str, when: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's headers only."""
    clean = url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {when}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {when}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    warc = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(warc["Content-Length"])]
    if len(block) != int(warc["Content-Length"]) or payload_digest(block) != warc["WARC-Block-Digest"][5:]:
        raise ValueError(f"damaged record {warc.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    page = lambda x: None if x == "null" else int(x)
    out = {
        "page_id": page(warc["WARC-Record-ID"][12:-1]), "url": warc.get("WARC-Target-URI", ""), "record_type": warc["WARC-Type"],
        "digest": warc["WARC-Payload-Digest"][5:], "payload_bytes": int(fields["Content-Length"]), "payload": payload,
        "refers_to": page(warc["WARC-Refers-To"][12:-1]) if "WARC-Refers-To" in warc else None,
    }
    if out["record_type"] == "response" and payload_digest(payload) != out["digest"]:
        raise ValueError(f"payload of {out['page_id']} doesn't match its digest")
    return out


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, when: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write archives under ``folder``; returns the stored index. Without ``folder`` they are in the shared folder and are
    deleted with the stored steps."""
    spark = pages.sparkSession
    folder = folder or own_folder(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html")
    )
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha1(F.col("html").cast("binary"))))
    # one row per task and digest is shuffled here; only digests that repeat go on
    firsts = (
        rows.filter("sha is not null").groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("page_id", F.lit(2**63 - 1)), F.col("page_id"), F.col("url"))).alias("first"))
        .filter("n > 1").select("sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    firsts = materialize(firsts, "first-pages")
    likely, rest = split_by_slots(rows, F.col("sha"), firsts, F.col("sha"))
    alone = rest.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    linked = join_by_counts(likely, firsts, ["sha"], "n", rows.count(), "left").unionByName(alone).select(
        "page_id", "url", "html", F.col("n").isNotNull().alias("shared"), "first_id", "first_url"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = {f.split()[0]: [] for f in INDEX.split(", ")}
            for page_id, url, html, shared, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                digest = payload_digest(payload)
                refers = first_id if shared and page_id != first_id else None
                data = _gzip(record("null" if page_id is None else page_id, url, payload, digest, refers, first_url or "", when))
                out.write(data)
                row = (page_id, url, digest, len(payload), "response" if refers is None else "revisit", refers, name, at, len(data))
                for k, v in zip(index, row, strict=True):
                    index[k].append(v)
                at += len(data)
            yield pa.record_batch([pa.array(v, pa.string() if k in ("url", "digest", "record_type", "file") else pa.int64()) for k, v in index.items()], names=list(index))
            if at > 256_000_000:
                out.close()
                out = None
        if out is not None:
            out.close()

    index = materialize(linked.mapInArrow(run, INDEX), "warc-index")
    discard(firsts)
    return index.withColumn("file", F.concat(F.lit(folder + "/"), F.col("file")))


def read_warc(index: DataFrame, gap: int = 65_536, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to and payload (null for revisits). Rows of ``index`` may be any selection of an index."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            rows: list[tuple] = []
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(places):
                if places[i][0] != path:
                    if f is not None:
                        f.close()
                    path = places[i][0]
                    fs, base = filesystem(path)
                    f = fs.open_input_file(base)
                first, j = places[i][1], i
                end = first + places[i][2]
                while j + 1 < len(places) and places[j + 1][0] == path and places[j + 1][1] <= end + gap and places[j + 1][1] - first < _READ:
                    j += 1
                    end = max(end, places[j][1] + places[j][2])
                data = memoryview(f.read_at(end - first, first))
                for _, at, n in places[i : j + 1]:
                    r = parse(zlib.decompress(data[at - first : at - first + n], 31))
                    full = r["payload"] if with_payload and r["record_type"] == "response" else None
                    rows.append((r["page_id"], r["url"], r["record_type"], r["digest"], r["payload_bytes"], r["refers_to"], full))
                i = j + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema=schema)
        if f is not None:
            f.close()

    # as many tasks as the records' bytes ask for: the rows of the index say little of the work behind them
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // _TASK), min(shuffle_partitions(index.sparkSession), -(-total // _TARGET)), 1)
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / _TARGET)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
