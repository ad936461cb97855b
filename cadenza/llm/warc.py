"""Web archives with an index: one row per record with its place, URL and digest, written along with the archive.

Records are gzip members of their own, so any record can be read by its offset and length. Reading starts from rows of
the index: their byte ranges are sorted within each file, near ones are joined into one read of bounded size, and the
reads are dealt over the cluster. Of rows with equal payloads the one with the largest page_id is stored in full (a
response); the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.llm.common import join_counted, scratch_path, spread, written

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"


def _uri(url: str | None, page_id) -> str:
    """A URL for a header line: what can't stand there is percent-encoded."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_response: bool) -> bytes:
    """One record, before compression. A revisit keeps the HTTP head, with the length of the full payload, only."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if not is_response:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, lower-cased names, with `payload` (None for a revisit) and `payload_bytes`."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    http, _, payload = rest[: int(out["content-length"])].partition(b"\r\n\r\n")
    size = next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    full = out["warc-type"] == "response"
    return out | {"payload": payload if full else None, "payload_bytes": int(size.partition(":")[2])}


def write(pages: DataFrame, file_bytes: int = 64_000_000, level: int = 5) -> DataFrame:
    """Archive every row of pages (page_id, url, html); returns the index.

    The payload is html in UTF-8, empty for null. The payloads' digests decide on narrow rows which page_id keeps each
    payload; pages then move once, by page_id. A file is closed after file_bytes. Attempts of tasks write under names of
    their own, and only those of the attempt that Spark took are in the index. Repeated rows are written each; copies of
    the response row are responses too. A null page_id is smaller than any other. Other columns are left out.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    d = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    ids = written(d.select("page_id", "sha1"), "digests")
    kept = ids.groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("size"))
    roles = join_counted(ids, kept, "sha1").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "kept").distinct()
    d = d.join(roles, d["page_id"].eqNullSafe(roles["_id"]) & (d["sha1"] == roles["_sha1"])).drop("_id", "_sha1")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, sha1, keeps in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "kept")]):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                z = zlib.compressobj(level, wbits=31)
                raw = z.compress(record(page_id, url, payload, digest, keeps, page_id == keeps)) + z.flush()
                out.write(raw)
                rows.append((f"{folder}/{name}", at, len(raw), url, digest, "response" if page_id == keeps else "revisit", page_id))
                at += len(raw)
                if at >= file_bytes:
                    out.close()
                    out = None
            names = ["file", "offset", "length", "url", "digest", "record_type", "page_id"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        if out is not None:
            out.close()

    return written(d.mapInArrow(save, INDEX), "warc-index")


def ranges(selected: DataFrame, gap: int = 64_000, most: int = 8_000_000) -> DataFrame:
    """Reads that cover the selected rows of an index: file, start, length and the records' places within the read.
    Records at most `gap` bytes apart share a read of about `most` bytes."""
    by_file = W.partitionBy("file").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file) > gap
    d = selected.select("file", "offset", "length").distinct().withColumn("_far", F.coalesce(far, F.lit(True)).cast("int"))
    d = d.withColumn("_run", F.sum("_far").over(by_file))
    d = d.withColumn("_part", F.floor((F.col("offset") - F.min("offset").over(W.partitionBy("file", "_run"))) / most))
    d = d.groupBy("file", "_run", "_part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return d.select("file", "start", (F.col("end") - F.col("start")).alias("length"), F.transform("records", lambda r: F.struct((r["offset"] - F.col("start")).alias("at"), r["length"].alias("n"))).alias("records"))


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url (as it stands in the record: percent-encoded, urn:page:N for null), record_type, payload_digest, payload_bytes, refers_to (and payload, null for revisits) of the selected
    rows of an index. The payload of a response is held against its digest."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                store, p = fs.FileSystem.from_uri(x["file"])
                with store.open_input_file(p) as f:
                    raw = f.read_at(x["length"], x["start"])
                found = [parse(zlib.decompress(raw[r["at"] : r["at"] + r["n"]], wbits=31)) for r in x["records"]]
                for r in found:
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                        raise ValueError(f"the payload of page {r['page-id']} doesn't have its digest")
                number = lambda s: int(s) if s else None
                columns = {
                    "page_id": pa.array([number(r["page-id"]) for r in found], pa.int64()), "url": pa.array([r["warc-target-uri"] for r in found], pa.string()),
                    "record_type": pa.array([r["warc-type"] for r in found], pa.string()), "payload_digest": pa.array([r["warc-payload-digest"].removeprefix("sha1:") for r in found], pa.string()),
                    "payload_bytes": pa.array([r["payload_bytes"] for r in found], pa.int64()), "refers_to": pa.array([number(r.get("refers-to-page-id")) for r in found], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"payload": pa.array([r["payload"] for r in found], pa.binary())} if payloads else {}))

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads
    reads = spread(ranges(selected), "file", "start")
    return reads.mapInArrow(load, schema)
