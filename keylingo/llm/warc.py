"""WARC archives: writing captures, and assembling them from their records.

A capture is a transaction of a response or revisit record, a request and a
metadata record. Readers find what belongs together through concurrent-to
identifiers, in either direction and by way of other records: transactions are
the connected components of these links. Payloads are read with the records if
they are asked for, else measured and digested in passing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, filesystem, publish, small
from .components import components

#: Payloads of fewer bytes are never revisits; the date of records made from a table that has none.
LEAST_SHARED, DATE = 100, "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs

RECORDS = (
    "type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, payload_digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _plain(url: str | None) -> str:
    """A URL without line breaks and control characters, which would break a header."""
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a capture for every row to archives in ``folder``; returns (path, captures) of each file.

    Of captures with equal payloads of ``LEAST_SHARED`` bytes or more the one
    with the smallest id (null ids last, then the first row) is a response and the
    others are revisits of it. Equality is by SHA-256 of the whole payload. Null
    payloads and URLs count as empty, repeated rows are captures of their own, an
    empty table gives no files, other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    body = as_bytes(body_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    rows = scratch.keep(source.withColumn("row_key", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_key")
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    shared = scratch.keep(shared.where("n > 1").select(F.col("digest").alias("shared_digest"), F.col("first.row_key").alias("first_key")), "shared")
    marked = rows.join(shared, (F.col("digest") == F.col("shared_digest")) & (F.octet_length("payload") >= LEAST_SHARED), "left")

    def run(batches):
        task = TaskContext.get()
        store, root = filesystem(folder)
        path, out, n = f"{root}/part-{task.partitionId():06d}.warc.gz", None, 0
        temporary = f"{path}.{task.taskAttemptId()}"
        for batch in small(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary)
                out.write(record("warcinfo", [("WARC-Record-ID", record_id(f"info/{path}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for row in batch.to_pylist():
                out.write(capture(row))
                n += 1
        if out is not None:
            out.close()
            publish(store, temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "captures": pa.array([n], pa.int64())})

    files = marked.select("page_id", "url", "payload", "digest", "row_key", "first_key").mapInArrow(run, "path string, captures long")
    files = scratch.keep(files, "files")
    scratch.drop("rows", "shared")
    return files


def capture(row: dict) -> bytes:
    """The records of one capture: response or revisit, request, metadata."""
    url, payload, key = _plain(row["url"]), row["payload"], row["row_key"]
    main, asked = record_id(f"response/{key}"), record_id(f"request/{key}")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Record-ID", main), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["first_key"] is not None and row["first_key"] != key:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(f"response/{row['first_key']}"))]
        first = record("revisit", head, http)
    else:
        first = record("response", head, http + payload)
    place = re.sub(r"^\w+://", "", url)
    host, _, path = place.partition("/")
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    request = record("request", [("WARC-Record-ID", asked), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], ask)
    fields = f"page-id: {'' if row['page_id'] is None else row['page_id']}\r\n".encode()
    more = [("WARC-Record-ID", record_id(f"metadata/{key}")), ("WARC-Concurrent-To", asked), *common, ("Content-Type", "application/warc-fields")]
    return first + request + record("metadata", more, fields)


def _headers(lines: Iterator[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
            continue
        name, _, value = text.partition(":")
        out.append((name.strip().lower(), value.strip()))
    return out


def parse(stream) -> Iterator[dict]:
    """The records of an open, unpacked archive, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        pairs = _headers(iter(stream.readline, b""))
        head = dict(pairs)
        block = stream.read(int(head.get("content-length", 0)))
        kind, payload, fields, length = head.get("warc-type"), None, {}, None
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            fields = dict(_headers(iter(top.split(b"\r\n")[1:])))
            length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else len(payload)
        elif head.get("content-type", "").startswith("application/warc-fields"):
            fields = dict(_headers(iter(block.split(b"\r\n"))))
        digest = head.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
        if kind == "response":
            length = len(payload or b"")
            digest = hashlib.sha256(payload or b"").hexdigest()  # of what is there, whatever the header says
        yield {
            "type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"],
            "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": digest,
            "payload_bytes": length, "fields": list(fields.items()), "payload": payload if kind in ("request", "response") else None,
        }


def read_records(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``, repeated ones too; a file is read as a stream, by one task. No files give no records.

    Without ``payloads`` they are measured and digested while they are read, and left where they are.
    """
    kinds = [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, _ = filesystem(folder)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for one in parse(stream):
                        if not payloads:
                            one["payload"] = None
                        held.append(one)
                        size += len(one["payload"] or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """A nested row for each capture: record_id, capture, request, metadata.

    ``capture`` is the response or revisit record; ``request`` and ``metadata``
    are lists of the records of its transaction: those that concurrent-to
    identifiers connect with it, in either direction and over any number of
    steps, each record once. Captures of one transaction have the same lists;
    captures without a request or metadata have empty ones. Records that lead to
    no capture belong to none and aren't returned; an empty table gives an empty
    result. ``records`` is read several times: pass a written table.
    """
    scratch = Scratch(records.sparkSession, "warc-transactions")
    near = records.where("record_id is not null").select("record_id", F.explode("concurrent_to").alias("near")).where("near is not null and near <> record_id")
    links = scratch.keep(near.select(F.least("record_id", "near").alias("a"), F.greatest("record_id", "near").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = scratch.keep(both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("other")), "degree")
    # a record with one neighbour follows it; only links between the others are for the components, and most archives have none
    inner = degree.where("n > 1").select("a")
    core = links.join(inner, "a", "left_semi").join(inner.withColumnRenamed("a", "b"), "b", "left_semi")
    placed = components(core, scratch)
    inner = scratch.keep(inner.join(placed, inner["a"] == placed["node"], "left").select(F.col("a").alias("node"), F.coalesce("root", "a").alias("root")), "inner")
    outer = degree.where("n = 1").join(inner, F.col("other") == F.col("node"), "left")
    outer = outer.select(F.col("a").alias("node"), F.coalesce("root", F.least("a", "other")).alias("root"))
    root_of = inner.unionByName(outer)

    whole = F.struct("type", "record_id", "refers_to", "uri", "date", "payload_digest", "payload_bytes", "fields", "payload")
    named = records.where("type in ('response', 'revisit', 'request', 'metadata')").join(root_of, F.col("record_id") == F.col("node"), "left")
    named = named.select("type", "record_id", F.coalesce("root", "record_id").alias("root"), whole.alias("record"))
    captures = named.where("type in ('response', 'revisit')").select("record_id", "root", F.col("record").alias("capture"))
    lists = named.where("type in ('request', 'metadata')").groupBy("root").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("record"))).alias("request"), F.collect_list(F.when(F.col("type") == "metadata", F.col("record"))).alias("metadata")
    )
    joined = captures.join(lists, "root", "left")
    return joined.select("record_id", "capture", *(F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c) for c in ("request", "metadata")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives, reads them back and assembles the captures: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are measured and digested as they are read, and not carried through
    the assembly, as none of these columns needs them. Null payloads count as empty and null URLs too; rows with repeated or null ids
    are captures of their own; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-read")
    folder = f"{scratch.path}/archives"
    records = scratch.keep(read_records(write_archives(pages, folder), folder, payloads=False), "records")
    captures = assemble(records)
    number = F.get("metadata", F.lit(0))["fields"]["page-id"]
    found = captures.select(
        "record_id",
        F.when(F.length(number) > 0, number.cast("long")).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("first_id"),
    )
    found = scratch.keep(found, "captures")
    scratch.drop("records")
    # only responses that are referred to; the hot one is one row here and many on the other side
    first = found.where("record_type = 'response'").select(F.col("record_id").alias("first_record"), F.col("page_id").alias("refers_to"))
    out = found.join(first, F.col("first_id") == F.col("first_record"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
