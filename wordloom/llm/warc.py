"""WARC archives on shared storage: an index first, then coalesced byte-range reads of selected records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import new_path, written

#: An archive is closed and another begun beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Records that lie at most GAP apart are read at once, up to READ_BYTES.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Parts that the rows of one payload are dealt into.
PARTS = 64
#: Archive bytes that a task reads, about.
TASK_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"


def _store(uri: str) -> tuple[Any, str]:
    """The file system of a URI or path, and the path on it: local, hdfs, viewfs, s3 (s3a, s3n), gs, abfs as pyarrow knows them."""
    from pyarrow import fs

    for name, known in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(name):
            uri = known + uri[len(name) :]
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _header(value: str) -> str:
    """White space that would break a header line is percent-encoded, reversibly."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(row: dict, date: str) -> bytes:
    """One gzip member holding a response or revisit record."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head += [f"WARC-Target-URI: {_header(row['url'])}"] + ["X-URI-Encoded: 1"] * (_header(row["url"]) != row["url"])
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> dict:
    """The record of a gzip member, its digests checked."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    if "X-URI-Encoded" in fields:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": url, "record_type": fields["WARC-Type"], "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    made = []
                    for row in batch.slice(at, 256).to_pylist():
                        if out is None or size > ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            # each attempt of a task has files of its own; only a committed index names them
                            name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                        row["payload_digest"] = base64.b32encode(row["sha"]).decode()
                        member = record(row, date)
                        out.write(member)
                        made.append({k: row[k] for k in ("page_id", "url", "payload_digest", "record_type")} | {"file": f"{folder}/{name}", "offset": size, "length": len(member)})
                        size += len(member)
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return run


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by file and offset, that one read covers."""
    run: list[dict] = []
    for row in rows:
        near = run and row["file"] == run[0]["file"] and row["offset"] - run[-1]["offset"] - run[-1]["length"] <= GAP
        if run and not (near and row["offset"] + row["length"] - run[0]["offset"] <= READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, name = None, None
    for batch in batches:
        for run in _ranges(batch.to_pylist()):
            if run[0]["file"] != name:
                if opened is not None:
                    opened.close()
                name = run[0]["file"]
                store, path = _store(name)
                opened = store.open_input_file(path)
            low = run[0]["offset"]
            data = opened.read_at(run[-1]["offset"] + run[-1]["length"] - low, low)
            made = [parse(data[r["offset"] - low : r["offset"] - low + r["length"]]) for r in run]
            yield pa.RecordBatch.from_pylist(made, schema=_arrow(RECORD))
    if opened is not None:
        opened.close()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``folder``; returns the index, a written table.

    Payload: the html in UTF-8, a null being empty. Of rows with equal payloads of at least
    ``min_bytes``, those with the largest page_id are responses and others revisit them; rows without
    an id revisit only where some row has one. A null url has no target; rows may repeat; an empty
    table gives an empty index; other columns are ignored. Payloads travel once, towards the row that
    names their response, equal ones in PARTS parts with a copy of that row each, so that many equal
    pages are not one task. A payload of any length is one row.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)))
    slots = rows.groupBy("sha", "size", "part").agg(F.max("page_id").alias("first"))
    best = slots.groupBy("sha", "size").agg(F.max("first").alias("first"))
    firsts = slots.drop("first").join(best, ["sha", "size"])
    revisit = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = rows.join(firsts, ["sha", "size", "part"]).select(
        "page_id", "url", "payload", "sha",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    return written(ready.mapInArrow(_write(folder, date), INDEX), "cdx")


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` rows name: page_id, url, record_type, payload_digest, refers_to, payload.

    Rows are sorted by file and offset within stretches of archives, so that neighbours are read together.
    There are as many tasks as the selected records' bytes ask for: rows of the index are small, so their own size
    would put gigabytes of records into one task.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / (16 * READ_BYTES))
    near = index.select("file", "offset", "length").withColumn("stretch", stretch)
    return near.repartition(total // TASK_BYTES + 1, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch").mapInArrow(_read, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's size is its response's."""
    slim = written(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"), "records")
    whole = slim.where("record_type = 'response'")
    target = whole.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = slim.where("record_type = 'revisit'").drop("payload_bytes").join(target, ["refers_to", "payload_digest"])
    return whole.unionByName(again)
