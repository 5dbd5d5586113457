"""WARC archives: write, normalise monolithic gzip files to one member per record, index, read back.

`write_archives` stores records as WARC files, each one a single gzip stream. `normalise` inflates every
such stream once, from front to end, writes each record again as a gzip member of its own and adds a
sidecar index with one line per record (offset, length, record id, type), after which any record can be
read alone. All files lie in a shared folder and are reached through pyarrow's file systems; a task
writes under a name of its attempt and then renames, so a repeated or speculative task does no harm:
only the archives that the table of a finished job names are read on.

Records with equal payloads of at least `MIN_REVISIT` bytes: that with the smallest page id is the
response, the others are revisits that carry the payload's digest, size and the response's page id.

Defined edge cases: a null html is an empty payload; a null url gives an empty target; line breaks in a
url are percent-encoded; a null page_id is last in order and written as an empty id; repeated page_ids:
one of the rows is the response, the others revisits of it; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch_dir, written

MIN_REVISIT = 100
GZIP_LEVEL = 1
#: Payload bytes after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the response's headers but no payload."""
    name = "" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{name}/{digest}/{kind}')}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", name), ("X-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """The fields of the record that data begins with, in lower case, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}, end + 4


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated bytes that arrive in pieces; at most one record and one piece are held."""
    have, need = bytearray(), 0
    for piece in stream:
        have += piece
        while True:
            if not need:
                at = have.find(b"\r\n\r\n")
                if at < 0:
                    break
                fields, begin = headers(bytes(have[: at + 4]))
                need = begin + int(fields["content-length"]) + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = 0
    if have:
        raise ValueError("the archive ends inside a record")


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file, whether of one member or of many, piece by piece."""
    unpack = zlib.decompressobj(31)
    while data := file.read(_CHUNK):
        while data:
            out = unpack.decompress(data, _CHUNK)
            if out:
                yield out
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                data = unpack.unconsumed_tail


def _put(store, path: str, write) -> None:
    """Write a file under a passing name, then rename it."""
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(passing, compression=None) as f:
        write(f)
    store.move(passing, path)


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with payload size, digest, record type and the page a revisit refers to; html only where it is stored.

    Only ids and digests are matched; html moves once, to the row that its id names.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.withColumn("tie", F.xxhash64("url"))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(2**63 - 1)).alias("o"), "tie", "page_id")
    first = large.groupBy(F.col("payload_digest").alias("fd")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(first.filter("n > 1").select("fd", F.col("first.page_id").alias("first_id"), F.col("first.tie").alias("first_tie")), "warc-shared")
    both = rows.join(shared, (rows["payload_digest"] == shared["fd"]) & (rows["payload_bytes"] >= MIN_REVISIT), "left")
    # equal rows (same id, url and payload) cannot be told apart: one of each set is the response
    again = F.row_number().over(_same())
    same = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    alone = both.filter(F.col("fd").isNull() | ~same).withColumn("again", F.lit(1))
    firsts = both.filter(F.col("fd").isNotNull() & same).withColumn("again", again)
    both = alone.unionByName(firsts)
    stored = F.col("fd").isNull() | (same & (F.col("again") == 1))
    both = both.withColumn("record_type", F.when(stored, "response").otherwise("revisit")).withColumn("refers_to", F.when(~stored, F.col("first_id")))
    return both.withColumn("html", F.when(stored, F.col("html"))).select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("payload_digest").orderBy("page_id")


class Planned(NamedTuple):
    page_id: int | None
    url: str
    html: str | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write records as monolithic gzip archives, several a partition at most; one row per archive: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        from pyspark import TaskContext

        task = TaskContext.get()
        part, made = f"{task.partitionId():06d}-{task.taskAttemptId()}", []
        rows = (Planned(*(c[i].as_py() for c in batch.columns)) for batch in batches for i in range(len(batch)))
        more = next(rows, None)
        while more is not None:
            path, n = f"{root}/part-{part}-{len(made):04d}.warc.gz", 0

            def fill(f) -> None:
                nonlocal more, n
                pack, size = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31), 0
                while more is not None and size < ARCHIVE_BYTES:
                    payload = (more.html or "").encode("utf-8", "surrogatepass")
                    whole = record(more.record_type, more.page_id, more.url, payload, more.payload_bytes, more.payload_digest, more.refers_to)
                    f.write(pack.compress(whole))
                    size, n = size + len(whole), n + 1
                    more = next(rows, None)
                f.write(pack.flush())

            _put(store, path, fill)
            made.append((path, n))
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return mapped(planned.select(*Planned._fields), run, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index; one row per archive: path, index_path, records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            out = []
            for source in pdf["path"]:
                name = source.rsplit("/", 1)[1]
                path, index, lines = f"{root}/{name}", f"{root}/{name}.idx", []

                def fill(f, source=source, lines=lines) -> None:
                    offset = 0
                    with store.open_input_stream(source, compression=None) as whole:
                        for data in records(inflated(whole)):
                            fields, _ = headers(data)
                            pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                            member = pack.compress(data) + pack.flush()
                            f.write(member)
                            lines.append(json.dumps([offset, len(member), fields["warc-record-id"], fields["warc-type"]]))
                            offset += len(member)

                _put(store, path, fill)
                _put(store, index, lambda f, lines=lines: f.write("".join(x + "\n" for x in lines).encode()))
                out.append((path, index, len(lines)))
            yield pd.DataFrame(out, columns=["path", "index_path", "records"])

    return archives.mapInPandas(run, "path string, index_path string, records long")


RECORD = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, path string"


def read_archives(normal: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record, read through its archive's index: each member is inflated alone and its payload checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as f:
                    places = [json.loads(x) for x in f.read().decode().splitlines()]
                with store.open_input_stream(path, compression=None) as f:
                    rows, size = [], 0
                    for offset, length, _, kind in places:
                        data = zlib.decompress(f.read(length), 31)
                        fields, begin = headers(data)
                        body = data[data.index(b"\r\n\r\n", begin) + 4 : begin + int(fields["content-length"])]
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        n = int(fields["x-payload-length"])
                        if kind == "response":
                            digest, n = hashlib.sha256(body).hexdigest(), len(body)
                            if digest != fields["warc-payload-digest"].partition(":")[2]:
                                raise ValueError(f"{path}: a payload at {offset} differs from its digest")
                        html = body.decode("utf-8", "surrogatepass") if payloads and kind == "response" else None
                        rows.append((number(fields["x-page-id"]), fields["warc-target-uri"], html, n, digest, kind, number(fields.get("x-refers-to-page-id")), offset, length, path))
                        size += len(html or "")
                        if len(rows) >= 2000 or size > _CHUNK * 8:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return mapped(normal, run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(x.split() for x in RECORD.split(", ")), strict=True)
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages as archives and normalise them: the table of normalised archives and their folder."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    whole = written(write_archives(plan_records(pages), f"{folder}/whole"), "warc-whole")
    many = max(1, whole.count())
    normal = written(normalise(whole.repartition(many, "path"), f"{folder}/records"), "warc-normal")
    return normal, f"{folder}/records"


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    normal, folder = archived(pages)
    read = read_archives(normal.repartition(max(1, normal.count()), "path"), folder, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {MIN_REVISIT}
"""
