"""Deterministic, sharded WARC archives: written once, described by a manifest, read back."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.llm.rows import col
from flowlens.session import materialize

DATE = "2024-01-01T00:00:00Z"
LEAST_SHARED = 100
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
SPLIT = 1024
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"
URL_SAFE = "".join(chr(c) for c in range(33, 127))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below a value, by two short searches."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps([*rows])), "array<array<bigint>>")
    row = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.size(F.filter(F.element_at(table, row), lambda b: b <= value))
    return F.when(value.isNull() | (value < bounds[0]), F.lit(0)).otherwise((row - 1) * step + inner).cast("int")


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, so that a shard has about ``shard_bytes``.

    Sums over ranges of ids, split by 1,024 as long as one is too large, depend on the rows
    alone and not on how they were dealt out; the driver sees sums per range.
    """
    low, high = sizes.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    cells: list[tuple[int, int]] = []
    todo, size = [low], high + 1 - low
    while todo:  # all ranges of a round have one size, and are summed in one job
        width = max(1, -(-size // SPLIT))
        start = F.get(F.from_json(F.lit(json.dumps(todo)), "array<bigint>"), bucket_of(F.col("id"), todo) - 1)
        placed = sizes.withColumn("start", start).filter(F.col("id") < F.col("start") + size)
        found = placed.groupBy("start", F.expr(f"(id - start) div {width}").alias("k")).agg(F.sum("bytes").alias("n")).collect()
        todo = []
        for a, k, n in found:
            if n > shard_bytes and width > 1:
                todo.append(a + k * width)
            else:
                cells.append((a + k * width, n))
        todo, size = sorted(todo), width
    bounds, total = [], 0
    for start, n in sorted(cells):
        if total and total + n > shard_bytes:
            bounds.append(start)
            total = 0
        total += n
    return bounds


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the same bytes whenever it is made."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode()).digest()[:16])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("WARC-Payload-Digest", "sha256:" + digest),
        ("X-Page-Id", json.dumps(page_id)), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=URL_SAFE)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("X-Refers-To-Page", json.dumps(refers_to))]
    return _member(headers, block)


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(f"{base}/temporary")
        store.create_dir(f"{base}/archives")
        out, shard, part, name, records, size, digest = None, None, 0, "", 0, 0, None
        refers: dict = {}

        def begin():
            nonlocal out, name, records, size, digest
            name, records, size, digest = f"pages-{shard:06d}-{part:05d}.warc.gz", 0, 0, hashlib.sha256()
            out = store.open_output_stream(f"{base}/temporary/{name}.{attempt}", compression=None)
            put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                         ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n"))

        def put(data: bytes):
            nonlocal size
            out.write(data)
            digest.update(data)
            size += len(data)

        def commit() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            store.move(f"{base}/temporary/{name}.{attempt}", f"{base}/archives/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([shard], pa.int32()), pa.array([records], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([digest.hexdigest()])], names=["file", "shard", "records", "bytes", "sha256"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "page", "url", "html", "sha", "refers_to"))):
                at, page_id, page, url, html, sha, refers_to = row
                if not page:  # comes before the rows of its page
                    if refers and next(iter(refers))[0] != page_id:
                        refers.clear()
                    refers[page_id, sha] = refers_to
                    continue
                if out is not None and (at != shard or size >= file_bytes):
                    part = part + 1 if at == shard else 0
                    yield commit()
                elif out is None:
                    part = 0
                if out is None:
                    shard = at
                    begin()
                put(_record(page_id, url, (html or "").encode(), sha, refers.get((page_id, sha))))
                records += 1
        if out is not None:
            yield commit()

    return write


def write_archives(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``root`` (a folder that all executors reach); returns the manifest.

    Shards are ranges of ids of about ``shard_bytes`` payload; a shard is written in id order
    by one task, into files that are closed at ``file_bytes`` compressed. Bytes depend on the
    rows alone. A file is written under a temporary name of its task attempt and then moved;
    it counts only once the manifest, which Spark commits as a whole, names it with its
    digest, so a repeated or lost task does no harm. Among rows with the same payload of 100
    bytes or more, that with the smallest id is the response and rows with other ids are
    revisits (rows that repeat the response's id are responses). NULL payloads are empty, NULL
    ids come first and are revisits where an id is known for their payload; NULL urls are left out.
    """
    rows = pages.select(
        col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = materialize(rows.select("id", F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sha")), "payloads")
    shared = known.filter(F.col("bytes") >= LEAST_SHARED).groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("refers_to")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = known.filter(F.col("bytes") >= LEAST_SHARED).join(shared, "sha").filter("not id <=> refers_to").distinct()
    bounds = shard_bounds(known, shard_bytes)
    both = rows.withColumn("sha", F.sha2(payload, 256)).select("id", F.lit(True).alias("page"), "url", "html", "sha", F.lit(None).cast("long").alias("refers_to"))
    both = both.unionByName(revisits.select(
        "id", F.lit(False).alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "refers_to"))
    both = both.withColumn("shard", bucket_of(F.col("id"), bounds))
    dealt = both.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "page", "sha", "url")
    manifest = dealt.mapInArrow(_writer(root, file_bytes), MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _members(stream, digest) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        digest.update(data)
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
            else:
                data = b""
    if parts:
        raise ValueError("the archive ends within a record")


def read_archives(spark: SparkSession, root: str, most_tasks: int = 4096) -> DataFrame:
    """Every record of the files the manifest names; sizes and digests are checked against the bytes read.

    There are as many tasks as files, up to ``most_tasks``. Records come back as they were written: NULL ids,
    repeated rows and empty payloads too; a manifest without files gives no rows.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())])
        for batch in batches:
            for file, records, sha in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256"))):
                digest, rows = hashlib.sha256(), []
                with store.open_input_stream(f"{base}/archives/{file}", compression=None) as stream:
                    for record in _members(stream, digest):
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        block = rest[: int(fields["Content-Length"])]
                        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"] or rest[len(block):] != b"\r\n\r\n":
                            raise ValueError(f"a record of {file} is damaged")
                        size, payload_digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if own != payload_digest:
                                raise ValueError(f"a payload of {file} is damaged")
                        rows.append((json.loads(fields["X-Page-Id"]), size, payload_digest, kind,
                                     json.loads(fields.get("X-Refers-To-Page", "null")), fields.get("WARC-Target-URI"), file))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                            records -= 10_000
                if digest.hexdigest() != sha or len(rows) != records:
                    raise ValueError(f"{file} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest.count()  # a number of partitions, so that a small manifest is not one task
    spread = manifest.repartitionByRange(min(max(1, files), most_tasks), "file")
    return spread.mapInArrow(read, RECORDS)
