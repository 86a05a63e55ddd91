"""Deterministic sharded WARC writer and reader.

Record order and file contents depend on the records alone, not on how Spark deals
them: a shard is a fixed range of page ids, its records are sorted, files roll
within the shard by compressed size, and headers are made from the record. Each
record is a gzip member of its own. A task writes under temporary names, renames a
finished file to a name that tells its place and its content's digest, and reports
it; the driver commits by writing the manifest, and readers open only files that a
manifest lists. A task that runs twice leaves the same bytes under the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Page ids of a shard, and compressed bytes after which a file is full.
SHARD_IDS, ROLL_BYTES = 2048, 8 << 20
#: Shards that a task writes, about.
TASK_SHARDS = 8
#: Payloads that are shorter are never replaced by a revisit.
LEAST_REVISIT = 100
#: Records have no capture time of their own; a fixed one keeps the files reproducible.
DATE = "2024-01-01T00:00:00Z"
#: Shards for records without an id, at most.
NULL_SHARDS = 1 << 16
_MANIFEST = "shard bigint, seq int, file string, records bigint, bytes bigint, sha256 string"
_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload_ok boolean"


def _text(value: str | None) -> str:
    """A header value on one line."""
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The id of the ``copy``-th record, from 0, of a page's rows with one payload; without a page, of a url's."""
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_text(url) if page_id is None else page_id}|{digest}|{copy}')}>"


def _headed(head: list[str], block: bytes) -> bytes:
    import hashlib

    head = [*head, f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_info(shard: int, seq: int) -> bytes:
    """The record that begins each file."""
    import uuid

    own = uuid.uuid5(uuid.NAMESPACE_URL, f"shard {shard} file {seq}")
    return _headed(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC record, uncompressed: an HTTP response with the payload, or its head alone for a revisit."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_text(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, None, digest, 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return _headed(head, block)


def parse_record(raw: bytes) -> tuple | None:
    """The fields of ``_RECORDS`` from one uncompressed record; None for a file's own one."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    ok = whole and (kind == "revisit" or (hashlib.sha256(payload).hexdigest() == digest and len(payload) == int(fields["X-Payload-Length"])))
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("X-Page-Id"), int(fields["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page-Id"), fields["WARC-Target-URI"], ok


def _open(folder: str):
    """Any file system that Arrow knows by its URI, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest and refers_to of each record that another one replaces. Only ids and digests are shuffled."""
    narrow = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).filter(F.col("n") >= least).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return common.looked_up(narrow, first, "digest", "inner").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, shard_ids: int = SHARD_IDS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the committed manifest.

    Of records with equal payloads of 100 bytes or more, the one with the least
    page_id is the response. Null html is an empty payload, null url an empty one; a
    record without id is a response, in shards of its own, sorted by content.
    Repeated rows are records of their own, with ids of their own; so are rows that
    share a page_id, in the order of their payload digests and urls. Payloads of any
    length are written whole. An empty table gives an empty manifest. Other columns,
    whatever their names, are not written.
    """
    spark = pages.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            payloads = common.as_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([packer.compress(p) for p in payloads], pa.binary())],
                names=["page_id", "url", "digest", "packed"],
            )

    full = common.map_batches(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html"), pack, "page_id bigint, url string, digest string, packed binary")
    both = revisits(pages).select(F.col("page_id").cast("bigint"), F.lit(None).cast("string").alias("url"), "digest", F.lit(None).cast("binary").alias("packed"), F.col("refers_to").cast("bigint")).unionByName(
        full.withColumn("refers_to", F.lit(None).cast("bigint"))
    )
    shard = F.when(F.col("page_id").isNotNull(), F.floor(F.col("page_id") / shard_ids)).otherwise(-1 - F.pmod(F.xxhash64("digest", "url"), F.lit(NULL_SHARDS)))
    # decisions come before the records of their page, so one pass over the sorted rows writes the files
    rows = both.withColumn("shard", shard.cast("bigint")).withColumn("is_record", F.col("packed").isNotNull())
    # a shard is a range of ids already; dealing whole shards by hash needs no sampling pass over the payloads. Tasks grow in number, not in size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // (TASK_SHARDS * shard_ids)))
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "page_id", "is_record", "digest", "url").select("shard", "page_id", "url", "digest", "packed", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        store, base = _open(folder)
        store.create_dir(f"{base}/data", recursive=True)
        store.create_dir(f"{base}/_temporary", recursive=True)
        done: list[tuple] = []
        now: dict = {}

        def finish() -> None:
            if now.get("out"):
                now["out"].close()
                # the name tells the bytes, so a file that is there already, from another run of this task, is the same
                name = f"data/{'null' if now['shard'] < 0 else 'pages'}-{abs(now['shard']):012d}-{now['seq']:05d}-{now['sha'].hexdigest()[:16]}.warc.gz"
                if store.get_file_info(f"{base}/{name}").type.name == "NotFound":
                    store.move(now["temporary"], f"{base}/{name}")
                else:
                    store.delete_file(now["temporary"])
                done.append((now["shard"], now["seq"], name, now["records"], now["bytes"], now["sha"].hexdigest()))
                now["out"] = None

        def put(shard: int, raw: bytes) -> None:
            if now.get("shard") != shard:
                finish()
                now.clear()
                now.update(shard=shard, seq=-1)
            elif now["out"] and now["bytes"] >= roll_bytes:
                finish()
            if not now.get("out"):
                path = f"{base}/_temporary/{uuid.uuid4().hex}"
                now.update(out=store.open_output_stream(path, compression=None), temporary=path, seq=now["seq"] + 1, records=0, bytes=0, sha=hashlib.sha256())
                add(file_info(shard, now["seq"]))
            add(raw)
            now["records"] += 1

        def add(raw: bytes) -> None:
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(raw) + squeeze.flush()
            now["out"].write(member)
            now["sha"].update(member)
            now["bytes"] += len(member)

        page, decided, last, copy = None, {}, None, 0
        for batch in batches:
            for shard, page_id, url, digest, packed, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id != page:
                    page, decided = page_id, {}
                if packed is None:
                    decided[digest] = refers_to
                else:
                    own = page_id, digest, url if page_id is None else None
                    copy = copy + 1 if last == own else 0
                    last = own
                    put(shard, record(page_id, url, unpacker.decompress(packed), digest, decided.get(digest), copy))
            yield from manifest(done)
        finish()
        yield from manifest(done)

    def manifest(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "seq", "file", "records", "bytes", "sha256"])

    common.map_batches(dealt, save, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    common.delete_path(spark, f"{folder}/_temporary")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after another, each decompressed."""
    pending, unzip, out = b"", zlib.decompressobj(31), []
    while data := pending or stream.read(block):
        out.append(unzip.decompress(data))
        pending = unzip.unused_data
        if unzip.eof:
            yield b"".join(out)
            unzip, out = zlib.decompressobj(31), []
    if b"".join(out):
        raise ValueError("the archive ends inside a record")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that ``manifest`` lists; a file that differs from its manifest row is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = [r for r in map(parse_record, members(stream)) if r is not None]
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records, {records} in the manifest")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
                names = [x.split()[0] for x in _RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return common.map_batches(manifest.select("file", "records").repartition(files, "file"), run, _RECORDS)
