"""WARC archives: a deterministic sharded writer with revisit records, and a reader that checks digests.

Records are dealt by ranges of (page id, content) into shards whose borders depend on the rows alone, sorted inside each shard, and
written as one gzip member each into files that roll at a compressed size. Tasks write under temporary names of their own; only
when all have ended are the files they named moved to their places, and the manifest that lists them comes last. So a
task that runs twice, or an executor that is lost, leaves no trace, and equal tables give equal files.

Files are written and read by the machines' own access to the folder (pyarrow's file systems: shared mounts, object stores, HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm.common import pieces, send, small
from gridframe.session import cut_lineage

#: Payload bytes of a shard, and the number of shards at most; a shard is one task.
SHARD_BYTES, SHARDS = 4 << 20, 20_000
#: Ids that set the borders, per shard: those with the smallest hashes.
SAMPLE = 32
#: Compressed bytes at which a file is closed and the next one begun.
ROLL_BYTES = 64 << 20
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Bytes of payload that a task hashes, and of an archive that it reads, at a time.
SLICE, READ = 8 << 20, 1 << 18
#: The date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "manifest.json"
#: Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _system(folder: str):
    """pyarrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member. Line ends and other control characters in header values are percent-encoded."""
    lines = [f"{k}: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in headers]
    record = VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_id(page: int | None, digest: str, copy: int) -> str:
    """Name of a record: page id (empty for null), hex digest of the payload, number among the rows that agree in both."""
    return f"<urn:x-page:{'' if page is None else page}:{digest}:{copy}>"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int, response: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest, copy)), ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(response, digest, 0)), ("WARC-Refers-To-Date", date)]
    return _member(headers, block)


def _borders(rows: DataFrame, shards: int) -> np.ndarray:
    """Upper borders (id, hash) of all shards but the last, as rows of a structured array: even steps through the ids of smallest hash."""
    sample = rows.select("page", "mix").distinct().orderBy(F.xxhash64("page", "mix"), "page", "mix").limit(shards * SAMPLE).toArrow()
    keys = np.zeros(sample.num_rows, [("known", "i1"), ("page", "i8"), ("mix", "i8")])
    keys["known"] = sample.column("page").is_valid().to_numpy(zero_copy_only=False)
    keys["page"], keys["mix"] = sample.column("page").fill_null(0).to_numpy(), sample.column("mix").to_numpy()
    keys.sort()
    return keys[len(keys) * np.arange(1, shards) // shards] if len(keys) else keys


def write_warc(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = LEAST_REVISIT,
    roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE,
) -> DataFrame:
    """Writes one record per row below ``folder`` and returns the manifest: (file, records, bytes, sha256), by file.

    The payload is the html in UTF-8 (null: empty) behind an HTTP header. Of the rows whose payloads are equal and have ``least_revisit`` bytes or more, the one with the largest
    id is a response and the others are revisits of it, without payload; all other rows are responses.

    The number of shards follows from the payload bytes; their borders are read off the ids with the smallest hashes, SAMPLE a shard, so neither the layout of the
    input nor the number of machines plays a part. Payloads move once, to their shard. Groups of equal payloads are found
    on digests, pre-aggregated; the table of those that occur twice goes to every task if it is small and is joined by a shuffle otherwise.

    Null ids come first and count as the smallest. Rows that agree in id and payload are ordered by url; of those with the largest id the first is the response.
    If all ids of a group are null, so is what its revisits refer to. A null url has no target header; control characters and spaces of
    urls are percent-encoded. An empty table gives an empty manifest. Other columns are not read. A folder that has a manifest already is an error.
    """
    spark = pages.sparkSession
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    if system.get_file_info(f"{base}/{MANIFEST}").is_file:
        raise ValueError(f"{folder} holds archives already")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    slim = cut_lineage(rows.select("page", "digest", "size", F.xxhash64("digest").alias("mix")))
    total = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    shards = max(1, min(SHARDS, -(-((total[0] or 0) + 512 * total[1]) // shard_bytes)))
    repeated = slim.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated, _ = small(repeated.select("digest", "response", F.lit(True).alias("again")))
    borders = send(pages, _borders(slim, shards))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = borders()
        for batch in pieces(batches, 2, SLICE):
            keys = np.zeros(batch.num_rows, edges.dtype)
            keys["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys["page"] = batch.column(0).fill_null(0).to_numpy()
            keys["mix"] = batch.column(4).to_numpy()
            shard = np.searchsorted(edges, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    moved = rows.select("page", "url", "payload", "digest", F.xxhash64("digest").alias("mix"))
    moved = moved.mapInArrow(dealt, "page long, url string, payload binary, digest string, mix long, shard int")
    moved = moved.join(repeated, "digest", "left").select("shard", "page", "url", "payload", "digest", "mix", "response", F.coalesce("again", F.lit(False)).alias("again"))
    moved = moved.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("page").asc_nulls_first(), "mix", "digest", F.col("url").asc_nulls_first())
    temporary = f"_temporary-{uuid.uuid4().hex}"
    system.create_dir(f"{base}/{temporary}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        attempt = uuid.uuid4().hex
        files: list[tuple[str, str, int, int, str]] = []
        out, name, shard, last, copy, records, size, seen = None, "", None, None, 0, 0, 0, hashlib.sha256()

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files.append((f"{temporary}/{name}.{attempt}", name, records, size, seen.hexdigest()))
                out = None

        for batch in pieces(batches, 3, SLICE):
            for row in batch.to_pylist():
                if row["shard"] != shard or size >= roll_bytes:
                    close()
                    number = number + 1 if row["shard"] == shard else 0
                    shard, records, size, seen = row["shard"], 0, 0, hashlib.sha256()
                    name = f"part-{shard:05d}-{number:05d}.warc.gz"
                    out = system.open_output_stream(f"{base}/{temporary}/{name}.{attempt}", compression=None)
                    fields = f"software: gridframe\r\nformat: {VERSION.decode()}\r\n".encode()
                    head = [
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(fields))), ("WARC-Block-Digest", _sha1(fields)),
                    ]
                    member = _member(head, fields)
                    out.write(member)
                    seen.update(member)
                    size += len(member)
                same = (row["page"], row["digest"])
                copy = copy + 1 if same == last else 0
                last = same
                revisit = row["again"] and not (row["page"] == row["response"] and copy == 0)
                member = _record(row["page"], row["url"], row["payload"], row["digest"], copy, row["response"], revisit, date)
                out.write(member)
                seen.update(member)
                records, size = records + 1, size + len(member)
        close()
        columns = [list(c) for c in zip(*files, strict=True)] if files else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["temporary", "file", "records", "bytes", "sha256"])

    written = cut_lineage(moved.mapInArrow(write, "temporary string, file string, records long, bytes long, sha256 string"))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        for batch in batches:
            for source, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{base}/{source}").is_file:  # else a lost task has moved it before
                    system.move(f"{base}/{source}", f"{base}/{file}")
            yield batch.select([1, 2, 3, 4])

    manifest = cut_lineage(written.mapInArrow(commit, "file string, records long, bytes long, sha256 string").orderBy("file"))
    with system.open_output_stream(f"{base}/{temporary}/{MANIFEST}", compression=None) as out:
        for line in manifest.toJSON().toLocalIterator():
            out.write(line.encode() + b"\n")
    system.move(f"{base}/{temporary}/{MANIFEST}", f"{base}/{MANIFEST}")
    system.delete_dir(f"{base}/{temporary}")
    return manifest


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one whole record at a time."""
    data, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(READ)
            if not data:
                break
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError(f"no WARC record: {version[:40]}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if _sha1(block) != headers["warc-block-digest"]:
        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
    return headers, block


READ_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, file) for each record of committed archives.

    The files are those of the manifest, spread over tasks; each is read as a stream, one record at a time. Digests of blocks and payloads and the number of records
    are checked; a difference is an error. A revisit has no payload; its digest and size are those of the payload it stands for. Names of records that
    are not by this writer give a null ``page_id``. A folder with an empty manifest gives an empty table; one without is an error.
    """
    system, base = _system(folder)
    with system.open_input_stream(f"{base}/{MANIFEST}") as manifest:
        if not manifest.read(1):
            return spark.createDataFrame([], READ_COLUMNS)
    files = spark.read.schema("file string, records long").json(f"{folder}/{MANIFEST}")
    names = [f.split()[0] for f in READ_COLUMNS.split(", ")]

    def page_of(name: str) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+):.*>", name)
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        kinds = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True))

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names)

        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, met = [], 0, 0
                with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for record in _members(stream):
                        headers, block = _parse(record)
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, kind, refers, payload if kind == "response" else None, file))
                        met, held = met + 1, held + len(payload) + 200
                        if held > SLICE:
                            yield packed(rows)
                            rows, held = [], 0
                if met != records:
                    raise ValueError(f"{file} has {met} records, its manifest says {records}")
                if rows:
                    yield packed(rows)

    return files.repartition(max(1, min(SHARDS, files.count()))).mapInArrow(read, READ_COLUMNS)
