"""WARC archives, written and read as a chunked record table.

A payload is never held whole outside its source row: it goes through Python
as rows of record identifier, chunk number and at most ``CHUNK`` bytes, in
order. The writer streams chunks into one archive for each task (one gzip
member for each record); the reader streams an archive back into chunk rows
that carry the SHA-1 of all bytes of the record so far, so the last chunk's
digest is the payload's.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
largest identifier is a ``response``; the others are ``revisit`` records, which hold
HTTP headers (with the full length) and the digest, but no payload.

Archives are written through pyarrow's file systems under the shared folder.
A task writes under a name of its own for each attempt and reports it with
its rows; only reported archives are read, so a task that is run again leaves
at most an orphan.

Edge cases: a null payload counts as empty; smaller and empty payloads are all
responses; a null identifier is written without its field and read as null,
and sorts before all others; repeated rows with the largest identifier of
their payload are all responses, and so are rows of a payload without any identifier; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import scratch_path, table, written

CHUNK = 1 << 18
REVISIT_BYTES = 1000

MANIFEST = "archive string, records long, bytes long"
CHUNKS = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, data binary, last boolean, payload_bytes long, declared_digest string, digest string"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, bytes, sha1, record_type, refers_to: what is to be written."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    keyed = rows.where(F.col("bytes") >= REVISIT_BYTES).select(F.unhex(F.sha2("payload", 256)).alias("key"), "page_id")
    # The first row of a payload needs no other: only payloads that more than one row has are looked up.
    shared = keyed.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Narrow rows only are dealt by payload. Payloads are dealt by identifier to meet their revisits, unless those are few enough to be broadcast.
    revisits = keyed.join(shared, "key").where("keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper)").select("key", F.col("page_id").alias("v_id"), "keeper").distinct()
    at = (F.col("page_id").eqNullSafe(F.col("v_id"))) & (F.unhex(F.sha2("payload", 256)) == F.col("key"))
    rows = rows.join(revisits, at, "left")
    kind = F.when(F.col("key").isNotNull(), "revisit").otherwise("response")
    return rows.select("page_id", "url", "payload", "bytes", F.sha1("payload").alias("sha1"), kind.alias("record_type"), F.when(F.col("key").isNotNull(), F.col("keeper")).alias("refers_to"))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of a record's payload, in order; revisits have one empty chunk."""
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    n = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
    return rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1))).select("page_id", "url", "record_type", "refers_to", "bytes", "sha1", "chunk_no", body.alias("data"), (F.col("chunk_no") == n - 1).alias("last"))


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_urn(page_id: int | None) -> str:
    """The same for each record of an identifier; one of its own for a record without."""
    return f"urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def head(row: dict) -> bytes:
    """The WARC header and HTTP header of a record."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{record_urn(row['page_id'])}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{row['sha1']}"]
    if row["page_id"] is not None:
        lines.append(f"WARC-X-Page-Id: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{record_urn(row['refers_to'])}>", f"WARC-X-Refers-To-Page-Id: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def writer(folder: str, level: int = 1):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        gz = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files, at = filesystem(path)
                    files.create_dir(at.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(at, compression=None)
                if row["chunk_no"] == 0:
                    gz, n = zlib.compressobj(level, zlib.DEFLATED, 31), n + 1
                    size += out.write(gz.compress(head(row))) or 0
                out.write(gz.compress(row["data"]))
                if row["last"]:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [n], "bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def write_archives(rows: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Write records (see ``records``) as .warc.gz files; returns the manifest as a table."""
    spark = rows.sparkSession
    folder = folder or scratch_path(spark, "warc")
    # Batches stay small, as a chunk may have CHUNK bytes.
    return written(chunked(rows, chunk).mapInArrow(writer(folder), MANIFEST), "manifest")


class Stream:
    """Bytes of a file of gzip members, inflated piece by piece."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece, self.left, self.gz, self.held = raw, piece, b"", None, bytearray()

    def more(self) -> bool:
        while True:
            data = self.left or self.raw.read(self.piece)
            if not data:
                return False
            self.gz = self.gz or zlib.decompressobj(31)
            self.held += self.gz.decompress(data, 1 << 20)
            self.left = self.gz.unconsumed_tail or self.gz.unused_data
            if self.gz.eof:
                self.gz = None
            if self.held:
                return True

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to and with ``end``; None at the end of the file."""
        start = 0
        while (k := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end))
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        got = bytes(self.held[: k + len(end)])
        del self.held[: k + len(end)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


def fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def reader(chunk: int, payloads: bool):
    names = [x.strip().split(" ")[0] for x in CHUNKS.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(x.strip().split(" ")[0], kinds[x.strip().split(" ")[1]]) for x in CHUNKS.split(",")])

    def chunks(path: str) -> Iterator[tuple]:
        files, at = filesystem(path)
        with files.open_input_stream(at, compression=None) as raw:
            stream = Stream(raw)
            while (block := stream.until(b"\r\n\r\n")) is not None:
                warc = fields(block.lstrip(b"\r\n"))
                http = stream.until(b"\r\n\r\n")
                body = int(warc["content-length"]) - len(http)
                whole = int(fields(http)["content-length"])
                own = lambda k: int(warc[k]) if k in warc else None
                record = (path, warc["warc-record-id"].strip("<>"), own("warc-x-page-id"), warc.get("warc-target-uri", ""), warc["warc-type"], own("warc-x-refers-to-page-id"))
                declared, so_far, k = warc["warc-payload-digest"].removeprefix("sha1:"), hashlib.sha1(), 0
                while True:
                    data = stream.take(min(chunk, body))
                    body -= len(data)
                    so_far.update(data)
                    digest = declared if warc["warc-type"] == "revisit" else so_far.hexdigest()
                    yield (*record, k, data if payloads else None, body == 0, whole, declared, digest)
                    k += 1
                    if not body:
                        break
                if stream.take(4) != b"\r\n\r\n":
                    raise ValueError(f"no end of record in {path}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                for row in chunks(path):
                    rows.append(row)
                    size += 200 + len(row[7] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema, strict=True)], schema=schema)

    assert names == schema.names
    return read


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` (column archive) names."""
    spread = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return spread.mapInArrow(reader(chunk, payloads), CHUNKS)


def payloads_of(chunks: DataFrame) -> DataFrame:
    """One row for each record from its last chunk; a digest that differs from the declared one is an error."""
    broken = F.raise_error(F.concat(F.lit("payload digest differs in record "), F.col("record_id")))
    digest = F.when(F.col("digest") == F.col("declared_digest"), F.col("digest")).otherwise(broken)
    return chunks.where("last").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(records(table(spark, sf_dir, "pages")))
    return payloads_of(read_archives(manifest, payloads=False))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM r
"""
