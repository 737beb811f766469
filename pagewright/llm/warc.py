"""WARC archives and their chunked record table.

The data source `warc_archive` writes rows as gzipped WARC/1.1 records and reads the archives back as rows of
(record, chunk number), a key of the table: a record's id names its page, its archive and its place there. Payloads of any size are streamed piece by piece, each row carrying the digest and size of
the payload so far, so no record is ever held whole; the row of the last chunk has the digest of it all.

Records with equal payloads of a given size at least are deduplicated: the one with the smallest id is the response,
the others are revisits that name it. A digest that a large part of all records share is served by a bounded
broadcast; the rest meet by a shuffle.

Edge cases: null html counts as empty; payloads below the least size, and records with a null id, are never revisits
nor referred to; a repeated id with the smallest id's own payload is a response again; null or odd URLs are left out
or escaped in the header; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from pagewright.llm import archives
from pagewright.llm.common import hot_left_join
from pagewright.session import shared_dir

#: Least payload for a revisit; bytes of a chunk; rows of an Arrow batch.
LEAST, CHUNK, ROWS, LEVEL = 100, 1 << 20, 512, 1
COLUMNS = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())]


class WarcArchive(DataSource):
    """Options: path; range_bytes; chunk_bytes; payload (false leaves the chunks' bytes out, not their digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def schema(self) -> str:
        return "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def header(page_id, place: str, url, kind: str, refers_to, refers_to_url, size: int, digest: str, stored_size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{place}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    uri = lambda x: quote(x, safe="!#$%&()*+,/:;=?@[]~")
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    if refers_to is not None:
        # The response's own record id is known only to the task that writes it; its page and address are told instead.
        lines += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {uri(refers_to_url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {stored_size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows are (page_id, url, payload, refers_to, refers_to_url)."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        archive = archives.ArchiveFile(self.path, ".warc.gz")
        for b in iterator:
            for page_id, url, payload, refers_to, refers_to_url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                view = memoryview(payload.as_buffer() if payload.is_valid else b"")
                body = view if refers_to is None else view[:0]
                gz = zlib.compressobj(LEVEL, wbits=31)
                archive.begin()
                place = f"{archive.name.partition('.')[0]}:{archive.at}"
                archive.write(gz.compress(header(page_id, place, url, "response" if refers_to is None else "revisit", refers_to, refers_to_url, len(view), hashlib.sha256(view).hexdigest(), len(body))))
                for lo in range(0, len(body), CHUNK):
                    archive.write(gz.compress(body[lo : lo + CHUNK]))
                archive.write(gz.compress(b"\r\n\r\n") + gz.flush())
        return archive.close()

    def commit(self, messages):
        archives.commit(self.path, messages)

    def abort(self, messages):
        pass


class Stream:
    """A gzip member read a little at a time, again from where it stopped if the store fails."""

    def __init__(self, fs, place: str, offset: int, end: int, block: int):
        self.fs, self.place, self.at, self.end, self.block = fs, place, offset, end, block
        self.file, self.gz, self.held = None, zlib.decompressobj(wbits=31), b""

    def _raw(self) -> bytes:
        def once():
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.place)
                    self.file.seek(self.at)
                data = self.file.read(min(self.block, self.end - self.at))
                if not data:
                    raise OSError(f"{self.place} ends early")
                return data
            except OSError:
                self.file = None
                raise

        data = archives.retried(once)
        self.at += len(data)
        return data

    def more(self, most: int) -> bytes:
        """Up to `most` bytes; empty at the end."""
        while True:
            data = self.gz.unconsumed_tail
            if not data and self.at < self.end and not self.gz.eof:
                data = self._raw()
            if out := self.gz.decompress(data, most):  # without data, what it still holds back
                return out
            if self.gz.eof or (not data and self.at >= self.end):
                return b""

    def head(self) -> dict[str, str]:
        data = b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            if not (got := self.more(4096)):
                raise ValueError("a record without an end of header")
            data += got
        self.held = data[cut + 4 :]
        return dict(x.split(": ", 1) for x in data[:cut].decode().split("\r\n")[1:])

    def exactly(self, n: int, most: int):
        """The next n bytes in chunks of `most`."""
        while n:
            part = [self.held[: min(most, n)]]
            self.held = self.held[len(part[0]) :]
            size = len(part[0])
            while size < min(most, n):
                got = self.more(min(most, n) - size)
                if not got:
                    raise ValueError("a record ends early")
                part.append(got)
                size += len(got)
            yield b"".join(part)
            n -= size

    def close(self):
        if self.file is not None:
            self.file.close()


def _number(text: str | None):
    return int(text) if text else None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.chunk = options["path"], int(options.get("range_bytes", archives.RANGE)), int(options.get("chunk_bytes", CHUNK))
        self.payload = options.get("payload", "true") != "false"

    def partitions(self):
        return archives.ranges(self.path, self.size) or [archives.Range("", 0, 0)]

    def read(self, part):
        if not part.name:
            return
        fs, base = archives.opened(self.path)
        rows, held = [], 0
        for offset, end in archives.members(self.path, part):
            for row in self.record(Stream(fs, f"{base}/{part.name}", offset, end, 1 << 18)):
                rows.append(row)
                held += len(row[6] or b"")
                if len(rows) >= ROWS or held >= 2 * self.chunk:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def record(self, stream: Stream):
        head = stream.head()
        kind, size = head["WARC-Type"], int(head["Content-Length"])
        told = head["WARC-Payload-Digest"].removeprefix("sha256:")
        front = (head["WARC-Record-ID"], _number(head["WARC-Record-ID"].split(":")[2]), kind, _number(head.get("X-Refers-To-Page")), head.get("WARC-Target-URI"))
        if kind == "revisit":  # holds no payload; the header tells of it
            yield (*front, 0, b"" if self.payload else None, int(head["X-Payload-Length"]), told, True)
        else:
            digest, done, number = hashlib.sha256(), 0, 0
            for data in stream.exactly(size, self.chunk):
                digest.update(data)
                done += len(data)
                yield (*front, number, data if self.payload else None, done, digest.hexdigest(), done == size)
                number += 1
            if not size:
                yield (*front, 0, b"" if self.payload else None, 0, digest.hexdigest(), True)
            if digest.hexdigest() != told:
                raise ValueError(f"{front[0]}: the payload isn't the one that was written")
        stream.close()


def batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True)], [n for n, _ in COLUMNS])


def with_revisits(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, refers_to and refers_to_url (null for responses). Pages needn't have addresses."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    usable = (F.octet_length(payload) >= least) & F.col(id_col).isNotNull()
    url = F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.when(usable, F.sha2(payload, 256)).alias("digest"))
    same = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = hot_left_join(rows, same, "digest", "n", "page_id", ["first"])
    again = F.col("first.page_id") != F.col("page_id")
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_to_url"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    pages.sparkSession.dataSource.register(WarcArchive)
    with_revisits(pages, least).write.format("warc_archive").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table."""
    spark.dataSource.register(WarcArchive)
    return spark.read.format("warc_archive").option("payload", str(payload).lower()).option("chunk_bytes", chunk).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path, payload=False).where("is_last")
    return records.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
f AS (SELECT s, min(page_id) AS first_id FROM d WHERE n >= {LEAST} AND page_id IS NOT NULL GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN first_id <> page_id AND n >= {LEAST} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id AND n >= {LEAST} THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (s)
"""
