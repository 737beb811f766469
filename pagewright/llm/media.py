"""Media columns: payloads in image archives behind a custom Spark data source.

The data source `image_archive` writes binary payloads as 8-bit images (PNG, 64 pixels of 3 samples a row, so a
payload is a positive multiple of 192 bytes) into tar archives, and reads them back: byte-range partitions planned
over the archive directory, members read by offset through one open file a partition and retried each on its own, batches
streamed through Arrow.

Edge cases: null text counts as empty; the empty text is one row of 192 spaces; rows with a null key, and rows that
repeat, are members of their own; an empty table gives an empty archive directory and no rows; a member that stays
unreadable fails the read, never silently goes missing.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from pagewright.llm import archives
from pagewright.session import shared_dir

ROW, LEVEL = 192, 1
#: Payload bytes of an Arrow batch, about.
BATCH = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A PNG file whose samples are the payload; the same bytes for the same payload."""
    rows = np.frombuffer(payload, "u1").reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), "u1")  # each line begins with its filter: none
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_image(data: bytes) -> bytes:
    if data[:8] != SIGNATURE:
        raise OSError("not an image")
    at, idat, height = 8, [], 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise OSError("damaged image")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(idat)), "u1").reshape(height, ROW + 1)[:, 1:].tobytes()


class ImageArchive(DataSource):
    """Options: path; range_bytes. Columns: key (string), n_bytes (before padding), archive, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "image_archive"

    def schema(self) -> str:
        return "key string, n_bytes long, archive string, offset long, media binary"

    def reader(self, schema):
        return ImageReader(self.options)

    def writer(self, schema, overwrite):
        return ImageWriter(self.options)


class ImageWriter(DataSourceArrowWriter):
    """Rows are (key, payload): text in UTF-8, padded here."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        archive = archives.ArchiveFile(self.path, ".tar")
        for batch in iterator:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                image = encode_image(raw + b" " * (-len(raw) % ROW if raw else ROW))
                head = tarfile.TarInfo(f"{'' if key is None else key}.{len(raw)}.png")
                head.size = len(image)
                archive.begin()
                archive.write(head.tobuf(tarfile.USTAR_FORMAT) + image + b"\0" * (-len(image) % 512))
        return archive.close(b"\0" * 1024 if archive.offsets else b"")

    def commit(self, messages):
        archives.commit(self.path, messages)

    def abort(self, messages):
        pass  # without a manifest nothing is ever read


class ImageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("range_bytes", archives.RANGE))

    def partitions(self):
        return archives.ranges(self.path, self.size) or [archives.Range("", 0, 0)]

    def read(self, part):
        if not part.name:
            return
        fs, base = archives.opened(self.path)
        source, rows, size = archives.Member(fs, f"{base}/{part.name}"), [], 0
        for offset, end in archives.members(self.path, part):
            data = source.read(offset, end)
            head = tarfile.TarInfo.frombuf(data[:512], "utf-8", "strict")
            image = data[512 : 512 + head.size]
            if len(image) != head.size:
                raise OSError(f"{part.name}: the member at {offset} is cut short")
            key, n, _ = head.name.rsplit(".", 2)
            rows.append((key or None, int(n), part.name, offset, image))
            size += end - offset
            if size >= BATCH:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)
        source.close()


def batch(rows) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["key", "n_bytes", "archive", "offset", "media"])


def write_images(rows: DataFrame, path: str) -> None:
    """rows: key (string) and text."""
    rows.sparkSession.dataSource.register(ImageArchive)
    rows.write.format("image_archive").mode("append").save(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ImageArchive)
    return spark.read.format("image_archive").load(path)


def feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples and the mean of each colour."""
    x = np.frombuffer(payload, "u1")
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};rgb={','.join(f'{c:.3f}' for c in x.reshape(-1, 3).mean(0))}"


def digests(images: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            out = []
            for key, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = media.as_py()
                payload = decode_image(raw)
                out.append((None if key is None else int(key), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return images.select("key", "n_bytes", "media").mapInArrow(run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    write_images(docs.select(F.col("doc_id").cast("string").alias("key"), "text"), path)
    return digests(read_images(spark, path))
