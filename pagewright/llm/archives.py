"""Archive directories: files of members written by tasks, a manifest of those committed, byte ranges to read.

Each task writes one archive under a name of its own and, beside it, the offsets of its members. Only the commit on
the driver, after all tasks ended well, writes the manifest that readers go by; files of failed or repeated tasks are
never read. A read is planned from the archives' sizes alone: each partition takes the members that begin in its
range of bytes. Paths are opened through pyarrow's file systems, so they may lie in any store that those know.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

#: Bytes of a read partition; times that a member is tried.
RANGE, TRIES = 8 << 20, 3


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    members: int


@dataclass
class Range(InputPartition):
    name: str
    low: int
    high: int


class ArchiveFile:
    """An archive in the making."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.base = opened(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.offsets: list[int] = []
        self.at = 0

    def begin(self) -> None:
        self.offsets.append(self.at)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self, tail: bytes = b"") -> Written:
        """tail: what ends an archive of its kind; no member."""
        self.write(tail)
        self.out.close()
        with self.fs.open_output_stream(f"{self.base}/{self.name}.offsets") as f:
            f.write(np.array(self.offsets, "<i8").tobytes())
        return Written(self.name, self.at, len(self.offsets))


def commit(folder: str, messages) -> None:
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/MANIFEST.json") as f:
        f.write(json.dumps([[m.name, m.size] for m in messages if m is not None and m.members]).encode())


def ranges(folder: str, size: int = RANGE) -> list[Range]:
    fs, base = opened(folder)
    with fs.open_input_file(f"{base}/MANIFEST.json") as f:
        archives = json.loads(f.read())
    return [Range(name, low, min(low + size, total)) for name, total in archives for low in range(0, total, size)]


def members(folder: str, part: Range) -> list[tuple[int, int]]:
    """(offset, end) of the members that begin in the range."""
    fs, base = opened(folder)
    with fs.open_input_file(f"{base}/{part.name}.offsets") as f:
        offsets = np.frombuffer(f.read(), "<i8")
    lo, hi = np.searchsorted(offsets, [part.low, part.high])
    ends = np.append(offsets[1:], fs.get_file_info(f"{base}/{part.name}").size)
    return list(zip(offsets[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))


class Member:
    """Members of one archive, read one after the other through one open file; after a failure the file is opened anew."""

    def __init__(self, fs, place: str):
        self.fs, self.place, self.file = fs, place, None

    def read(self, offset: int, end: int) -> bytes:
        def once():
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.place)
                self.file.seek(offset)
                data = self.file.read(end - offset)
                if len(data) != end - offset:
                    raise OSError(f"{self.place} ends early")
                return data
            except OSError:
                self.close()
                raise

        return retried(once)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def retried(read, tries: int = TRIES):
    """read(), again after an I/O failure; each member on its own."""
    for k in range(tries):
        try:
            return read()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(0.2 * 2**k)
