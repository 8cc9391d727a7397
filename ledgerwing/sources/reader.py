"""``spark.read.format("archive")``: the members of zip archives as rows, read by range.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").load("/data/*.zip").where("member LIKE 'res/%'")

Planning reads each archive's directory alone.  Members are dealt to partitions of about ``partitionBytes`` (a larger
one has a partition of its own), and a task reads just their bytes.  Filters on ``path`` and ``member`` (equal, IN, prefix, suffix, contained) leave
out members before anything is dealt, if ``spark.sql.python.filterPushdown.enabled`` is true; else Spark applies them later.

A member beyond ``maxBytes``, one that is encrypted or damaged, and an archive without a readable directory are rows with an
``error`` and no content.  Paths are whatever pyarrow's file systems read (local, HDFS).
"""

from __future__ import annotations

import fnmatch
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, member string, size long, crc long, content binary, error string"
PARTITION_BYTES, MAX_BYTES = 8 << 20, 256 << 20


@dataclass(frozen=True)
class Member:
    path: str
    name: str | None
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    error: str | None


@dataclass
class Members(InputPartition):
    members: tuple[Member, ...]


def files(path: str) -> Iterator[tuple[pafs.FileSystem, str]]:
    """Files that a path names: one, a folder's, or those that fit a pattern in the last part."""
    system, place = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder, _, last = place.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(place)
        found = system.get_file_info(pafs.FileSelector(place)) if info.type == pafs.FileType.Directory else [info]
    for f in sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
        yield system, f.path


def directory(system: pafs.FileSystem, path: str, most: int) -> Iterator[Member]:
    try:
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for i in z.infolist():
                if not i.is_dir():
                    error = "ENCRYPTED" if i.flag_bits & 1 else "TOO_LARGE" if i.file_size > most else "UNSUPPORTED" if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else None
                    yield Member(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, error)
    except (zipfile.BadZipFile, OSError, pa.ArrowException):
        yield Member(path, None, 0, 0, 0, 0, 0, "NOT_AN_ARCHIVE")


def content(f, m: Member) -> bytes:
    """A member's bytes: its local header, then just what it takes."""
    f.seek(m.offset)
    head = f.read(30)
    f.seek(m.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = f.read(m.packed)
    if m.method == zipfile.ZIP_DEFLATED:
        unpack = zlib.decompressobj(-15)
        raw = unpack.decompress(raw, m.size + 1)
    if len(raw) != m.size or zlib.crc32(raw) != m.crc:
        raise ValueError("damaged")
    return raw


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.part_bytes, self.most = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("maxBytes", MAX_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains) and f.attribute in (("path",), ("member",)):
                self.tests.append(f)
            else:
                yield f

    def _fits(self, m: Member) -> bool:
        for f in self.tests:
            v = m.path if f.attribute == ("path",) else m.name
            ok = v is not None and (v == f.value if isinstance(f, EqualTo) else v in f.value if isinstance(f, In) else v.startswith(f.value) if isinstance(f, StringStartsWith) else v.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in v)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Members]:
        out, run, size = [], [], 0
        for system, path in files(self.path):
            for m in directory(system, path, self.most):
                if not self._fits(m):
                    continue
                if run and size + m.packed > self.part_bytes:
                    out.append(Members(tuple(run)))
                    run, size = [], 0
                run.append(m)
                size += m.packed if m.error is None else 0
        return [*out, Members(tuple(run))]

    def read(self, partition: Members) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.split('*')[0]}")
        held, f = None, None
        for m in partition.members:
            body, error = None, m.error
            if error is None:
                if held != m.path:
                    held, f = m.path, system.open_input_file(m.path)
                try:
                    body = content(f, m)
                except (ValueError, zlib.error):
                    error = "DAMAGED"
            yield m.path, m.name, m.size, m.crc, body, error


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
