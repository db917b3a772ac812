"""Ranged reads of media files: a Python data source that plans partitions of files and reads only the boxes that lead to the sound's description.

Usage: ``spark.dataSource.register(SoundProbe)`` and ``spark.read.format("sound_probe").option("suffixes", "mp4,m4a").option("most_bytes", n).load(folder)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Boxes that hold others on the way to the sample description, and formats of sound. Fixed values of the file format.
INNER = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
SOUNDS = (b"mp4a", b"alac", b"Opus", b"sowt")
#: Files of a partition, and bytes that the entry of a description needs at most.
FILES, ENTRY = 64, 68


@dataclass
class Files(InputPartition):
    """Paths and lengths of the files of a partition."""

    found: list[tuple[str, int]]


def opened(path: str):
    """The file system of a path or URI, and the path in it: all that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def described(file, length: int) -> tuple[int | None, int | None, int]:
    """(sample rate, channels, bytes read) of the first sound track; nulls where there is none, or boxes don't fit."""
    spans, read = [(0, length)], 0
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            file.seek(at)
            raw = file.read(16)
            read += len(raw)
            size, kind, head = int.from_bytes(raw[:4], "big"), raw[4:8], 8
            if size == 1:
                size, head = int.from_bytes(raw[8:16], "big"), 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                break
            if kind in INNER:
                spans.append((at + size, end))  # what follows, once the box is done
                at, end = at + head, at + size
                continue
            if kind == b"stsd":
                file.seek(at + head)
                raw = file.read(min(ENTRY, size - head))
                read += len(raw)
                if raw[12:16] in SOUNDS:
                    rate = int.from_bytes(raw[40:42], "big")
                    if int.from_bytes(raw[8:12], "big") >= 52 and raw[48:52] == b"srat":  # a rate that 16 bits can't hold has a box of its own, of 32
                        rate = int.from_bytes(raw[56:60], "big")
                    return rate, int.from_bytes(raw[32:34], "big"), read
            at += size
    return None, None, read


class SoundProbe(DataSource):
    """(path, length, sample_rate, channels, bytes_read) of media files below a folder.

    Options: path; suffixes, comma-separated (default mp4,m4a,mov); most_bytes, a guard on the length of a file; files, those of a partition. Suffix and guard are applied when
    partitions are planned, so other files are never opened.
    """

    @classmethod
    def name(cls) -> str:
        return "sound_probe"

    def schema(self) -> str:
        return "path string, length long, sample_rate long, channels long, bytes_read long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SoundReader(self.options)


class SoundReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.suffixes = options["path"], tuple(s.strip().lower() for s in options.get("suffixes", "mp4,m4a,mov").split(","))
        self.most, self.files = int(options.get("most_bytes", 1 << 62)), int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = opened(self.folder)
        found = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        found = sorted((p, n) for p, n in found if p.rpartition(".")[2].lower() in self.suffixes and n <= self.most)
        return [Files(found[k : k + self.files]) for k in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path, length in partition.found:
            with system.open_input_file(path) as file:
                rate, channels, read = described(file, length)
            yield path, length, rate, channels, read
