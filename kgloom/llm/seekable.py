"""Zstandard files of independent frames with a trailing seek table.

Layout (the public seekable format): data frames, optional skippable frames with
an index of the writer, then one skippable frame that lists for each data frame
its compressed size, its plain size and the low 32 bits of its xxhash64.  Any
Zstandard reader can read the file through; ``Reader`` opens single frames.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs
import xxhash
import zstandard

# Fixed values of the public format.
SKIPPABLE, INDEX, TABLE_FOOTER, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def attempt_name(partition: int, suffix: str) -> str:
    """Every attempt of a task writes a file of its own; the committed table names the one that counts."""
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


class Writer:
    def __init__(self, folder: str, name: str, level: int = 3):
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        self.path = f"{folder.rstrip('/')}/{name}"
        self._out = fs.open_output_stream(f"{at.rstrip('/')}/{name}", compression=None)
        self._zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._table: list[tuple[int, int, int]] = []

    def frame(self, data: bytes) -> int:
        """Append a frame; returns its number."""
        packed = self._zip.compress(data)
        self._out.write(packed)
        self._table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self._table) - 1

    def close(self, index: bytes = b"") -> None:
        if index:
            packed = self._zip.compress(index)
            self._out.write(struct.pack("<II", INDEX, len(packed)) + packed)
        body = b"".join(struct.pack("<III", *row) for row in self._table)
        self._out.write(struct.pack("<II", SKIPPABLE, len(body) + 9) + body
                        + struct.pack("<IBI", len(self._table), CHECKSUMS, TABLE_FOOTER))
        self._out.close()


class Reader:
    def __init__(self, path: str):
        fs, at = opened(path)
        self._in = fs.open_input_file(at)
        size = self._in.size()
        n, flags, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != TABLE_FOOTER or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        head = size - 9 - 12 * n - 8
        self.table = list(struct.iter_unpack("<III", self._in.read_at(12 * n, head + 8)))
        self.offsets = [0]
        for packed, _, _ in self.table:
            self.offsets.append(self.offsets[-1] + packed)
        self._unzip = zstandard.ZstdDecompressor()
        self.index = b""
        if self.offsets[-1] < head:
            magic, length = struct.unpack("<II", self._in.read_at(8, self.offsets[-1]))
            if magic != INDEX:
                raise ValueError(f"{path}: no index where it should be")
            self.index = self._unzip.decompress(self._in.read_at(length, self.offsets[-1] + 8))

    def frame(self, k: int) -> bytes:
        packed, plain, check = self.table[k]
        data = self._unzip.decompress(self._in.read_at(packed, self.offsets[k]), max_output_size=plain)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self._in.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
