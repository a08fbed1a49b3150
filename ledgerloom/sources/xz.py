"""xz archives of lines as a data source: one partition for each block of a file's index.

An xz file is a row of streams, each a row of blocks that can be unpacked on their own; an index at the end of each stream tells
where they are. The plan reads only these indexes. A task unpacks its block a piece at a time and owns the lines that begin
after a line end within it, the file's first block also the file's first line; it reads on into the next blocks until its
last line ends. A file written as one block is one task, and it is unpacked as a stream of any length.
"""

import lzma
import struct
import zlib
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, TAIL = b"\xfd7zXZ\x00", b"YZ"
PIECE = 1 << 20  # bytes unpacked or read at once
ROWS = 4096  # lines handed on at once


@dataclass
class Block(InputPartition):
    path: str
    number: int
    place: tuple  # flags of the stream, offset, size


def _open(path: str):
    """A seekable file of whatever store the path names."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, low ones first, and the place behind it."""
    value, shift = 0, 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def blocks(file) -> list[tuple[bytes, int, int]]:
    """(stream flags, offset, size with padding) of every block of a file, in order."""
    end, out = file.size(), []
    while end:
        if end % 4 or end < 24:
            raise ValueError("not a whole xz file")
        file.seek(end - 12)
        footer = file.read(12)
        if footer[8:] == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        if footer[10:] != TAIL:
            raise ValueError("not an xz file")
        size = 4 * (struct.unpack("<I", footer[4:8])[0] + 1)
        file.seek(end - 12 - size)
        index = file.read(size)
        if index[:1] != b"\0" or struct.pack("<I", zlib.crc32(index[:-4])) != index[-4:]:
            raise ValueError("the index of an xz file is damaged")
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            unpadded, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append(unpadded + -unpadded % 4)
        begin = end - 12 - size - sum(sizes)
        file.seek(begin - 12)
        head = file.read(12)
        if head[:6] != MAGIC:
            raise ValueError("not an xz file")
        places = []
        for n in sizes:
            places.append((head[6:8], begin, n))
            begin += n
        out = places + out
        end -= 12 + size + sum(sizes) + 12
    return out


def unpacked(file, place):
    """The pieces of a block."""
    flags, offset, size = place
    unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    piece = unpack.decompress(MAGIC + flags + struct.pack("<I", zlib.crc32(flags)), PIECE)
    file.seek(offset)
    while size or not unpack.needs_input:
        if unpack.needs_input:
            data = file.read(min(size, PIECE))
            if not data:
                raise EOFError("an xz file ends within a block")
            size -= len(data)
        else:
            data = b""
        piece = unpack.decompress(data, PIECE)
        if piece:
            yield piece


def owned_lines(file, part: Block):
    """The lines, without their ends, that begin in a block."""
    rest, started = b"", part.number == 0
    for piece in unpacked(file, part.place):
        data = rest + piece
        if not started:
            _, end, data = piece.partition(b"\n")
            started = bool(end)
            if not started:
                continue  # of a line that began before, nothing is kept
        *lines, rest = data.split(b"\n")
        yield from lines
    if not started:
        return
    parts = [rest]
    for place in blocks(file)[part.number + 1:]:  # the last line ends there
        for piece in unpacked(file, place):
            line, end, _ = piece.partition(b"\n")
            parts.append(line)
            if end:
                yield b"".join(parts)
                return
    if any(parts):
        yield b"".join(parts)


class XzReader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as file:
                found = blocks(file)
            out += [Block(path, k, place) for k, place in enumerate(found)]
        return out

    def read(self, part):
        import pyarrow as pa

        def batch(lines):
            values = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([part.path] * len(values), pa.string())],
                                              names=["value", "_file"])

        if not isinstance(part, Block):  # files without a block
            return
        with _open(part.path) as file:
            held = []
            for line in owned_lines(file, part):
                held.append(line)
                if len(held) == ROWS:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class XzLines(DataSource):
    """Format `xz_lines`: value, _file. Option `paths`: one path a line."""

    @classmethod
    def name(cls):
        return "xz_lines"

    def schema(self):
        return "value string, _file string"

    def reader(self, schema):
        return XzReader(self.options["paths"].split("\n"))
