"""A data source of the lines of raw CSV files and of CSV files inside ZIP archives.

Spark asks it for partitions (parts of large files, several small files together) and each task
reads its own, a block of bytes at a time.  A file that cannot be opened, decompressed or decoded
gives one row with an error in place of its remaining lines and fails nothing else.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINE_SCHEMA = "source_file string, split_start bigint, nth bigint, line string, error string"
_ARROW = pa.schema(
    [("source_file", pa.string()), ("split_start", pa.int64()), ("nth", pa.int64()), ("line", pa.string()), ("error", pa.string())]
)
#: Bytes read from a file or an archive at a time.
BLOCK_BYTES = 4 << 20
#: Bytes that a further file adds to a partition besides its own.
OPEN_COST = 1 << 20
_BOM = b"\xef\xbb\xbf"
_END = 1 << 62


@dataclass
class Piece:
    """Lines of one file that begin from start on and before end."""

    path: str
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it; Arrow's are reachable from every task."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def is_archive(path: str) -> bool:
    return path.lower().endswith(".zip")


def owned_lines(read: Callable[[int], bytes], first: int, start: int, end: int) -> Iterator[bytes]:
    """Blocks of whole lines that begin in [start, end); read goes on from byte ``first`` <= start.

    A line ends with a line feed, a carriage return or both; blank lines mean nothing here, so
    either sign counts as an end.  Memory: a block and the longest line.
    """
    at, held, skipping = first, b"", first < start
    while at < end:
        block = read(BLOCK_BYTES)
        held += block.replace(b"\r", b"\n")
        if skipping:  # the line around ``first`` belongs to the part before
            cut = held.find(b"\n") + 1
            if not cut:
                if not block:
                    return
                at, held = at + len(held), b""
                continue
            at, held, skipping = at + cut, held[cut:], False
            if at >= end:
                return
        cut = held.rfind(b"\n") + 1 if block else len(held)
        if at + cut > end:
            last = held.find(b"\n", end - 1 - at) + 1
            if last:
                yield held[:last]
                return
            if block:
                continue
        if cut:
            yield held[:cut]
        at, held = at + cut, held[cut:]
        if not block:
            return


def _blocks(piece: Piece) -> Iterator[bytes]:
    system, path = file_system(piece.path)
    with system.open_input_file(path) as file:
        if is_archive(piece.path):
            with zipfile.ZipFile(file) as archive:
                members = sorted(m for m in archive.namelist() if m.lower().endswith(".csv"))
                if not members:
                    raise ValueError("no CSV file in the archive")
                with archive.open(members[0]) as member:
                    yield from owned_lines(member.read, 0, 0, _END)
        else:
            first = max(piece.start - 1, 0)
            file.seek(first)
            yield from owned_lines(file.read, first, piece.start, piece.end)


def _texts(piece: Piece) -> Iterator[list[str]]:
    """Lines that aren't blank, decoded; bytes that aren't UTF-8 are an error."""
    begun = piece.start > 0
    for block in _blocks(piece):
        if not begun:
            block, begun = block.removeprefix(_BOM), True
        yield [line for line in block.decode("utf-8").split("\n") if line.strip()]


def piece_rows(piece: Piece, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Numbered lines of a piece, the first ``most`` of them, then the error that ended it, if any."""

    def batch(nth: int, lines: list, errors: list) -> pa.RecordBatch:
        n = len(lines)
        columns = [[piece.path] * n, [piece.start] * n, range(nth, nth + n), lines, errors]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    nth = 0
    try:
        for lines in _texts(piece):
            lines = lines[: None if most is None else most - nth]
            if lines:
                yield batch(nth, lines, [None] * len(lines))
            nth += len(lines)
            if nth == most:
                return
    except Exception as error:  # any failure of one file is a row, the others go on
        yield batch(nth, [None], [f"{type(error).__name__}: {error}"])


def cut_pieces(sizes: Sequence[tuple[str, int]], most: int, heads: bool) -> list[Pieces]:
    """Partitions of about ``most`` bytes: a large CSV file is cut, small files share one.

    An archive can't be cut.  For the first lines alone only the start of a file is read.
    """
    out, held, filled = [], [], 0
    for path, size in sizes:
        whole = heads or is_archive(path) or size <= most
        for start in [0] if whole else range(0, size, most):
            end = _END if whole or start + most >= size else start + most
            weight = OPEN_COST + (0 if heads else min(most, size - start) if not is_archive(path) else size)
            if held and filled + weight > most:
                out.append(Pieces(held))
                held, filled = [], 0
            held.append(Piece(path, start, end))
            filled += weight
    return out + [Pieces(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["files"])
        self.heads = options.get("heads", "false") == "true"
        self.most = int(options["bytes"])

    def partitions(self) -> list[Pieces]:
        return cut_pieces([(p, s) for p, s in self.paths], self.most, self.heads)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from piece_rows(piece, 1 if self.heads else None)


class RawLines(DataSource):
    """``files``: JSON list of (path, size); ``bytes``: bytes in a partition; ``heads``: first lines only."""

    @classmethod
    def name(cls) -> str:
        return "barline_lines"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan_lines(spark: SparkSession, sizes: Sequence[tuple[str, int]], heads: bool = False) -> DataFrame:
    """Lines of the files given with their sizes; error rows have no line."""
    spark.dataSource.register(RawLines)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    source = spark.read.format(RawLines.name()).option("files", json.dumps(list(sizes)))
    return source.option("bytes", str(most)).option("heads", str(heads).lower()).load()
