"""Text files in any of several encodings, read by byte ranges.

A Spark data source whose partitions are ranges of a file's bytes. A range owns the lines that begin in it: it skips to the first line end
before its own start and reads past its end to finish the last line, so every line is read once. All encodings allowed here write a line end
as the one byte 0x0A and use that byte for nothing else, which makes line ends safe to find before the encoding is known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelspark.sources.readers import ENCODINGS

#: Bytes of one range, bytes read at once, bytes of one batch of lines.
RANGE, BLOCK, BATCH = 32 << 20, 1 << 20, 4 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_of(file, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes without the line end) of the lines that begin at ``start`` or later and before ``end``."""
    at = max(0, start - 1)
    file.seek(at)
    rest, skip = b"", start > 0
    while True:
        data = file.read(block)
        rest += data
        pieces = rest.split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if skip:
                skip = False  # the end of a line that begins before this range
            elif at >= end:
                return
            else:
                yield at, piece.removesuffix(b"\r")
            at += len(piece) + 1
        if at >= end:
            return
        if len(data) < block:
            if rest and not skip:
                yield at, rest.removesuffix(b"\r")
            return


class LineReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        # hidden files and markers of finished jobs are no data
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, a, min(a + self.size, f.size)) for f in files for a in range(0, f.size, self.size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file holds a byte
            return
        system, _ = _open(self.path)
        names = ["file", "line_no", "raw"]
        with system.open_input_file(partition.path) as file:
            at, raw, held = [], [], 0
            for offset, line in lines_of(file, partition.start, partition.end):
                at.append(offset)
                raw.append(line)
                held += len(line) + 8
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at)), pa.array(at), pa.array(raw, pa.binary())], names)
                    at, raw, held = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at)), pa.array(at), pa.array(raw, pa.binary())], names)


class LineSource(DataSource):
    """``spark.read.format("line_ranges").option("range_bytes", n).load(path)``: (file, line_no, raw); line_no is the line's byte offset."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, line_no long, raw binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LineReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))


def raw_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format("line_ranges").option("range_bytes", range_bytes).load(path)


def decoded(lines: DataFrame, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(file, line_no, text): every file in the first encoding that fits all of its lines; a file that none fits is an error."""
    encodings = list(encodings)

    @F.pandas_udf(T.LongType())
    def fitting(raw: pd.Series) -> pd.Series:
        out = np.zeros(len(raw), np.int64)
        for i, line in enumerate(raw):
            for bit, encoding in enumerate(encodings):
                try:
                    bytes(line).decode(encoding)
                    out[i] |= 1 << bit
                except UnicodeDecodeError:
                    pass
        return pd.Series(out)

    @F.pandas_udf(T.StringType())
    def text(raw: pd.Series, bit: pd.Series) -> pd.Series:
        return pd.Series([bytes(line).decode(encodings[b]) for line, b in zip(raw, bit)], dtype=object)

    fits = lines.groupBy("file").agg(F.bit_and(fitting("raw")).alias("_fits"))
    first = F.array_min(F.filter(F.array(*[F.when(F.col("_fits").bitwiseAND(1 << i) != 0, F.lit(i)) for i in range(len(encodings))]), lambda i: i.isNotNull()))
    none = F.raise_error(F.concat(F.lit("no encoding fits "), F.col("file"))).cast("int")
    chosen = fits.select("file", F.coalesce(first, none).alias("_bit"))
    return lines.join(chosen, "file").select("file", "line_no", text("raw", "_bit").alias("text"))


def read_lines(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, range_bytes: int = RANGE) -> DataFrame:
    """(file, line_no, text) of the text files under ``path``, large ones in several tasks. ``line_no`` orders a file's lines."""
    return decoded(raw_lines(spark, path, range_bytes), encodings)
