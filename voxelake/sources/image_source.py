"""Image files as a data source: ``spark.read.format("image_elements").load(folder)``.

Partitions are planned by bytes: files, in the order of their paths, are put together up to
``splitBytes``, each with ``OPEN`` for its opening; a file is never cut. With ``pixels`` false a task reads a file's first bytes
only, more of them until the pixel data begins, and never what comes from there on; it
then counts with the bytes that it is expected to read. ``tags`` (hex, comma-separated)
keeps the elements of those tags, at any depth. Broken files are rows with a reason.
``bytes_read`` says how much of the file was read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from voxelake.sources import part10
from voxelake.sources.packed_source import located

NAME = "image_elements"
SCHEMA = part10.ELEMENT + ", reason string, bytes_read long"
#: What is read first of a file whose pixels are not asked for.
HEAD = 1 << 16
#: Bytes that opening a file counts as: a task of small files is bounded by their number.
OPEN = 1 << 15


@dataclass
class Files(InputPartition):
    paths: list[str]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", 64 << 20))
        self.pixels = options.get("pixels", "true").lower() != "false"
        self.tags = [int(t, 16) for t in options.get("tags", "").split(",") if t]

    def partitions(self) -> list[Files]:
        store, root = located(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.size >= 136)
        out, held = [[]], 0
        for path, size in found:
            size = (size if self.pixels else min(size, HEAD)) + OPEN
            if out[-1] and held + size > self.split:
                out.append([])
                held = 0
            out[-1].append(path)
            held += size
        return [Files(p) for p in out]

    def read(self, p: Files) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        for path in p.paths:
            with store.open_input_file(path) as f:
                data, end = self.part(f)
            rows = part10.element_rows(path, data, end)
            if self.tags:
                rows = rows.filter(pc.or_(pc.is_in(rows["tag"], pa.array(self.tags, pa.int64())), pc.is_valid(rows["reason"])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(data)] * rows.num_rows, pa.int64())], [*rows.schema.names, "bytes_read"])

    def part(self, f: pa.NativeFile) -> tuple[bytes, int | None]:
        """As much of the file as is asked for, and where its pixel data begins if it stops there."""
        if self.pixels:
            return f.read(), None
        data, more = f.read(HEAD), HEAD
        while True:
            try:
                rows = part10.Reader(data).parse()
            except (part10.Broken, struct.error):
                rows = []
            begins = next((r[4] for r in rows if r[2] == part10.PIXELS and r[0] in ((), (part10.PIXELS,))), None)
            if begins is not None:
                return data, begins
            new = f.read(more)
            if not new:
                return data, None
            data, more = data + new, more * 2


class ImageElements(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ImageReader(self.options)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ImageElements)
    return spark.read.format(NAME).options(**options).load(path)
