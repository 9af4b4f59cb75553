"""Packed volumes as a data source: ``spark.read.format("packed_volumes")`` and ``df.write.format(...)``.

A folder holds a manifest, and a headerless file of 16-bit voxels for each volume and
each preview. Writing takes slab blobs sorted by volume and slab: each task streams its
volumes to files of the write's own name, and only the commit moves them to their
place and then writes the manifest, last. A write that fails leaves no manifest and
none of its files. Reading plans partitions by bytes, whole slices each, from the manifest alone; the
option ``volumes`` (names, comma-separated) and ``kind`` (full, preview) leave out the rest
before any blob is opened. A file whose length is not the manifest's is an error.

Paths go through Arrow's file systems, so that they may lie in any shared store that
those know (file, hdfs, s3, ...).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from voxelake.sources import packed

NAME = "packed_volumes"
#: What is written: a blob of whole slices; ``sidecar`` (JSON) and ``series_number`` are the same in all of a volume's rows.
WRITTEN = "volume_id string, series_number int, kind string, slab int, content binary, sidecar string"
READ = "volume_id string, series_number int, kind string, k0 int, nx int, ny int, nz int, depth int, data_type string, content binary"
ENDING = {"full": ".raw", "preview": ".preview.raw"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Slices ``k0`` to ``k0 + depth`` of one file."""

    volume_id: str
    series_number: int
    kind: str
    side: dict
    k0: int
    depth: int


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("splitbytes", 8 << 20))
        self.kinds = [k for k in ENDING if options.get("kind", k) == k]
        self.wanted = {v for v in options.get("volumes", "").split(",") if v}

    def partitions(self) -> list[Piece]:
        store, root = located(self.path)
        with store.open_input_stream(f"{root}/manifest.json") as f:
            text = json.loads(f.read())
        if text.get("format") != packed.FORMAT:
            raise ValueError(f"{self.path}: not a manifest of {packed.FORMAT}")
        out = []
        for s in text["series"]:
            for kind in self.kinds:
                if self.wanted and s["name"] not in self.wanted:
                    continue
                nx, ny, nz = s[kind]["dims"]
                depth = max(1, self.most // max(1, 2 * nx * ny))
                out += [Piece(s["name"], s["seriesNumber"], kind, s[kind], k, min(depth, nz - k)) for k in range(0, nz, depth)]
        return out

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        store, root = located(self.path)
        nx, ny, nz = p.side["dims"]
        with store.open_input_file(f"{root}/{p.side['url']}") as f:
            if f.size() != 2 * nx * ny * nz or p.side["bytes"] != f.size():
                raise ValueError(f"{p.volume_id}: {f.size()} bytes, not {2 * nx * ny * nz}")
            content = f.read_at(2 * nx * ny * p.depth, 2 * nx * ny * p.k0)
        row = (p.volume_id, p.series_number, p.kind, p.k0, nx, ny, nz, p.depth, p.side["dataType"], content)
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, under the write's own name: (file, volume, series number, kind, bytes, sidecar)."""

    files: list[tuple[str, str, int, str, int, str]]


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        store.create_dir(f"{root}/{self.job}")
        files, now, out, last = [], None, None, -1
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    key = (r["volume_id"], r["kind"])
                    if key != now:
                        if out:
                            out.close()
                        if any(f[1] == key[0] and f[3] == key[1] for f in files):
                            raise ValueError(f"{key}: rows of a volume must come one after another")
                        name = f"{self.job}/{uuid.uuid4().hex}"
                        out, now, last = store.open_output_stream(f"{root}/{name}"), key, -1
                        files.append([name, key[0], r["series_number"], key[1], 0, r["sidecar"]])
                    if r["slab"] <= last:
                        raise ValueError(f"{key}: slabs must ascend")
                    last = r["slab"]
                    out.write(r["content"])
                    files[-1][4] += len(r["content"])
        finally:
            if out:
                out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({(f[1], f[3]) for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("a volume was written by several tasks")
        if store.get_file_info(f"{root}/manifest.json").type == fs.FileType.File:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.path} holds a manifest already")
            store.delete_file(f"{root}/manifest.json")  # what it names is replaced now
        series: dict[str, dict] = {}
        for name, volume, number, kind, size, side in files:
            s = series.setdefault(volume, {"name": volume, "seriesNumber": number})
            s[kind] = json.loads(side) | {"url": volume + ENDING[kind], "bytes": size}
            store.move(f"{root}/{name}", f"{root}/{volume}{ENDING[kind]}")
        text = {"format": packed.FORMAT, "voxelOrder": "i fastest, then j, then k", "series": sorted(series.values(), key=lambda s: (s["seriesNumber"], s["name"]))}
        with store.open_output_stream(f"{root}/{self.job}/manifest") as f:
            f.write((json.dumps(text, indent=2) + "\n").encode())
        store.move(f"{root}/{self.job}/manifest", f"{root}/manifest.json")
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class PackedVolumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PackedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedVolumes)


def write(volumes: DataFrame, voxels: DataFrame, path: str, slab: int = 32, mode: str = "append") -> None:
    """Write volumes and their previews of half the resolution, with a manifest.

    ``volumes``: volume_id, series_number and what ``packed.sidecar`` reads; ``voxels``:
    volume_id, k, j, i, idx, stored. A task streams whole volumes, one slab in memory.
    """
    register(volumes.sparkSession)
    sizes = volumes.select("volume_id", *(F.get("dims", F.lit(n)).alias(c) for n, c in enumerate(("nx", "ny", "nz"))))
    small, small_sizes = packed.halved(voxels, sizes)
    wide = lambda f: F.transform("spacing", lambda x, n: F.when(n < 2, x * f).otherwise(x))
    ranged = lambda v: v.groupBy("volume_id").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"))
    moved = F.transform(F.col("origin"), lambda o, r: o + (F.col("axes")[0][r] * F.col("spacing")[0] + F.col("axes")[1][r] * F.col("spacing")[1]) / 2)
    previews = volumes.join(small_sizes.select("volume_id", F.array("nx", "ny", "nz").alias("small")), "volume_id").withColumns({"dims": F.col("small"), "origin": moved}).withColumn("spacing", wide(2.0))
    rows = None
    for kind, own, sides in (("full", voxels, volumes), ("preview", small, previews)):
        side = sides.drop("lo", "hi").join(ranged(own), "volume_id").select("volume_id", "series_number", F.to_json(packed.sidecar("")).alias("sidecar"))
        part = packed.slab_blobs(own, slab).join(side, "volume_id").withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("volume_id", "series_number", "kind", "slab", "content", "sidecar")
    rows.repartition("volume_id", "kind").sortWithinPartitions("volume_id", "kind", "slab").write.format(NAME).mode(mode).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Slab blobs (``READ``) of a folder; ``voxels_of`` unfolds them."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def voxels_of(slabs: DataFrame) -> DataFrame:
    """volume_id, kind, k, j, i, idx, stored of slab blobs."""
    named = slabs.select(F.to_json(F.struct("volume_id", "kind", "k0")).alias("volume_id"), "nx", "ny", F.col("depth").alias("nz"), "data_type", "content", "k0")
    v = packed.voxels(named).withColumn("of", F.from_json("volume_id", "volume_id string, kind string, k0 int"))
    plane = slabs.select("volume_id", "kind", (F.col("nx").cast("long") * F.col("ny")).alias("plane")).distinct()
    out = v.select("of.volume_id", "of.kind", (F.col("k") + F.col("of.k0")).alias("k"), "j", "i", "idx", "stored", "of.k0").join(plane, ["volume_id", "kind"])
    return out.select("volume_id", "kind", "k", "j", "i", (F.col("idx") + F.col("k0") * F.col("plane")).alias("idx"), "stored")
