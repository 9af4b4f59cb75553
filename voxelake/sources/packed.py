"""Packed volumes: a JSON manifest beside headerless little-endian 16-bit blobs.

Reading: the manifest is validated field by field, blobs come by binaryFile and one
Arrow pass to voxels. Writing: voxels to blobs of whole slabs of slices, by tasks that
hold one slab, previews of half the resolution, and the manifest.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import scalar
from voxelake.operators import resample

SIDECAR = "struct<url:string,bytes:long,dataType:string,dims:array<int>,spacing:array<double>,origin:array<double>,valueRange:struct<min:int,max:int>,description:string,modality:string,seriesInstanceUid:string,frameOfReferenceUid:string>"
MANIFEST = f"format string, series array<struct<name:string,seriesNumber:int,full:{SIDECAR},preview:{SIDECAR}>>"
FORMAT = "voxel-pack/1"


def problems(manifest: DataFrame, of: list[str] = ()) -> DataFrame:
    """name, field, problem of everything a manifest lacks; empty for a valid one. ``of``: columns that tell manifests apart."""
    bad = F.when(F.col("format").isNull() | (F.col("format") != FORMAT), F.struct(F.lit("").alias("name"), F.lit("format").alias("field"), F.lit("unknown").alias("problem")))
    none = F.when(F.col("series").isNull(), F.struct(F.lit("").alias("name"), F.lit("series").alias("field"), F.lit("no list").alias("problem")))
    head = manifest.select(*of, F.explode(F.filter(F.array(bad, none), lambda x: x.isNotNull())).alias("p")).select(*of, "p.*")
    s = manifest.select(*of, F.explode("series").alias("s")).select(*of, "s.name", "s.full.*")
    checks = {
        "name": F.coalesce(F.col("name"), F.lit("")) != "",
        "dims": (F.size("dims") == 3) & F.forall("dims", lambda x: x > 0),
        "spacing": (F.size("spacing") == 3) & F.forall("spacing", lambda x: x > 0),
        "origin": F.size("origin") == 3,
        "dataType": F.col("dataType").isin("uint16", "int16"),
        "bytes": F.col("bytes") == F.get("dims", F.lit(0)).cast("long") * F.get("dims", F.lit(1)) * F.get("dims", F.lit(2)) * 2,
    }
    wrong = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit("missing or wrong").alias("problem"))) for f, ok in checks.items()))
    return head.union(s.select(*of, "name", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("w")).select(*of, "name", "w.*"))


def sidecar(url: str | Column) -> Column:
    """A volume's sidecar from its row (dims, spacing, origin, axes, signed, lo, hi, slope, ...): numbers rounded; a window that is null is left out of the JSON."""
    rounded = lambda c, n: F.transform(c, lambda x: F.round(x, n))
    affine = F.flatten(F.array(*(F.array(*(F.round(F.col("axes")[a][r] * F.col("spacing")[a], 12) for r in range(3)), F.lit(0.0)) for a in range(3)), F.array(*(F.round(F.col("origin")[r], 12) for r in range(3)), F.lit(1.0))))
    n = F.aggregate("dims", F.lit(2).cast("long"), lambda acc, x: acc * x)
    return F.struct(
        (F.lit(url) if isinstance(url, str) else url).alias("url"), n.alias("bytes"), F.when(F.col("signed"), "int16").otherwise("uint16").alias("dataType"), "dims", rounded("spacing", 9).alias("spacing"), rounded("origin", 9).alias("origin"), F.transform("axes", lambda a: rounded(a, 12)).alias("axes"), affine.alias("voxelToPatient"),
        F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("valueRange"), F.col("slope").alias("rescaleSlope"), F.col("intercept").alias("rescaleIntercept"), F.col("center").alias("windowCenter"), F.col("width").alias("windowWidth"), "description", "modality", F.col("volume_id").alias("seriesInstanceUid"), F.col("frame_uid").alias("frameOfReferenceUid"), "warnings",
    )


def manifest(volumes: DataFrame, previews: DataFrame) -> DataFrame:
    """The manifest of a study as one row of JSON; series by number, then name (a study's series are few)."""
    side = lambda df, name, end: df.select("volume_id", sidecar(F.concat("volume_id", F.lit(end))).alias(name))
    both = volumes.select("volume_id", "series_number").join(side(volumes, "full", ".raw"), "volume_id").join(side(previews, "preview", ".preview.raw"), "volume_id")
    one = F.struct(F.col("series_number").alias("seriesNumber"), F.col("volume_id").alias("name"), "full", "preview")
    return both.agg(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit("i fastest, then j, then k").alias("voxelOrder"), F.array_sort(F.collect_list(one)).alias("series"))).alias("manifest"))


def halved(voxels: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A preview of half the resolution in the slice, and its sizes: means of two by two, halves up; odd rims are dropped."""
    sized = voxels.join(dims, "volume_id")
    small = dims.select("volume_id", F.floor(F.col("nx") / 2).cast("int").alias("nx"), F.floor(F.col("ny") / 2).cast("int").alias("ny"), "nz")
    cells = resample.blocks(sized, 2, 2, 1, F.col("nx"), F.col("ny"), F.col("nz")).join(small, "volume_id")
    idx = ((F.col("k") * F.col("ny") + F.col("j")) * F.col("nx") + F.col("i")).cast("long")
    return cells.select("volume_id", *(F.col(c).cast("int").alias(c) for c in "kji"), idx.alias("idx"), scalar.half_up(F.col("mean")).cast("int").alias("stored")), small


def codec_sizes(blobs: DataFrame) -> DataFrame:
    """volume_id, raw, gzip, zstd: bytes of each volume's blobs under the codecs at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, len(x), len(gzip.compress(x, 9)), len(zstandard.ZstdCompressor(level=19).compress(x))) for v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string() if not n else pa.int64()) for n in range(4)], ["volume_id", "raw", "gzip", "zstd"])

    sizes = blobs.select("volume_id", "content").mapInArrow(run, "volume_id string, raw long, gzip long, zstd long")
    return sizes.groupBy("volume_id").agg(*(F.sum(c).alias(c) for c in ("raw", "gzip", "zstd")))


def listing(paths: DataFrame, root: str) -> DataFrame:
    """name (the folder below ``root``) and files of each series of a listing (path), numbers in names in their own order."""
    below = F.substring("path", len(root) + 2, 1 << 20)
    image = paths.filter(F.lower("path").endswith(".dcm") & F.col("path").startswith(root + "/") & ~F.col("path").contains("/../"))
    split = image.select(below.alias("file"), F.regexp_replace(below, r"/?[^/]*$", "").alias("name"))
    padded = F.regexp_replace(F.regexp_replace("file", r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    files = F.transform(F.array_sort(F.collect_list(F.struct(padded.alias("order"), "file"))), lambda x: x["file"])
    return split.groupBy(F.when(F.col("name") == "", ".").otherwise(F.col("name")).alias("name")).agg(files.alias("files"))


def resolved(base: str, series: DataFrame, of: list[str] = ()) -> DataFrame:
    """``of``, name, path, dims, data_type of the full blobs that a parsed manifest's series name, below ``base``."""
    return series.select(*of, "name", F.concat(F.lit(base.rstrip("/") + "/"), F.col("full.url")).alias("path"), F.col("full.dims").alias("dims"), F.col("full.dataType").alias("data_type"))


def size_gate(files: DataFrame, of: str, limit: int = 25 << 20, warn: int = 23 << 20, most_files: int = 20_000) -> DataFrame:
    """Verdict on each release of files (``of``, bytes): none over the limit, not too many, a warning close to it."""
    n = F.col("bytes")
    counts = files.groupBy(of).agg(F.count("*").alias("files"), F.count_if(n > limit).alias("too_large"), F.count_if((n > warn) & (n <= limit)).alias("close"), F.max(n.cast("long")).alias("largest"))
    return counts.withColumn("verdict", F.when((F.col("too_large") > 0) | (F.col("files") > most_files), "fail").when(F.col("close") > 0, "warn").otherwise("ok"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def voxels(blobs: DataFrame) -> DataFrame:
    """Voxels of blobs (volume_id, nx, ny, nz, data_type, content); a blob of another length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vid, nx, ny, nz, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(data) != nx * ny * nz * 2:
                    raise ValueError(f"{vid}: {len(data)} bytes, not {nx * ny * nz * 2}")
                v = np.frombuffer(data, dtype="<u2" if kind == "uint16" else "<i2")
                for at in range(0, len(v), 1 << 18):
                    idx = np.arange(at, min(len(v), at + (1 << 18)))
                    cols = [pa.array([vid] * len(idx)), *(pa.array(x.astype(np.int32)) for x in (idx // (nx * ny), idx // nx % ny, idx % nx)), pa.array(idx), pa.array(v[idx].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["volume_id", "k", "j", "i", "idx", "stored"])

    return blobs.select("volume_id", "nx", "ny", "nz", "data_type", "content").mapInArrow(run, "volume_id string, k int, j int, i int, idx long, stored int")


def slab_blobs(voxels: DataFrame, slab: int = 32) -> DataFrame:
    """volume_id, slab, content: blobs of ``slab`` slices each, whose concatenation is the volume's."""

    def run(t: pa.Table) -> pa.Table:
        v = t["stored"].to_numpy()[np.argsort(t["idx"].to_numpy(), kind="stable")].astype("<u2")
        return pa.table({"volume_id": [t["volume_id"][0].as_py()], "slab": pa.array([t["slab"][0].as_py()], pa.int32()), "content": [v.tobytes()]})

    return voxels.withColumn("slab", F.floor(F.col("k") / slab).cast("int")).groupBy("volume_id", "slab").applyInArrow(run, "volume_id string, slab int, content binary")
