"""Queries over image files: written from the embeddings in every form, read back, stacked.

Every embedding becomes a file of 8 x 8 pixels: explicit, implicit or big-endian, with
run lengths, or of two frames, by its id; noise lies in the bits that are not stored,
and every fiftieth file is cut short.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.plans.registry import query, table
from voxelake.sources import image_source, part10
from voxelake.sources.packed_source import located
from voxelake.sources.shared import shared_dir

FORMS = ("1.2.840.10008.1.2.1", part10.IMPLICIT, part10.BIG, part10.RLE, "1.2.840.10008.1.2.1")
#: A description in each character set, and the set's name and codec.
WORDS = (("Größe", "", "cp1252"), ("knie ü例", "ISO_IR 192", "utf-8"), ("колено", "ISO_IR 144", "iso8859-5"), ("膝盖", "GB18030", "gb18030"), ("žaba", "ISO_IR 101", "iso8859-2"))


#: Files that are made at once.
PIECE = 500


def image(n: int, label: int, x: np.ndarray) -> bytes:
    """The file of one embedding."""
    form, (word, charset, codec) = FORMS[n % 5], WORDS[n % 5]
    order = ">" if form == part10.BIG else "<"
    px = (np.floor((x.astype(np.float64) + 1) * 2000 + 0.5).astype(np.int64) | n % 16 << 12).astype(np.uint16)
    frames = [px, px[::-1]] if n % 5 == 4 else [px]
    short = lambda v: ("US", struct.pack(order + "H", v))
    tags = {
        0x00080018: ("UI", f"1.2.{n}".encode()), 0x00080060: ("CS", b"MR"), 0x0008103E: ("LO", word.encode(codec)), 0x00180050: ("DS", b"3.0"), 0x0020000E: ("UI", f"1.2.3.{label}".encode()), 0x00200011: ("IS", str(label).encode()), 0x00200013: ("IS", str(n).encode()),
        0x00200032: ("DS", f"1.5\\-2\\{n / 2}".encode()), 0x00280008: ("IS", str(len(frames)).encode()), 0x00280010: short(8), 0x00280011: short(8), 0x00280030: ("DS", b"0.5\\0.25"), 0x00280100: short(16), 0x00280101: short(12), 0x00280102: short(11), 0x00280103: short(0),
    }
    if charset:
        tags[0x00080005] = ("CS", charset.encode())
    if label % 2:
        tags[0x00200037] = ("DS", b"1\\0\\0\\0\\1\\0")
    if form == part10.RLE:
        return part10.write_file(tags, form, [part10.pack_rle(f) for f in frames])
    data = b"".join(f.astype(order + "u2").tobytes() for f in frames)
    tags[0x7FE00010] = ("OW", data[:-20] if n % 50 == 42 else data)
    return part10.write_file(tags, form)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            made = [image(n, label, np.array(x)) for n, label, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{n:09d}" for n in b.column(0).to_pylist()], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInArrow(run, "path string, content binary")


SLICES_SQL = "s AS (SELECT vec_id, '1.2.3.' || label AS volume_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, vec_id / 2 AS depth, embedding FROM embeddings)"
PX = "CAST(floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 2000 + 0.5) AS INTEGER)"


@query("src19_files_to_voxels", f"WITH {SLICES_SQL} SELECT volume_id, CAST(k AS INTEGER) AS k, CAST(p // 8 AS INTEGER) AS j, CAST(p % 8 AS INTEGER) AS i, k * 64 + p AS idx, {PX} AS stored FROM s, range(64) r(p) WHERE vec_id % 50 <> 42")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to voxels: parsed, placed, ordered along the normal, decoded."""
    return part10.read_series(files(spark, sf_dir))[1]


@query("srt2_build_volumes", f"WITH {SLICES_SQL}, g AS (SELECT *, depth - lag(depth) OVER (PARTITION BY volume_id ORDER BY k) AS gap FROM s), m AS (SELECT volume_id, count(*) AS n, median(gap) AS step FROM g GROUP BY 1), u AS (SELECT volume_id, n, step, count(*) FILTER (WHERE abs(gap - step) > 0.01) AS uneven, min(depth) AS z, arg_min(vec_id, k) AS head FROM g JOIN m USING (volume_id) GROUP BY ALL) SELECT volume_id, CAST(n AS INTEGER) AS n, round(CASE WHEN n < 2 THEN 3.0 ELSE step END, 6) AS spacing_k, 0.25 AS spacing_i, 0.5 AS spacing_j, round(z, 6) AS origin_z, ['Größe', 'knie ü例', 'колено', '膝盖', 'žaba'][head % 5 + 1] AS description, CASE WHEN uneven > 0 THEN 'uneven_spacing' ELSE '' END AS warnings, uneven FROM u")
def srt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a volume: size, spacing, origin, description of the first slice, warnings."""
    v = part10.read_series(files(spark, sf_dir))[0]
    at = lambda c, n: F.get(c, F.lit(n))
    return v.select("volume_id", at("dims", 2).alias("n"), F.round(at("spacing", 2), 6).alias("spacing_k"), at("spacing", 0).alias("spacing_i"), at("spacing", 1).alias("spacing_j"), F.round(at("origin", 2), 6).alias("origin_z"), "description", F.array_join("warnings", ",").alias("warnings"), "uneven")


@query("src_rejects", "SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, 'truncated pixel data' AS reason FROM embeddings WHERE vec_id % 50 = 42")
def src_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that gave no voxels, and why."""
    return part10.read_series(files(spark, sf_dir))[2]


@query("prj12_frames", f"WITH px AS (SELECT vec_id, p, {PX} AS v FROM embeddings, range(64) r(p) WHERE vec_id % 50 <> 42), f AS (SELECT vec_id, 0 AS frame, p, v FROM px UNION ALL SELECT vec_id, 1, 63 - p, v FROM px WHERE vec_id % 5 = 4) SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, CAST(frame AS INTEGER) AS frame, CAST(sum(v * (p + 1)) AS BIGINT) AS digest, min(v) AS least, max(v) AS most FROM f GROUP BY vec_id, frame")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every file, digested."""
    p = part10.pixels(files(spark, sf_dir))[0]
    v = F.col("stored")
    return p.groupBy("path", "frame").agg(F.sum(v * (F.col("at") + 1)).alias("digest"), F.min(v.cast("int")).alias("least"), F.max(v.cast("int")).alias("most"))


@query("prj4_charsets", "SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, ['Größe', 'knie ü例', 'колено', '膝盖', 'žaba'][vec_id % 5 + 1] AS text FROM embeddings")
def prj4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in five character sets."""
    return part10.elements(files(spark, sf_dir))[0].filter(F.col("tag") == 0x0008103E).select("path", "text")


@query("prj10_instances", "SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, 'MR' AS modality, CAST(label AS INTEGER) AS series_number, CAST(vec_id AS INTEGER) AS instance_number, CASE WHEN vec_id % 5 = 4 THEN 2 ELSE 1 END AS frames, round(vec_id / 2, 6) AS z, 0.25 AS col_spacing, 1.0 AS slope, 'MONOCHROME2' AS photometric, CAST(NULL AS DOUBLE) AS center FROM embeddings")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed image rows with defaults for what the files leave out."""
    i = part10.instances(part10.elements(files(spark, sf_dir))[0])[0]
    return i.select("path", "modality", "series_number", "instance_number", "frames", F.round(F.get("position", F.lit(2)), 6).alias("z"), "col_spacing", "slope", "photometric", "center")


SRC6_SQL = "SELECT tag, vr, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT CAST(t AS BIGINT) AS tag, v AS vr, vec_id AS path FROM embeddings, (VALUES (131088, 'UI'), (524312, 'UI'), (524384, 'CS'), (528446, 'LO'), (1572944, 'DS'), (2097166, 'UI'), (2097169, 'IS'), (2097171, 'IS'), (2097202, 'DS'), (2621448, 'IS'), (2621456, 'US'), (2621457, 'US'), (2621488, 'DS'), (2621696, 'US'), (2621697, 'US'), (2621698, 'US'), (2621699, 'US')) x(t, v) UNION ALL SELECT 524293, 'CS', vec_id FROM embeddings WHERE vec_id % 5 > 0 UNION ALL SELECT 2097207, 'DS', vec_id FROM embeddings WHERE label % 2 = 1 UNION ALL SELECT 2145386512, CASE WHEN vec_id % 5 = 3 THEN 'OB' ELSE 'OW' END, vec_id FROM embeddings) GROUP BY 1, 2"


@query("src6_elements", SRC6_SQL)
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag and representation, whatever the files' form."""
    return part10.elements(files(spark, sf_dir))[0].groupBy("tag", "vr").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def written(df: DataFrame) -> str:
    """The folder in the shared one to which the files (path, content) were written, by tasks."""
    folder = f"{shared_dir(df.sparkSession)}/voxelake-{uuid.uuid4().hex}/images"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        store.create_dir(root)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}.dcm") as f:
                    f.write(data)
            yield b.select(["path"])

    df.mapInArrow(run, "path string").count()
    return folder


@query("src5_headers_by_source", f"SELECT * FROM ({SRC6_SQL}) WHERE tag <> {0x7FE00010}")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of files on disk, read by the data source without their pixels."""
    rows = image_source.read(spark, written(files(spark, sf_dir)), pixels="false").filter("reason is null")
    return rows.groupBy("tag", "vr").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
