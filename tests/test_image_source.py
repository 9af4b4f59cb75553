"""Image files by their data source: the parser's rows, planned by bytes, without the pixels if they are not wanted."""

import struct

import pytest
from pyspark.sql import functions as F

from voxelake.sources import image_source, part10

SIZE = {0x00080060: ("CS", b"MR"), 0x00280010: ("US", struct.pack("<H", 400)), 0x00280011: ("US", struct.pack("<H", 500)), 0x00280100: ("US", struct.pack("<H", 16))}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    (top / "sub").mkdir()
    for n in range(6):
        own = SIZE | {0x00200013: ("IS", str(n).encode()), 0x00091001: ("UT", b"x" * (n * 40_000)), 0x7FE00010: ("OW", bytes(400_000))}
        (top / "sub" / f"{n}.dcm").write_bytes(part10.write_file(own))
    (top / "rle").write_bytes(part10.write_file(SIZE, part10.RLE, [b"\1" * 200_000]))
    (top / "none").write_bytes(part10.write_file(SIZE))
    (top / "text").write_bytes(b"t" * 1000)
    return str(top)


def test_equals_the_parser(spark, folder):
    files = part10.candidates(spark, folder)
    rows, bad = part10.elements(files)
    got = image_source.read(spark, f"file://{folder}", splitBytes="900000")
    plain = lambda df: sorted(map(str, df.withColumn("path", F.substring_index("path", "/", -1)).collect()))
    assert plain(got.filter("reason is null").drop("reason", "bytes_read")) == plain(rows)
    assert plain(got.filter("reason is not null").select("path", "reason")) == plain(bad) and bad.count() == 1
    assert got.rdd.getNumPartitions() > 2 and got.filter("bytes_read = 0").count() == 0


def test_headers_without_pixels(spark, folder):
    whole = image_source.read(spark, folder).filter(F.col("tag") != part10.PIXELS)
    heads = image_source.read(spark, folder, pixels="false")
    assert heads.filter(F.col("tag") == part10.PIXELS).count() == 0
    assert sorted(map(str, heads.drop("bytes_read").filter("reason is null").collect())) == sorted(map(str, whole.drop("bytes_read").collect()))
    read = {r.path.rsplit("/", 1)[-1]: r.n for r in heads.groupBy("path").agg(F.max("bytes_read").alias("n")).collect()}
    assert read["0.dcm"] == image_source.HEAD and read["rle"] == image_source.HEAD  # of 400,000 bytes and 200,000
    assert 200_000 < read["5.dcm"] < 400_000 and len(read) == 9
    some = image_source.read(spark, folder, pixels="false", tags="00200013,00080060")
    assert {r.tag for r in some.filter("reason is null").collect()} == {0x00200013, 0x00080060} and some.filter("reason is null").count() == 14
