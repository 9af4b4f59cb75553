"""Packed volumes written to files and read again: round trips, failures, planning."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelake.sources import packed, packed_source

SIZES = {"a": (9, 5, 4), "b": (3, 6, 8), "c": (1, 2, 2)}


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(4)
    arrays = {v: rng.integers(0, 4000, n) for v, n in SIZES.items()}
    parts = []
    for v, a in arrays.items():
        k, j, i = (x.ravel().astype(np.int32) for x in np.indices(a.shape))
        parts.append(pd.DataFrame({"volume_id": v, "k": k, "j": j, "i": i, "idx": np.arange(a.size), "stored": a.ravel().astype(np.int32)}))
    voxels = spark.createDataFrame(pd.concat(parts))
    rows = [(v, n, [x, y, z], [0.5, 0.75, 3.0], [1.0, 2.0, 3.0], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], False, 1.0, 0.0, 40.0, None, "d", "MR", "1.2", []) for n, (v, (z, y, x)) in enumerate(SIZES.items(), 5)]
    kinds = "volume_id string, series_number int, dims array<int>, spacing array<double>, origin array<double>, axes array<array<double>>, signed boolean, slope double, intercept double, center double, width double, description string, modality string, frame_uid string, warnings array<string>"
    return spark.createDataFrame(rows, kinds), voxels, arrays


def test_round_trip(spark, study, tmp_path):
    volumes, voxels, arrays = study
    path = f"file://{tmp_path}/out"
    packed_source.write(volumes, voxels, path, slab=2)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(["manifest.json", *(v + e for v in SIZES for e in (".raw", ".preview.raw"))])
    text = json.loads((tmp_path / "out/manifest.json").read_text())
    assert [(s["name"], s["full"]["dims"], s["preview"]["dims"], s["preview"]["spacing"], s["preview"]["origin"]) for s in text["series"]] == [(v, [x, y, z], [x // 2, y // 2, z], [1.0, 1.5, 3.0], [1.25, 2.375, 3.0]) for v, (z, y, x) in SIZES.items()]
    assert packed.problems(packed.read_manifest(spark, f"{path}/manifest.json")).count() == 0
    for v, a in arrays.items():
        assert (np.fromfile(tmp_path / f"out/{v}.raw", "<u2").reshape(a.shape) == a).all()
    for most in ("1", "100000"):
        slabs = packed_source.read(spark, path, splitBytes=most)
        got = packed_source.voxels_of(slabs).toPandas()
        for v, a in arrays.items():
            own = got[(got.volume_id == v) & (got.kind == "full")].sort_values("idx")
            assert (own.stored.to_numpy().reshape(a.shape) == a).all() and own.idx.tolist() == list(range(a.size))
            small = got[(got.volume_id == v) & (got.kind == "preview")].sort_values("idx").stored.to_numpy()
            z, y, x = (n if d == 0 else n // 2 for d, n in enumerate(a.shape))
            means = a[:, : 2 * y, : 2 * x].reshape(z, y, 2, x, 2).mean(axis=(2, 4))
            assert (small.reshape(z, y, x) == np.floor(means + 0.5)).all()
        assert slabs.count() == (sum(2 * n[0] for n in SIZES.values()) if most == "1" else 6)
        assert not slabs.filter("octet_length(content) <> 2 * nx * ny * depth").count()


def test_only_what_is_asked_for_is_opened(spark, study, tmp_path):
    packed_source.write(*study[:2], f"{tmp_path}/out")
    for f in ("a.raw", "a.preview.raw", "b.raw"):
        (tmp_path / "out" / f).unlink()
    got = packed_source.read(spark, f"{tmp_path}/out", volumes="b,c", kind="preview")
    assert {r.volume_id for r in got.collect()} == {"b", "c"} and {r.kind for r in got.collect()} == {"preview"}
    with open(tmp_path / "out/c.preview.raw", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="bytes, not"):
        packed_source.read(spark, f"{tmp_path}/out", volumes="c").collect()


def test_a_failed_write_leaves_nothing(spark, study, tmp_path):
    volumes, voxels, _ = study
    broken = voxels.withColumn("stored", F.when((F.col("volume_id") == "b") & (F.col("k") == 2), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("stored")))
    with pytest.raises(Exception, match="lost"):
        packed_source.write(volumes, broken, f"{tmp_path}/out", slab=1)
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    rows = spark.createDataFrame([("v", 1, "full", s, bytearray(b"ab"), "{}") for s in (1, 0)], packed_source.WRITTEN)
    with pytest.raises(Exception, match="slabs must ascend"):
        rows.coalesce(1).write.format(packed_source.NAME).mode("append").save(f"{tmp_path}/out")
    with pytest.raises(Exception, match="several tasks"):
        rows.repartitionByRange(2, "slab").write.format(packed_source.NAME).mode("append").save(f"{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == []


def test_a_second_write_replaces_only_when_told(spark, study, tmp_path):
    volumes, voxels, _ = study
    packed_source.write(volumes, voxels, f"{tmp_path}/out")
    before = (tmp_path / "out/manifest.json").read_text()
    with pytest.raises(Exception, match="manifest already"):
        packed_source.write(volumes, voxels, f"{tmp_path}/out")
    assert (tmp_path / "out/manifest.json").read_text() == before
    packed_source.write(volumes, voxels.withColumn("stored", F.lit(7)), f"{tmp_path}/out", mode="overwrite")
    assert {r.stored for r in packed_source.voxels_of(packed_source.read(spark, f"{tmp_path}/out")).select("stored").distinct().collect()} == {7}
