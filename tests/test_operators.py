"""Operators on small literal inputs, with known answers."""

import itertools
import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.functions import rules, scalar
from voxelake.operators import deid, graph, histogram, masks, resample, series, session, shape, slabs, walk
from voxelake.sources import packed, part10


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_half_up_goes_up(spark):
    assert list(one(spark, *(scalar.half_up(F.lit(x)) for x in (-2.5, 2.5, -0.5, 0.49)))) == [-2, 3, 0, 0]


def test_bit_mask_extends_the_sign(spark):
    r = one(spark, scalar.bit_mask(F.lit(0x0FFF), 16, 12, 11, True), scalar.bit_mask(F.lit(0x0FFF), 16, 12, 11, False), scalar.bit_mask(F.lit(7), 16, 16, 15, True))
    assert list(r) == [-1, 4095, 7]


def test_numbers_of_a_text(spark):
    assert one(spark, scalar.element_numbers(F.lit("1\\\\abc\\ 2.5 \\inf")))[0] == [1.0, 0.0, 2.5]


def test_affine_inverse_and_singular(spark):
    m = (2, 0, 0, 5, 0, 3, 1, -1, 0, 0, 4, 2)
    back = g.apply_affine(g.invert_affine(m), g.apply_affine(m, (1, 2, 3)))
    assert [round(x, 9) for x in one(spark, *back)] == [1, 2, 3]
    assert one(spark, g.invert_affine((0,) * 12)[0])[0] is None


def test_directions(spark):
    r = one(spark, g.describe_direction((1, 0, 0.6)), g.describe_direction((0, 0, 0)), g.nearest_axis((0, -3, 1)), g.describe_plane((0, 0.1, 0.99)))
    assert list(r) == ["LS", "", "A", "axial"]


@pytest.mark.parametrize("t1,fs,want", [(0.1, 0.1, "dark"), (0.3, 0.3, "muscle"), (0.5, 0.1, "fat"), (0.1, 0.9, "fluid"), (0.3, 0.9, "edema"), (0.01, 0.01, "background"), (0.5, 0.9, "unknown")])
def test_pair_rule(spark, t1, fs, want):
    assert one(spark, rules.classify_pair(F.lit(t1), F.lit(fs))[0])[0] == want


def test_single_rule_takes_the_fat_saturated(spark):
    none = F.lit(None).cast("double")
    r = one(spark, rules.classify_pair(none, F.lit(0.9))[0], rules.classify_pair(F.lit(0.9), none)[0], rules.classify_pair(none, none)[0])
    assert list(r) == ["fluid", "fat", "unknown"]


def test_sequence_names(spark):
    texts = ["pd_tse_fs cor", "T1 TSE", "t2w sag", "PDW", "STIR tra", "localizer"]
    assert list(one(spark, *(rules.sequence_kind(F.lit(t)) for t in texts))) == ["fatsat", "t1", "t2", "t2", "fatsat", "unknown"]


BASE = {"kind": "tube", "voxels": 400, "agreement": 0.9, "shape_confidence": 0.8, "marrow": 0.1, "muscle": 0.1, "fat": 0.1, "length_mm": 5.0, "marrow0": 0.0, "muscle0": 0.4, "marrow2": 0.3, "muscle2": 0.0}


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, "tendon"),
        ({"muscle0": 0.0, "marrow0": 0.2}, "ligament"),
        ({"kind": "sheet", "marrow": 0.2}, "cortex"),
        ({"kind": "sheet", "marrow": 0.01}, "dark"),
        ({"kind": "blob"}, "dark"),
        ({"voxels": 5}, "dark"),
        ({"agreement": 0.3}, "dark"),
        ({"muscle0": 0.0, "marrow2": 0.0, "length_mm": 20.0, "fat": 0.5, "muscle": 0.3}, "vessel"),
    ],
)
def test_naming(spark, change, want):
    assert one(spark, rules.name_component({k: F.lit(v) for k, v in (BASE | change).items()})[0])[0] == want


def grid(spark, a):
    nz, ny, nx = a.shape
    k, j, i = (x.ravel() for x in np.indices(a.shape))
    pdf = pd.DataFrame({"volume_id": "v", "k": k, "j": j, "i": i, "idx": np.arange(a.size), "stored": a.ravel()})
    return spark.createDataFrame(pdf)


def test_scale_ignores_gain(spark):
    a = np.random.default_rng(0).integers(1, 900, (7, 9, 11))
    r = [histogram.muscle_ranges(grid(spark, a * gain)).first().high for gain in (1, 3)]
    assert abs(r[0] - r[1]) < 5e-3


def test_flat_volume_has_the_default_range(spark):
    r = histogram.percentile_ranges(grid(spark, np.full((3, 3, 3), 7))).first()
    assert (r.low, r.high) == (0.0, 1.0)


def test_trilinear_inside_edge_and_outside(spark):
    a = np.arange(27).reshape(3, 3, 3)
    p = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, -0.4, 0.0, 0.0), (2, -0.6, 0.0, 0.0), (3, 2.0, 2.0, 2.0)], "p int, x double, y double, z double")
    p = p.selectExpr("*", "3 as nx", "3 as ny", "3 as nz", "'v' as volume_id")
    assert {r.p: r.value for r in resample.trilinear(p, grid(spark, a), ["p"]).collect()} == {0: 6.5, 1: 0.0, 3: 26.0}


def test_runs_of_every_small_mask(spark):
    bits = [(m, n, bool(m >> n & 1)) for m in range(4096) for n in range(12)]
    dense = spark.createDataFrame(pd.DataFrame(bits, columns=["mask_id", "pos", "bit"]))
    runs = masks.encode_runs(dense)
    back = {(r.mask_id, r.pos) for r in masks.decode_runs(runs).collect()}
    assert back == {(m, n) for m, n, b in bits if b}
    first = {r.mask_id: r.length for r in runs.filter("run = 0").collect()}
    assert len(first) == 4096 and all((first[m] == 0) == bool(m & 1) for m in first)


def test_morphology(spark):
    square = spark.createDataFrame([(1, y, x) for y in range(1, 4) for x in range(1, 4)], "mask_id int, y long, x long")
    size = spark.createDataFrame([(1, 5, 5)], "mask_id int, width int, height int")
    assert {(r.y, r.x) for r in masks.erode(square, size).collect()} == {(2, 2)}
    assert masks.dilate(square, size).count() == 25
    assert {(r.y, r.x) for r in masks.interior_point(square, size).collect()} == {(2, 2)}
    assert masks.outline(square, size).count() == 8


def shell(hole):
    """A cube of fat with a dark shell, with a hole of some width in it."""
    n = 12
    a = np.full((n, n, n), "fat", dtype=object)
    for s, e in ((3, 8),):
        for k, j, i in itertools.product(range(n), repeat=3):
            if s <= min(k, j, i) and max(k, j, i) <= e and (s in (k, j, i) or e in (k, j, i)):
                a[k, j, i] = "dark"
    if hole:
        a[3, 5 : 5 + hole, 5 : 5 + hole] = "fat"
    return a


@pytest.mark.parametrize("hole,enclosed", [(0, True), (1, True), (2, False)])
def test_marrow_is_what_a_wall_encloses(spark, hole, enclosed):
    a = shell(hole)
    k, j, i = (x.ravel() for x in np.indices(a.shape))
    t = spark.createDataFrame(pd.DataFrame({"volume_id": "v", "idx": np.arange(a.size), "k": k, "j": j, "i": i, "tissue": a.ravel()}))
    n = graph.mark_marrow(t, slabs.grid_of(t), least=20).filter("tissue = 'marrow'").count()
    assert (n >= 64) == enclosed


def test_groups_ends_and_contacts_of_a_rod(spark):
    rows = [(k, "dark" if 2 <= k <= 7 else "muscle" if k < 2 else "marrow") for k in range(10)]
    t = spark.createDataFrame([("v", k, k, 0, 0, x) for k, x in rows], "volume_id string, idx long, k int, j int, i int, tissue string")
    g = slabs.one_grid(spark, 1, 1, 10, volume_id="v")
    s = t.filter("tissue = 'dark'").selectExpr("volume_id", "idx", "k", "j", "i", "'tube' as kind", "0.9D as confidence")
    groups = graph.shape_groups(s, g)
    assert groups.count() == 6 and groups.select("component_id").distinct().count() == 1
    ends = graph.split_ends(groups, g)
    assert ends.first().length_mm == 5
    c = graph.contacts(ends, t, g).first()
    assert sorted([(c.marrow0, c.muscle0), (c.marrow2, c.muscle2)]) == [(0.0, 1.0), (1.0, 0.0)]
    e = graph.evidence(groups, ends, s, graph.contacts(ends, t, g)).first()
    assert (e.voxels, e.agreement, e.kind) == (6, 1.0, "tube")


def test_voxels_on_the_line_of_an_end_belong_to_it(spark):
    # eleven voxels along (1, 2, 1): the fourth from either tip lies at 0.3 of the length exactly
    rod = spark.createDataFrame([("v", 0, n * 100, n, 2 * n, n, "tube", 1.0) for n in range(11)], "volume_id string, component_id int, idx int, k int, j int, i int, kind string, confidence double")
    buckets = [r.bucket for r in graph.split_ends(rod, slabs.one_grid(spark, 11, 21, 11, volume_id="v")).orderBy("idx").collect()]
    assert buckets == [2, 2, 2, 2, 1, 1, 1, 0, 0, 0, 0]


@pytest.mark.parametrize("kind", ["tube", "sheet", "blob"])
def test_shapes_of_wells(spark, kind):
    n, c = 15, 7
    k, j, i = np.indices((n, n, n))
    r2 = {"tube": (j - c) ** 2 + (i - c) ** 2, "sheet": (i - c) ** 2, "blob": (k - c) ** 2 + (j - c) ** 2 + (i - c) ** 2}[kind] * 0.36
    v = 1 - np.exp(-r2 / (2 * 1.0))
    f = spark.createDataFrame(pd.DataFrame({"volume_id": "v", "idx": np.arange(n**3), "k": k.ravel(), "j": j.ravel(), "i": i.ravel(), "value": v.ravel()}))
    got = shape.shapes(f, slabs.grid_of(f, (0.6, 0.6, 0.6)), scales=(0.7,)).filter(F.col("idx") == (c * n + c) * n + c).first()
    assert got.kind == kind and got.confidence > 0.5


def test_smoothing_over_slabs_equals_numpy(spark):
    a = np.random.default_rng(1).random((9, 4, 5)).astype(np.float32)
    k, j, i = np.indices(a.shape)
    f = spark.createDataFrame(pd.DataFrame({"volume_id": "v", "k": k.ravel(), "j": j.ravel(), "i": i.ravel(), "value": a.ravel()}))
    want = a
    for axis, s in ((2, 1.0), (1, 1.0), (0, 2.0)):
        want = shape._blur(want, axis, np.array(shape.kernel(1.4 / s)))
    got = shape.smooth(f, 1.4, slabs.one_grid(spark, 5, 4, 9, (1.0, 1.0, 2.0), "v"), depth=2).toPandas().sort_values("idx").value.to_numpy().reshape(a.shape)
    assert np.abs(got - want).max() < 1e-6


def test_walk_stops(spark):
    s = spark.createDataFrame([(1, 0, 100, 1.0), (1, 1, 110, 1.0), (1, 2, 400, 1.0), (1, 3, 410, 1.0), (2, 0, 50, 1.0), (2, 1, 60, 1.0)], "walk_id int, step int, area long, score double")
    assert {r.walk_id: (r.kept, r.stop) for r in walk.walks(s).collect()} == {1: (1, "leaked"), 2: (1, "edge")}


def do(s: dict, action: str, **args) -> dict:
    return session.apply(s, action, args)


PLACE = dict(series="a", plane="axial", depth=3.0, thickness=3.3)


def test_session_undo_and_depth():
    s = session.empty()
    for _ in range(40):
        s = do(s, "add")
    assert (len(s["past"]), s["counter"], s["active"]) == (32, 40, 40)
    s = do(do(s, "undo"), "add")
    assert s["active"] == 41  # an id is never used again
    s = do(do(do(s, "point", **PLACE, at=[0, 0, 3], positive=True), "box", **PLACE, start=[0, 0, 3], end=[1, 1, 3]), "box", **PLACE, start=[0, 0, 3], end=[2, 2, 3])
    assert session.summary(1, s)[3:6] == (1, 2, 0)
    before = do(do(session.empty(), "add"), "add")
    picked = do(before, "select", object=1)
    assert picked["active"] == 1 and do(picked, "undo")["active"] == 2  # a selection is taken back too
    assert do(before, "select", object=9)["past"] == before["past"]


def test_session_actions():
    s = do(session.empty(), "point", **PLACE, at=[1, 2, 3], positive=True)  # makes its object; one undo takes both back
    assert (s["active"], len(s["past"]), s["pending"]) == (1, 1, ["1", "a|axial|3.000"]) and do(s, "undo")["objects"] == []
    key = s["pending"][1]
    with_mask = do(s, "attach", object=1, key=key, part="m")
    assert with_mask["pending"] is None and len(with_mask["past"]) == 1 and with_mask["objects"][0]["cuts"][0]["part"] == "m"
    s = do(with_mask, "point", **{**PLACE, "depth": 4.6}, at=[1, 2, 4], positive=False)  # within half a slab: the same cut, whose mask goes
    cut = s["objects"][0]["cuts"][0]
    assert len(s["objects"][0]["cuts"]) == 1 and len(cut["points"]) == 2 and cut["part"] is None
    s = do(do(s, "grow", object=1, **{**PLACE, "depth": 6.6}, part="g"), "grow", object=1, **{**PLACE, "depth": 6.6}, part="h")
    assert session.summary(1, s)[3:6] == (2, 2, 1) and s["objects"][0]["cuts"][1]["part"] == "h"
    taken = do(s, "point", **{**PLACE, "depth": 6.6}, at=[0, 0, 6], positive=True)  # a click takes a grown slice over
    assert session.summary(1, taken)[5] == 0 and taken["objects"][0]["cuts"][1]["part"] is None
    s = do(s, "note_growth", object=1, growth="edge")
    assert s["objects"][0]["growth"] == "edge" and do(s, "clear_grown", object=1)["objects"][0] == {**s["objects"][0], "growth": None, "cuts": s["objects"][0]["cuts"][:1]}
    assert do(s, "clear_cut", object=1, key=key)["objects"][0]["cuts"] == s["objects"][0]["cuts"][1:] and do(s, "clear_cut", object=1, key="x")["past"] == s["past"]
    assert do(s, "rename", object=1, label="  knee ")["objects"][0]["label"] == "knee" and do(s, "rename", object=1, label=" ")["past"] == s["past"]
    assert do(s, "hide", object=1, hidden=True)["objects"][0]["hidden"]
    two = do(s, "add")
    assert [o["colour"] for o in two["objects"]] == [0, 1] and do(two, "remove", object=1)["active"] == 2 and do(two, "remove", object=2)["active"] == 1 and do(do(two, "remove", object=1), "remove", object=2)["active"] is None
    assert do(s, "sing")["events"] == s["events"] + 1 and session.slice_key("u", "p", -0.0625) == "u|p|-0.063"


def test_session_views(spark):
    rows = [(1, 1, "point", {**PLACE, "at": [1, 2, 3], "positive": True}), (1, 2, "attach", {"object": 1, "key": "a|axial|3.000", "part": "m"}), (1, 3, "add", {}), (1, 4, "box", {**PLACE, "depth": 9.0, "start": [0, 0, 9], "end": [1, 1, 9]}), (1, 5, "hide", {"object": 9}), (2, 1, None, {}), (None, 1, "add", {})]
    events = spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in rows], "session_id long, seq long, action string, args string")
    states = session.fold(events)
    assert {r.session_id: (r.n_events, r.n_objects) for r in states.collect()} == {1: (5, 2), 2: (1, 0)}
    cuts, at = session.cuts(states), (F.lit("axial"), F.lit(3.0), 3.3)
    assert [(r.object, r.at, r.opacity, r.active) for r in session.prompt_marks(cuts, *at).collect()] == [(1, [1.0, 2.0, 3.0], 1.0, False)]
    assert [(r.object, r.box[1], round(r.opacity, 6)) for r in session.box_marks(cuts, *at).collect()] == [(2, [1.0, 1.0, 9.0], round(14 / 18.35, 6))]
    assert [(r.object, r.part) for r in session.visible_parts(cuts, *at).collect()] == [(1, "m")]
    x, y, z = session.cut_cursor(F.lit("axial"), F.lit(9.0), tuple(map(F.lit, (4.0, 5.0, 6.0))))
    assert tuple(spark.range(1).select(x, y, z).first()) == (4.0, 5.0, 9.0)


def test_hashed_uid_is_the_128_bit_number(spark):
    import hashlib

    uids = [f"1.2.{n}" for n in range(50)]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in uids], "u string").select(deid.hashed_uid(F.col("u"), "s")).collect()]
    assert got == ["2.25." + str(int.from_bytes(hashlib.sha256(b"s\0" + u.encode()).digest()[:16], "big")) for u in uids]


def test_hits_agree_beyond_the_broadcast(spark):
    e = spark.createDataFrame([(1, 1, "Hello Secret Person"), (2, 1, "abc"), (3, 1, None)], "entity int, tag int, value string")
    f = spark.createDataFrame([("secret person",), ("BC",), ("none of it here",), ("",)], "term string")
    want = {(1, "secret person"), (2, "bc")}
    for most in (100, 0):
        assert {(r.entity, r.term) for r in deid.hits(e, f, most_bytes=most).collect()} == want


def test_raw_bytes_in_both_encodings(spark):
    files = [(1, "xx JOSÉ María".encode("latin-1")), (2, "Ann Smith".encode("utf-16-le")), (3, b"nothing"), (4, "josé".encode("latin-1")), (5, None)]
    got = deid.byte_hits(spark.createDataFrame(files, "entity int, content binary"), spark.createDataFrame([("José",), ("ann smith",), (" ",), ("maría",)], "term string"))
    assert {tuple(r) for r in got.collect()} == {(1, "maría"), (2, "ann smith"), (4, "josé")}  # bytes fold A-Z only


def picture(syntax, rows=4, cols=5):
    px = np.arange(rows * cols, dtype=np.uint16) * 100
    big = syntax == part10.BIG
    us = lambda v: struct.pack(">H" if big else "<H", v)
    tags = {0x0020000E: ("UI", b"1.2.3"), 0x00200013: ("IS", b"7"), 0x00280010: ("US", us(rows)), 0x00280011: ("US", us(cols)), 0x00280100: ("US", us(16)), 0x00280103: ("US", us(0)), 0x00200032: ("DS", b"1\\2\\3.5"), 0x7FE00010: ("OW", px.astype(">u2" if big else "<u2").tobytes())}
    return part10.write_file(tags, syntax), px


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", part10.IMPLICIT, part10.BIG])
def test_image_files(spark, tmp_path, syntax):
    data, px = picture(syntax)
    (tmp_path / "a.dcm").write_bytes(data)
    (tmp_path / "b.dcm").write_bytes(b"\0" * 200)
    (tmp_path / "c.txt").write_bytes(b"\0" * 20)
    files = part10.candidates(spark, str(tmp_path))
    rows, bad = part10.elements(files)
    assert [r.reason for r in bad.collect()] == ["no magic word"]
    i = part10.instances(rows)[0].first()
    assert (i.rows, i.cols, i.series_uid, i.instance_number, i.position, i.modality, i.row_axis, i.between) == (4, 5, "1.2.3", 7, [1.0, 2.0, 3.5], "OT", [1.0, 0.0, 0.0], None)
    got, none = part10.pixels(files)
    assert [r.stored for r in got.orderBy("at").collect()] == px.tolist() and [r.reason for r in none.collect()] == ["no magic word"]


def test_broken_images_are_rejects(spark):
    us = lambda v: ("US", struct.pack("<H", v))
    size = {0x00280010: us(2), 0x00280011: us(2)}
    deep = b"".join(struct.pack("<HH2sHI", 0x0008, 0x1140, b"SQ", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) for _ in range(3000))
    made = {
        "jpeg": part10.write_file(size, "1.2.840.10008.1.2.4.70", [b"xx"]), "short": part10.write_file(size | {0x7FE00010: ("OW", b"1234")}), "none": part10.write_file(size), "sizeless": part10.write_file({0x00080060: ("CS", b"MR")}),
        "frames": part10.write_file(size | {0x00280008: ("IS", b"2"), 0x7FE00010: ("OW", bytes(8))}), "deep": part10.write_file(size) + deep, "bits": part10.write_file(size | {0x00280100: us(12), 0x7FE00010: ("OW", bytes(8))}), "empty": b"",
        "signed": part10.write_file(size | {0x00280101: us(12), 0x00280103: us(1), 0x7FE00010: ("OW", struct.pack("<4H", 0xF001, 0x0FFF, 0x0800, 0x07FF))}),
    }
    files = spark.createDataFrame(list(made.items()), "path string, content binary")
    good, bad = part10.pixels(files)
    why = {(r.path, r.frame): r.reason for r in bad.collect()}
    assert why == {("jpeg", 0): "needs an image codec: 1.2.840.10008.1.2.4.70", ("short", 0): "truncated pixel data", ("none", 0): "no pixel data", ("sizeless", 0): "no rows or columns", ("frames", 1): "truncated pixel data", ("deep", 0): "nested too deep", ("bits", 0): "12 bits a sample", ("empty", 0): "too short"}
    assert [r.stored for r in good.filter("path = 'signed'").orderBy("at").collect()] == [1, -1, -2048, 2047] and good.filter("path = 'frames'").count() == 4
    rows, unread = part10.elements(files)
    assert {r.path for r in unread.collect()} == {"deep", "empty"} and [r.path for r in part10.instances(rows)[1].collect()] == ["sizeless"]


def test_stacks_of_unequal_or_turned_slices(spark):
    def row(path, key, z, rows=2, x=0.0, axis=(1.0, 0.0, 0.0), number=1, samples=1):
        return (path, key, rows, 2, [x, 0.0, z], list(axis), [0.0, 1.0, 0.0], number, samples)

    rows = [row("a", "one", 5.0), row("b", "two", 1.0), row("c", "two", 1.0, number=0), row("d", "size", 1.0), row("e", "size", 2.0, rows=3), row("f", "rgb", 1.0, samples=3), row("g", "odd", 0.0), row("h", "odd", 3.0, x=0.6), row("i", "odd", 4.0, axis=(0.0, 0.0, 1.0))]
    i = spark.createDataFrame(rows, "path string, series_key string, rows int, cols int, position array<double>, row_axis array<double>, col_axis array<double>, instance_number int, samples int")
    for c in ("row_spacing", "col_spacing", "slope", "intercept", "thickness"):
        i = i.withColumn(c, F.lit(2.5))
    i = i.withColumn("between", F.lit(None).cast("double")).withColumns({c: F.lit(0.0) for c in ("center", "width")}).withColumns({c: F.lit("") for c in ("description", "modality", "frame_uid")}).withColumn("series_number", F.lit(1)).withColumn("signed", F.lit(False))
    volumes, stack, rejected = series.volumes(i)
    assert {r.series_key: r.reason for r in rejected.collect()} == {"size": "slices differ in size", "rgb": "several samples a pixel"}
    got = {r.volume_id: (r.dims, r.spacing[2], r.warnings) for r in volumes.collect()}
    assert got == {"one": ([2, 2, 1], 2.5, []), "two": ([2, 2, 2], 2.5, ["not_advancing"]), "odd": ([2, 2, 3], 2.0, ["mixed_orientation", "sideways", "uneven_spacing"])}
    assert [r.path for r in stack.filter("series_key = 'two'").orderBy("k").collect()] == ["c", "b"]


def test_big_endian_tags_parse():
    rows = part10.Reader(picture(part10.BIG)[0]).parse()
    assert {r[2] for r in rows} >= {0x00280010, 0x7FE00010}


def test_run_length_planes():
    px = np.array([1, 1, 1, 500, 70, 70], dtype="<u2")
    hi, lo = part10.pack_bits((px >> 8).astype(np.uint8).tobytes()), part10.pack_bits((px & 255).astype(np.uint8).tobytes())
    data = struct.pack("<16I", 2, 64, 64 + len(hi), *[0] * 13) + hi + lo
    assert np.frombuffer(part10.unpack_rle(data, 6, 2), "<u2").tolist() == px.tolist()


def test_nested_sequences_keep_their_path():
    inner = struct.pack("<HH2sH", 0x0008, 0x0060, b"CS", 2) + b"MR"
    item = struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner
    seq = struct.pack("<HH2sHI", 0x0008, 0x1140, b"SQ", 0, len(item)) + item
    rows = part10.Reader(part10.write_file({}) + seq).parse()
    assert [(r[0], r[2]) for r in rows if r[0]] == [((0x00081140,), 0x00080060)]


def test_packed_volume_round_trip(spark):
    a = np.arange(4 * 3 * 2).reshape(4, 3, 2)
    b = spark.createDataFrame([("v", 2, 3, 4, "uint16", a.astype("<u2").tobytes())], "volume_id string, nx int, ny int, nz int, data_type string, content binary")
    v = packed.voxels(b)
    assert [r.stored for r in v.orderBy("idx").collect()] == list(range(24))
    parts = packed.slab_blobs(v, slab=3).orderBy("slab").collect()
    assert b"".join(p.content for p in parts) == a.astype("<u2").tobytes()


def test_manifest_problems(spark, tmp_path):
    import json

    side = {"url": "x", "bytes": 48, "dataType": "uint16", "dims": [2, 3, 4], "spacing": [1, 1, 1], "origin": [0, 0, 0]}
    good = {"format": packed.FORMAT, "series": [{"name": "a", "full": side}, {"name": "b", "full": side | {"bytes": 5, "dataType": "float"}}]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    got = {(r.name, r.field) for r in packed.problems(packed.read_manifest(spark, str(tmp_path / "m.json"))).collect()}
    assert got == {("b", "bytes"), ("b", "dataType")}


def test_candidates_have_the_magic_word(spark, tmp_path):
    (tmp_path / "image").write_bytes(picture("1.2.840.10008.1.2.1")[0])
    (tmp_path / "long.txt").write_bytes(b"x" * 500)
    (tmp_path / "short.dcm").write_bytes(bytes(128) + b"DICM")
    assert [r.path.rsplit("/", 1)[-1] for r in part10.candidates(spark, str(tmp_path), magic_only=True).select("path").collect()] == ["image"]
    assert part10.candidates(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", part10.BIG])
def test_tags_as_values(syntax):
    order = ">" if syntax == part10.BIG else "<"
    file = part10.Reader(part10.write_file({0x00280009: ("AT", struct.pack(order + "4H", 0x0018, 0x1063, 0x7FE0, 0x0010)), 0x00280004: ("AT", b"")}, syntax))
    rows = file.parse()
    got = {r[2]: numbers for r, (_, numbers) in zip(rows, file.values(), strict=True)}
    assert got[0x00280009] == [float(0x00181063), float(0x7FE00010)] and got[0x00280004] == []


def test_long_profiles_and_short_plans(spark):
    """A profile of any number of tags is a join; a hashed UID is computed once."""
    rows = [("e", t, "UI", "1.2.3", path) for t, path in ((0x00080018, []), (0x00080020, []), (0x00100010, [0x00400280]), (0x00100020, [0x00081140]), (0x00100030, None))]
    e = spark.createDataFrame(rows, "entity string, tag long, vr string, value string, seq_path array<long>")
    remove = spark.range(0x00400000, 0x00400000 + 20_000).toDF("tag").union(spark.range(0x00080020, 0x00080021).toDF("tag"))
    remap = spark.createDataFrame([(0x00080018,)], "tag long")
    out = deid.scrub(e, remove, remap, [], "s")
    got = {r.tag: r.value for r in out.collect()}
    assert out.columns == e.columns and set(got) == {0x00080018, 0x00100020, 0x00100030}
    assert got[0x00080018].startswith("2.25.") and got[0x00100020] == "1.2.3"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sha2") <= 2


def test_sequences_of_known_length_in_files_without_vrs():
    """The dictionary tells a sequence from bytes: its items are read, whatever their lengths."""
    put = lambda t, v: struct.pack("<HHI", t >> 16, t & 0xFFFF, len(v)) + v
    inner = put(0x00081155, b"1.2.3\0")
    seq = put(0x00081140, put(0xFFFEE000, inner) + put(0xFFFEE000, inner))
    file = part10.Reader(part10.write_file({0x00080020: ("DA", b"20240102")}, part10.IMPLICIT) + seq + put(0x00200010, b"S1"))
    rows = file.parse()
    got = [(r[0], r[1], hex(r[2]), r[3], text) for r, (text, _) in zip(rows, file.values(), strict=True) if r[2] >> 16 != 2]
    assert got == [((), 0, "0x80020", "DA", "20240102"), ((0x00081140,), 0, "0x81155", "UI", "1.2.3"), ((0x00081140,), 1, "0x81155", "UI", "1.2.3"), ((), 0, "0x200010", "SH", "S1")]


def test_partners_and_angles_of_many_series_of_one_direction(spark):
    """Against all pairs; as many series of one direction as there are meet no more rows than a few."""
    rng, axes = np.random.default_rng(3), [(1.0, 0.0, 0.0), (0.6, 0.8, 0.0), (0.8, 0.6, 0.0), (0.0, 0.3, 0.0), (None, 0.0, 0.0)]
    rows = [(f"u{n // 2 if n < 20 else n}", ("t1", "fatsat", "pd", "unknown")[rng.integers(4)], "fg"[rng.integers(2)], int(rng.integers(4)), *axes[rng.integers(5)]) for n in range(120)]
    v = spark.createDataFrame(rows, "uid string, kind string, frame string, slices int, ax double, ay double, az double")
    dot = lambda a, b: None if a[4] is None or b[4] is None else sum(x * y for x, y in zip(a[4:], b[4:], strict=True))
    want, angled = {}, set()
    for a, b in itertools.product(rows, rows):
        if a[2] == b[2] and a[0] != b[0]:
            d = dot(a, b)
            if {a[1], b[1]} == {"t1", "fatsat"}:
                key = (1, 0) if d is None else (0, -round(abs(d), 9))
                want[a[0]] = min(want.get(a[0], ((9,), 0, "")), (key, -b[3], b[0]))
            if a[1] == b[1] != "unknown" and d is not None and abs(d) < 0.9:
                angled.add((a[1], a[2]))
    got = series.best_partner(v)
    assert {r.active: (r.partner, r.agreement) for r in got.collect()} == {u: (p, None if k[0] else -k[1]) for u, (k, _, p) in want.items()}
    c = series.fusion_candidate(v).first()
    sizes = {k: sum((r[1], r[2]) == k for r in rows) for k in angled}
    assert c.n == max(sizes.values()) and sizes[c.kind, c.frame] == c.n
    alike = spark.range(4000).selectExpr("cast(id as string) uid", "if(id % 2 = 0, 't1', 'fatsat') kind", "'f' frame", "1 slices", "1.0D ax", "0.0D ay", "0.0D az")

    def most(df):
        """The greatest number of rows that a join of the plan that ran gave."""
        df.collect()
        seen, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            p = todo.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                p = p.executedPlan()
            if hasattr(p, "plan") and "QueryStage" in p.nodeName():
                p = p.plan()
            if "Join" in p.nodeName():
                seen.append(p.metrics().apply("numOutputRows").value())
            kids = p.children()
            todo += [kids.apply(n) for n in range(kids.size())]
        return max(seen, default=0)

    assert most(series.best_partner(alike)) <= 8000 and most(series.fusion_candidate(alike)) <= 8000


def test_hits_leave_without_their_texts():
    """A text of 1 MB that holds 300 terms: the memory of its hits is that of the terms."""
    import pyarrow as pa

    terms = [f"t{n:03}" for n in range(300)]
    batch = pa.RecordBatch.from_pydict({"entity": list(range(600)), "tag": [0] * 600, "low": [" ".join(terms) + " " * (1 << 20 if n == 7 else 1) for n in range(600)]})
    pool = pa.default_memory_pool()
    before, most, got = pool.bytes_allocated(), 0, 0
    for b in deid._finder(type("T", (), {"value": terms}))(iter([batch])):
        most, got = max(most, pool.bytes_allocated() - before), got + b.num_rows
        assert b.num_rows <= 300 * deid.ROWS
    assert got == 600 * 300 and most < 16 << 20


def test_packed_session_holds_shared_states_once():
    s, sizes = session.empty(), {}
    for n in range(400):
        s = session.apply(s, "point", {"plane": "axial", "series": "s", "depth": float(n % 5), "thickness": 1.0, "at": [n / 7, 0.0, 0.0], "positive": True})
        sizes[n] = len(session.packed(s)), len(json.dumps(s))
    back = session.unpacked(session.packed(s))
    assert back == s and back["past"][-1][0][0]["cuts"][1] is back["past"][-2][0][0]["cuts"][1]
    assert all(a * 4 < b for n, (a, b) in sizes.items() if n > 50)
    assert session.unpacked(session.packed(session.empty())) == session.empty()
