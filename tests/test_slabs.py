"""Slab kernels over volumes of different size: components, shapes, rays and lines against whole arrays."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelake.operators import graph, histogram, lines, shape, slabs, tissue
from voxelake.plans import registry
from voxelake.sources import layout

SIZES = {"a": (11, 6, 5), "b": (4, 7, 9)}  # nz, ny, nx


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(8)
    return {v: rng.integers(0, 100, n).astype(float) for v, n in SIZES.items()}


def frame(spark, arrays, name="value"):
    parts = []
    for v, a in arrays.items():
        k, j, i = (x.ravel() for x in np.indices(a.shape))
        parts.append(pd.DataFrame({"volume_id": v, "idx": np.arange(a.size), "k": k, "j": j, "i": i, name: a.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


@pytest.fixture(scope="module")
def field(spark, arrays):
    return frame(spark, arrays)


@pytest.fixture(scope="module")
def grid(field):
    return slabs.grid_of(field, (1.0, 1.5, 2.0)).cache()


def flooded(member, same, offsets):
    out, order = {}, [tuple(x) for x in np.argwhere(member)]
    for start in order:
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x in out:
                continue
            out[x] = np.ravel_multi_index(start, member.shape)
            for i, j, k in offsets:
                y = (x[0] + k, x[1] + j, x[2] + i)
                if all(0 <= c < n for c, n in zip(y, member.shape, strict=True)) and member[y] and same[y] == same[x]:
                    todo.append(y)
    return {int(np.ravel_multi_index(x, member.shape)): int(c) for x, c in out.items()}


@pytest.mark.parametrize("depth", [1, 2, 16])
@pytest.mark.parametrize("offsets", [graph.SIX, graph.TWENTY_SIX])
def test_components_equal_a_flood(field, grid, arrays, depth, offsets):
    low = field.filter("value < 55").withColumn("half", (F.col("value") < 25).cast("int"))
    got = {v: {} for v in arrays}
    for r in graph.components(low, grid, offsets, "half", depth).collect():
        got[r.volume_id][r.idx] = r.component
    assert got == {v: flooded(a < 55, a < 25, offsets) for v, a in arrays.items()}


def test_only_faces_make_edges(spark):
    """One solid volume: labels of slabs are joined by one edge a face, whatever the size of the face."""
    v = frame(spark, {"v": np.ones((12, 8, 8))})
    labelled = graph.slab_labels(v, slabs.grid_of(v), graph.SIX, depth=3)
    assert labelled.filter("side < 2").count() == 12 * 64 and labelled.filter("side = 2").count() == 3 * 64
    assert graph.face_edges(labelled).count() == 3
    assert {r.component for r in graph.components(v, slabs.grid_of(v), graph.SIX, depth=3).collect()} == {0}


def test_a_winding_path_and_no_member(spark):
    """A snake through all slabs, whose labels take several star rounds; a volume without members."""
    a = np.zeros((16, 5, 9))
    for n in range(9):
        a[:, 0, n] = n % 2 == 0
    for n in range(0, 8, 2):
        a[15 if n % 4 == 0 else 0, 0, n + 1] = 1
    v = frame(spark, {"v": a})
    got = graph.components(v.filter("value = 1"), slabs.grid_of(v), graph.SIX, depth=1)
    assert {r.component for r in got.collect()} == {0} and got.count() == int(a.sum())
    assert graph.components(v.filter("value = 7"), slabs.grid_of(v), graph.SIX).count() == 0


def test_two_volumes_in_one_call_equal_two_calls(spark, field, grid):
    both = {(r.volume_id, r.idx): (r.kind, r.confidence, r.sigma) for r in shape.shapes(field, grid, least=0.0).collect()}
    smooth = {(r.volume_id, r.idx): r.value for r in shape.smooth(field, 1.4, grid, depth=2).collect()}
    assert {v for v, _ in both} == set(SIZES) and len(smooth) == sum(np.prod(n) for n in SIZES.values())
    for v in SIZES:
        one, g = field.filter(F.col("volume_id") == v), grid.filter(F.col("volume_id") == v)
        assert {(v, r.idx): (r.kind, r.confidence, r.sigma) for r in shape.shapes(one, g, least=0.0).collect()} == {x: y for x, y in both.items() if x[0] == v}
        assert {(v, r.idx): r.value for r in shape.smooth(one, 1.4, g, depth=16).collect()} == {x: y for x, y in smooth.items() if x[0] == v}


@pytest.mark.parametrize("spacing", [(0.27, 0.27, 0.4), (0.6, 0.6, 3.3), (1.0, 1.0, 1.0)])
def test_slabs_do_not_show_in_shapes(spark, monkeypatch, spacing):
    """Blocks, halos and borders: slabs of a few slices give what one slab of all gives."""
    a = np.random.default_rng(3).random((23, 13, 14))
    v = frame(spark, {"v": a})
    whole = shape.shapes(v, slabs.grid_of(v, spacing), least=0.0).toPandas().sort_values("idx").reset_index(drop=True)
    monkeypatch.setattr(slabs, "DEPTH", 4)
    monkeypatch.setattr(slabs.over_slabs, "__kwdefaults__", {**slabs.over_slabs.__kwdefaults__, "depth": 4})
    cut = shape.shapes(v, slabs.grid_of(v, spacing), least=0.0).toPandas().sort_values("idx").reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut)
    assert len(whole) > 100 and whole.sigma.nunique() > 1


def test_array_rules_equal_column_rules(spark):
    m = np.random.default_rng(5).normal(size=(400, 6)) * 0.1
    m[:40, 3:] = 0
    df = spark.createDataFrame(pd.DataFrame(m, columns=shape.SECOND))
    e = shape.eigenvalues(*(F.col(c) for c in shape.SECOND))
    kind, sure = shape.shape(*(F.get("e", F.lit(n)) for n in range(3)))
    got = df.select("*", e.alias("e")).select("e", kind.alias("kind"), sure.alias("sure")).toPandas()
    own = shape.eigen(*m.T)
    assert np.abs(np.array(got.e.tolist()) - own).max() < 1e-7
    place, confidence = shape.named(*own.T)
    assert [("none", "tube", "sheet", "blob")[p] for p in place] == got.kind.tolist()
    assert np.abs(confidence - got.sure).max() < 1e-6


def test_studies_do_not_meet(spark, arrays):
    def of(name, by):
        parts = {v: np.floor(a * by) for v, a in arrays.items()}
        return frame(spark, parts, "stored").withColumn("study", F.col("volume_id")).withColumn("volume_id", F.concat("volume_id", F.lit(name)))

    t1, fs = of(" t1", 40), of(" fs", 33)
    both = {(r.study, r.idx): (r.tissue, r.confidence) for r in tissue.classify(t1, fs, ["study"]).collect()}
    assert len(both) == sum(np.prod(n) for n in SIZES.values())
    for v in SIZES:
        one = tissue.classify(t1.filter(F.col("study") == v), fs.filter(F.col("study") == v))
        assert {(v, r.idx): (r.tissue, r.confidence) for r in one.collect()} == {x: y for x, y in both.items() if x[0] == v}


def test_rays_meet_what_loops_meet(spark, arrays):
    names = np.array(["dark", "marrow", "muscle", "fat", "fluid"])
    kinds = {v: names[(a // 15).astype(int).clip(0, 4) * (a < 75)] for v, a in arrays.items()}
    t = frame(spark, kinds, "tissue")
    g = slabs.grid_of(t, (1.0, 1.5, 2.0))
    got = {(r.volume_id, r.idx): tuple(r[2:]) for r in graph.rays_met(t, g, 4.0).collect()}
    want = {}
    for v, a in kinds.items():
        for k, j, i in np.argwhere(a == "dark"):
            met = []
            for (di, dj, dk), size in zip(graph.SIX, (1.0, 1.5, 2.0) * 2, strict=True):
                found = -1
                for n in range(1, max(1, int(4.0 // size)) + 1):
                    z, y, x = k + n * dk, j + n * dj, i + n * di
                    if not (0 <= z < a.shape[0] and 0 <= y < a.shape[1] and 0 <= x < a.shape[2]):
                        break
                    if a[z, y, x] != "dark":
                        found = {"marrow": 0, "muscle": 1, "fat": 2}.get(a[z, y, x], 3)
                        break
                met.append(found)
            want[v, int(np.ravel_multi_index((k, j, i), a.shape))] = tuple(met)
    assert got == want and len(want) > 50


def read(a, p):
    p = [min(max(x, 0.0), n - 1.0) for x, n in zip(p, a.shape[::-1], strict=True)]
    low = [int(np.floor(x)) for x in p]
    out = 0.0
    for c in itertools.product((0, 1), repeat=3):
        at = [min(b + d, n - 1) for b, d, n in zip(low, c, a.shape[::-1], strict=True)]
        out += np.prod([abs(1 - d - (x - b)) for x, b, d in zip(p, low, c, strict=True)]) * a[at[2], at[1], at[0]]
    return out


@pytest.fixture(scope="module")
def cameras(spark, arrays):
    rng = np.random.default_rng(9)
    rows = []
    for n in range(60):
        v = "ab"[n % 2]
        size = np.array(SIZES[v][::-1]) - 1.0
        o, t = rng.uniform(-1, 2, 3) * size, rng.uniform(0, 1, 3) * size
        if n % 7 == 0:
            t[:2] = o[:2]  # along the stack
        elif n % 11 == 0:
            t[2] = o[2]  # within a slice
        rows.append((v, n, *map(float, o), *map(float, t)))
    rows.append(("a", 60, *[1.0] * 6))  # no direction
    return spark.createDataFrame(rows, "volume_id string, ray long, ox double, oy double, oz double, tx double, ty double, tz double"), rows


@pytest.mark.parametrize("depth,clip", [(2, ()), (16, ((0.0, 0.3, 1.0, -4.0),))])
def test_march_equals_a_loop(field, grid, arrays, cameras, depth, clip):
    df, rows = cameras
    how = {"center": 50.0, "width": 80.0, "opacity": 4.0, "threshold": 0.2, "edge_boost": 0.6, "light": 0.7}
    got = {r.ray: r for r in lines.march(lines.rays(df, grid, 0.4), field, grid, "ray", **how, clip=clip, depth=depth).collect()}
    assert len(got) == 61 and (got[60].alpha, got[60].gray, got[60].stop) == (0, 0, None) and 10 < sum(r.stop is not None for r in got.values()) < 58
    for v, n, *p in rows[:60]:
        a, o, t = arrays[v], np.array(p[:3]), np.array(p[3:])
        d = (t - o) / np.linalg.norm(t - o)
        size = np.array(a.shape[::-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = np.sort(np.stack([(-0.5 - o) / np.where(d == 0, 1e-300, d), (size - 0.5 - o) / np.where(d == 0, 1e-300, d)]), axis=0)
        near, far = sides[0].max(), sides[1].min()
        gray_of = lambda p, a=a: min(1.0, max(0.0, (read(a, p) - 10.0) / 80.0))
        alpha = gray = 0.0
        stop = None
        if far > max(near, 0):
            for step in range(1024):
                along = max(near, 0) + step * 0.4
                if along > far or alpha > 0.995:
                    break
                x = o + d * along
                g = gray_of(x)
                if g <= 0.2 or any(np.dot(c[:3], x) + c[3] > 0 for c in clip):
                    continue
                slope = np.array([gray_of(x + e) - gray_of(x - e) for e in np.eye(3)])
                length = np.linalg.norm(slope)
                unit = slope / length if length > 1e-5 else np.array([0, 0, 1.0])
                one = min(1.0, max(0.0, ((g - 0.2) / 0.8) ** 2 * (1 + (min(1.0, length * 12) - 1) * 0.6) * 4.0 * 0.4))
                if one <= 0.0005:
                    continue
                gray += (1 - alpha) * one * g * (1 + (0.35 + 0.65 * abs(unit @ d) - 1) * 0.7)
                alpha += (1 - alpha) * one
                if alpha > 0.995:
                    stop = along
        assert got[n].alpha == pytest.approx(alpha, abs=1e-9) and got[n].gray == pytest.approx(gray, abs=1e-9)
        assert got[n].stop == (None if stop is None else pytest.approx(stop, abs=1e-9))


@pytest.mark.parametrize("depth", [2, 16])
def test_oblique_slab_equals_a_loop(spark, field, grid, arrays, depth):
    to_voxel = (1.0, 0.1, 0.0, 0.2, 0.0, 0.7, 0.1, 0.0, 0.2, 0.0, 0.5, 1.0)
    pixels = [(v, n, float(n % 6), float(n // 6)) for v in SIZES for n in range(30)]
    df = spark.createDataFrame(pixels, "volume_id string, pixel long, a double, b double")
    u, w = (0.6, 0.0, 0.8), (0.0, 1.0, 0.0)
    own = lines.plane_lines(df, (0.5, 0.0, 1.0), u, w, 6.0, 5, to_voxel)
    got = {(r.volume_id, r.pixel): (r.value, r.step) for r in lines.projected(own, field, grid, "pixel", depth).collect()}
    normal, m, seen = np.cross(u, w), np.array(to_voxel).reshape(3, 4), 0
    for v, n, a, b in pixels:
        best = None
        for step in range(5):
            p = np.array([0.5, 0.0, 1.0]) + np.array(u) * a + np.array(w) * b + normal * ((step / 4 - 0.5) * 6.0)
            x = m[:, :3] @ p + m[:, 3]
            if all(-0.5 <= c <= s - 0.5 for c, s in zip(x, arrays[v].shape[::-1], strict=True)):
                value = read(arrays[v], x)
                if best is None or value > best[0] + 1e-9:
                    best = (value, step)
        assert (best is None) == ((v, n) not in got)
        if best:
            seen += 1
            assert got[v, n] == (pytest.approx(best[0], abs=1e-9), best[1])
    assert seen > 20


def test_histogram_scale_is_each_volumes_own(field):
    assert histogram.muscle_ranges(field.withColumnRenamed("value", "stored")).count() == 2


def test_laid_out_tables_meet_without_a_shuffle(spark, arrays):
    """Two studies of different size: the same results as by shuffle, and no Exchange under the joins."""
    t1 = histogram.signals(frame(spark, {v: np.floor(a * 40) for v, a in arrays.items()}, "stored"))
    fs = histogram.signals(frame(spark, {v: np.floor(a * 33) for v, a in arrays.items()}, "stored"))
    one, other = (layout.lay_out(slabs.spread(x, slabs.grid_of(x), ["signal"], 1)) for x in (t1, fs))
    got = tissue.classify_laid_out(one, other)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = tissue.classify(t1.drop("signal").withColumn("study", F.col("volume_id")), fs.drop("signal").withColumn("study", F.col("volume_id")), ["study"])
    assert {(r.volume_id, r.idx): (r.tissue, r.confidence) for r in got.collect()} == {(r.volume_id, r.idx): (r.tissue, r.confidence) for r in plain.collect()}
    values = layout.lay_out(slabs.spread(t1.withColumnRenamed("signal", "value"), slabs.grid_of(t1), ["value"], 1))
    near = shape.hessian_of(values)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    far = shape.hessian(t1.withColumnRenamed("signal", "value"), slabs.grid_of(t1))
    assert sorted(near.collect()) == sorted(far.collect()) and near.count() > 50


def test_oblique_slab_sends_no_lines_to_the_driver(spark, sf_dir):
    # lines made of one grid row look small in the plan, whatever their number: they must not be a side of a join
    plan = registry.queries()["geo17_oblique_slab"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "pixel" in x]


def test_faces_are_joined_in_groups_of_slabs(spark):
    """Random grids of one slice a slab, groups of three slabs (four levels): brute-force components, and a bounded number of jobs."""
    rng = random.Random(5)
    cells = [(v, k, j, i) for v in "ab" for k in range(60 if v == "a" else 7) for j in range(3) for i in range(3) if rng.random() < 0.62]
    v = spark.createDataFrame([(v, (k * 3 + j) * 3 + i, k, j, i) for v, k, j, i in cells], "volume_id string, idx long, k int, j int, i int")
    grid = spark.createDataFrame([("a", 3, 3, 60, 1.0, 1.0, 1.0), ("b", 3, 3, 7, 1.0, 1.0, 1.0)], "volume_id string, nx int, ny int, nz int, sx double, sy double, sz double")
    want, left = {}, set(cells)
    for c in sorted(cells, key=lambda c: (c[0], (c[1] * 3 + c[2]) * 3 + c[3])):
        todo = [c]
        while todo:
            at = todo.pop()
            if at in left:
                left.discard(at)
                want[at] = (c[1] * 3 + c[2]) * 3 + c[3]
                todo += [(at[0], at[1] + dk, at[2] + dj, at[3] + di) for di, dj, dk in graph.SIX]
    want = {(v, (k * 3 + j) * 3 + i): n for (v, k, j, i), n in want.items()}
    labelled = graph.slab_labels(v, grid, graph.SIX, depth=1).filter("side < 2").cache()
    top = {(r.volume_id, r.label): r.component for r in graph.face_roots(graph.face_edges(graph.slab_labels(v, grid, graph.SIX, depth=1)), 3).collect()}
    assert {(r.volume_id, r.idx): top.get((r.volume_id, r.label), r.label) for r in labelled.collect()} == want
    spark.sparkContext.setJobGroup("faces", "")
    assert {(r.volume_id, r.idx): r.component for r in graph.components(v, grid, graph.SIX, depth=1).collect()} == want
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("faces"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20, jobs
