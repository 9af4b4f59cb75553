"""The shape queries against plain loops over whole arrays, all three scales."""

import itertools

import numpy as np
import pytest

from voxelake.operators import graph, histogram, slabs
from voxelake.plans import volumes
from voxelake.sources.grids import t1_voxels

SCALES = (0.7, 1.4, 2.8)


def blurred(a, sigma):
    r = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    for axis in (2, 1, 0):
        at = [np.clip(np.arange(a.shape[axis]) + t, 0, a.shape[axis] - 1) for t in range(-r, r + 1)]
        a = sum(x * np.take(a, p, axis=axis) for x, p in zip(w / w.sum(), at, strict=True)).astype(np.float32)
    return a.astype(float)


def by_loops(a, least):
    """{idx: (kind, confidence, sigma)} of inner voxels; blocks are one voxel at 1 mm up to a sigma of 2 mm, and at 2.8 mm too."""
    nz, ny, nx = a.shape
    fields = {s: blurred(a, s) for s in SCALES}
    out = {}
    for k, j, i in itertools.product(range(1, nz - 1), range(1, ny - 1), range(1, nx - 1)):
        best = None
        for s in SCALES:
            c = fields[s][k - 1 : k + 2, j - 1 : j + 2, i - 1 : i + 2]
            zz, yy, xx = c[2, 1, 1] + c[0, 1, 1] - 2 * c[1, 1, 1], c[1, 2, 1] + c[1, 0, 1] - 2 * c[1, 1, 1], c[1, 1, 2] + c[1, 1, 0] - 2 * c[1, 1, 1]
            xy = (c[1, 2, 2] - c[1, 0, 2] - c[1, 2, 0] + c[1, 0, 0]) / 4
            xz = (c[2, 1, 2] - c[0, 1, 2] - c[2, 1, 0] + c[0, 1, 0]) / 4
            yz = (c[2, 2, 1] - c[0, 2, 1] - c[2, 0, 1] + c[0, 0, 1]) / 4
            e = sorted(np.linalg.eigvalsh([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]) * s * s, key=abs)
            if e[2] > 0 and (best is None or e[2] > best[0][2]):
                best = (e, s)
        if best is None:
            continue
        (small, middle, large), s = best
        mid, low = max(middle, 0) / large, abs(small) / large
        score = {"tube": mid * (1 - low), "sheet": 1 - mid, "blob": low}
        kind, second = sorted(score, key=score.get)[-1], sorted(score.values())[1]
        sure = min(1, max(0, (score[kind] - second) * (1 - np.exp(-(large * large) / (2 * 0.05 * 0.05))) * (1 - max(0, -middle) / large)))
        none = sure <= 0 or sure < least
        out[(k * ny + j) * nx + i] = ("none", 0.0, s) if none else (kind, sure, s)
    return out


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark, sf_dir):
    """Twelve slices, smooth along the stack, so that each scale answers somewhere."""
    folder = str(tmp_path_factory.mktemp("small"))
    rng = np.random.default_rng(4)
    noise = blurred(rng.standard_normal((12, 8, 8)), 1.0)
    a = np.clip(noise / np.abs(noise).max() + 0.3 * rng.standard_normal((12, 8, 8)), -0.95, 0.95)
    rows = [(k, [float(x) for x in a[k].ravel()]) for k in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(folder + "/embeddings.parquet")
    f = histogram.signals(t1_voxels(spark, folder)).orderBy("idx").toPandas()
    return folder, f.signal.to_numpy().reshape(12, 8, 8).astype(np.float32)


def test_shapes_equal_loops(spark, small):
    folder, a = small
    want = by_loops(a, 0.08)
    got = {r.idx: (r.kind, r.confidence, r.sigma) for r in volumes.shp8(spark, folder).collect()}
    assert {s for *_, s in want.values()} == set(SCALES)
    assert {x: (k, s) for x, (k, _, s) in got.items()} == {x: (k, s) for x, (k, _, s) in want.items()}
    assert max(abs(got[x][1] - want[x][1]) for x in want) < 1e-4


def test_structures_equal_loops(spark, small):
    folder, a = small
    dark = {r.idx for r in graph.mark_marrow(volumes.classified(spark, folder).select("volume_id", "idx", "k", "j", "i", "tissue"), slabs.one_grid(spark, 8, 8, 12, volume_id="t1")).filter("tissue = 'dark'").select("idx").collect()}
    shapes = {x: v for x, v in by_loops(a, 0.0).items() if x in dark and v[0] != "none"}
    groups, seen = [], set()
    for start in sorted(shapes):
        todo, members = [start], set()
        while todo:
            x = todo.pop()
            if x in members or x in seen:
                continue
            members.add(x)
            k, j, i = x // 64, x // 8 % 8, x % 8
            for dk, dj, di in itertools.product((-1, 0, 1), repeat=3):
                y = ((k + dk) * 8 + j + dj) * 8 + i + di
                if 0 <= j + dj < 8 and 0 <= i + di < 8 and y in shapes and shapes[y][0] == shapes[start][0]:
                    todo.append(y)
        seen |= members
        sure = [x for x in members if shapes[x][1] >= 0.01]
        if sure:
            groups.append((min(sure), shapes[start][0], len(members)))
    got = volumes.grf11(spark, folder).select("component_id", "kind", "voxels").collect()
    want = [(n, kind, size) for n, (_, kind, size) in enumerate(sorted(groups))]
    assert sorted(tuple(r) for r in got) == want and len(want) > 3
