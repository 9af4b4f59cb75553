"""Flood fill, connected components and the evidence of dark structures, of many volumes at once.

Voxels carry volume_id and idx; sizes come from the grid table (see ``slabs``).
Components have levels. Within a slab of slices, union-find joins neighbours in a
kernel, which sees one slice of the next slab too. The voxels of that slice have a label
on either side; pairs of labels are the only edges that travel. A task joins those of
``SLABS`` slabs in a row, and what is left between such groups goes up with its labels
replaced by the smallest that they reach, to groups of groups: a volume of n slabs has
as many rounds as n has digits in that base. An edge is a distinct pair of labels within
one slice, so a task is bounded by the size of an image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.operators import slabs
from voxelake.operators.slabs import PLACE, Slab
from voxelake.sources.shared import materialize

SIX = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
TWENTY_SIX = [(i, j, k) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
END_SHARE, REACH, ALONG = 0.3, 8.0, 0.3  # fixed: share of an end, mm, cosine
VOXEL, GROUP = ["volume_id", "idx"], ["volume_id", "component_id"]
#: Slabs in a row whose faces are joined in one task, and groups of them one level up.
SLABS = 64


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]], nx: int, ny: int, nz: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, offset (di, dj, dk) and ``at``, the index of each neighbour inside the grid."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in offsets)))
    moved = voxels.withColumn("o", o).withColumn("x", F.col("i") + F.col("o.di")).withColumn("y", F.col("j") + F.col("o.dj")).withColumn("z", F.col("k") + F.col("o.dk"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("z") >= 0) & (F.col("x") < nx) & (F.col("y") < ny) & (F.col("z") < nz)
    return moved.filter(inside).select(*keep, "o", ((F.col("z") * ny + F.col("y")) * nx + F.col("x")).cast("long").alias("at"))


def adjacency(members: DataFrame, offsets: list[tuple[int, int, int]], nx: int, ny: int, nz: int, same: list[str] = []) -> DataFrame:
    """Edges (a, b) between neighbouring members (idx, k, j, i), equal in the ``same`` columns; each once."""
    half = [o for o in offsets if (o[2], o[1], o[0]) > (0, 0, 0)]
    to = members.select(F.col("idx").alias("at"), *same)
    return shifted(members, half, nx, ny, nz, ["idx", *same]).join(to, ["at", *same]).select(F.col("idx").alias("a"), F.col("at").alias("b"))


def _roots(t: pa.Table) -> pa.Table:
    """volume_id, node, root: the nodes of the edges a, b that reach a smaller one, with the smallest."""
    nodes, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    root = slabs.joined(len(nodes), at[: t.num_rows], at[t.num_rows :])
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"volume_id": pa.array([t["volume_id"][0].as_py()] * len(apart), pa.string()), "node": nodes[apart], "root": nodes[root[apart]]})


def face_roots(edges: DataFrame, n_slabs: int = SLABS) -> DataFrame:
    """volume_id, label, component: each label with the smaller one that it reaches over ``edges`` (volume_id, face, a, b), if any.

    Face f lies between slabs f - 1 and f, so that labels of a group of slabs are in no other group.
    """
    edges = materialize(edges, "edges")
    last = edges.agg(F.max("face")).first()[0] or 0
    levels = []
    while last:
        group = F.floor(F.col("face") / n_slabs)
        inner = edges.filter(F.col("face") % n_slabs != 0).withColumn("group", group)
        roots = materialize(inner.groupBy("volume_id", "group").applyInArrow(_roots, "volume_id string, node long, root long"), "roots")
        levels.append(roots)
        last //= n_slabs
        if last:
            up = edges.filter(F.col("face") % n_slabs == 0).withColumn("face", group)
            for side in ("a", "b"):
                to = roots.withColumnRenamed("node", side)
                up = up.join(to, ["volume_id", side], "left").withColumn(side, F.coalesce("root", side)).drop("root")
            edges = materialize(up.select("volume_id", "face", "a", "b").distinct(), "edges")
    top = edges.select("volume_id", F.col("a").alias("label"), F.col("b").alias("component")).limit(0) if not levels else levels.pop().toDF("volume_id", "label", "component")
    for below in reversed(levels):
        higher = top.select("volume_id", F.col("label").alias("root"), "component")
        reached = below.join(higher, ["volume_id", "root"], "left").select("volume_id", F.col("node").alias("label"), F.coalesce("component", "root").alias("component"))
        top = materialize(reached.unionByName(top), "roots")
    return top


def slab_labels(members: DataFrame, grid: DataFrame, offsets: list[tuple[int, int, int]], same: str | None = None, depth: int = slabs.DEPTH) -> DataFrame:
    """volume_id, idx, label of every member within its slab; ``side`` is 1 on a slab's first slice, 2 for what is seen of the next slab, ``face`` the slab that the voxel lies in."""
    half = [o for o in offsets if (o[2], o[1], o[0]) > (0, 0, 0)]

    def kernel(s: Slab) -> pa.Table:
        seen = slice(s.lo - s.base, s.top - s.base)
        member = s.present()[seen]
        t = s.table(member, **_labelled(s, member, half, s.dense(same, np.int32)[seen] if same else None, depth))
        return t.select(["volume_id", "idx", "label", "side", "face"])

    return slabs.over_slabs(members, grid, kernel, "volume_id string, idx long, label long, side byte, face int", fields=[same] if same else [], halo=1, depth=depth)


def _labelled(s: Slab, member: np.ndarray, offsets: list[tuple[int, int, int]], same: np.ndarray | None, depth: int) -> dict[str, np.ndarray]:
    """Label, side and face of the members of a slab's own slices and the next one."""
    side, face = np.zeros(member.shape, dtype=np.int8), np.full(member.shape, s.lo // depth, dtype=np.int32)
    side[0] = s.lo > 0
    side[s.hi - s.lo :], face[s.hi - s.lo :] = 2, s.lo // depth + 1
    return {"label": slabs.labels(member, offsets, same) + s.lo * s.ny * s.nx, "side": side, "face": face}


def face_edges(labelled: DataFrame) -> DataFrame:
    """Distinct pairs (volume_id, face, a, b) of labels that one voxel has on either side of a slab's face."""
    below = labelled.filter("side = 2").select(*VOXEL, "face", F.col("label").alias("a"))
    return below.join(labelled.filter("side = 1").select(*VOXEL, F.col("label").alias("b")), VOXEL).select("volume_id", "face", "a", "b").distinct()


def components(members: DataFrame, grid: DataFrame, offsets: list[tuple[int, int, int]], same: str | None = None, depth: int = slabs.DEPTH) -> DataFrame:
    """volume_id, idx, component (the smallest index reached) of ``members`` (volume_id, idx, k, j, i).

    Neighbours at ``offsets`` are joined if the integer column ``same`` is equal.
    """
    labelled = materialize(slab_labels(members, grid, offsets, same, depth), "labels")
    top = face_roots(face_edges(labelled))
    return labelled.filter("side < 2").join(top, ["volume_id", "label"], "left").select(*VOXEL, F.coalesce("component", "label").alias("component"))


def dark_wall(tissue: DataFrame, grid: DataFrame) -> DataFrame:
    """Voxels of the closed wall: dark ones, and those pinched by dark ones on both sides of an axis."""

    def kernel(s: Slab) -> pa.Table:
        dark = s.dense("dark", bool)
        return s.table(s.own(dark | slabs.pinched(dark)))

    coded = tissue.select("volume_id", "k", "j", "i", (F.col("tissue") == "dark").alias("dark"))
    return slabs.over_slabs(coded, grid, kernel, PLACE, fields=["dark"], halo=1).select(*VOXEL)


def mark_marrow(tissue: DataFrame, grid: DataFrame, least: int = 200) -> DataFrame:
    """``tissue`` with enclosed fat renamed marrow.

    What the outside reaches without crossing the wall are the open components that
    touch the border. Fat elsewhere, in pockets of at least ``least`` voxels, is marrow.
    One kernel finds wall, labels and border; fat, the voxels of faces and a row for each
    label at the border leave it.
    """
    half = [o for o in SIX if (o[2], o[1], o[0]) > (0, 0, 0)]

    def kernel(s: Slab) -> pa.Table:
        seen = slice(s.lo - s.base, s.hi - s.base + 1)
        code = s.dense("code", np.int8)
        dark, fat = code == 1, code[seen] == 2
        open_ = (s.present() & ~(dark | slabs.pinched(dark)))[seen]
        found = _labelled(s, open_, half, None, slabs.DEPTH)
        own = found["side"] < 2
        found["label"] = np.where(open_, found["label"], -1)  # the wall
        edge = np.zeros(open_.shape, dtype=bool)
        edge[:, [0, -1]] = edge[:, :, [0, -1]] = True
        edge[0] |= s.lo == 0
        edge[s.hi - s.lo - 1] |= s.hi == s.nz
        border = np.zeros(open_.shape, dtype=bool)
        first = np.unique(np.where(edge & open_ & own, found["label"], -1), return_index=True)
        border.flat[first[1][first[0] >= 0]] = True
        return s.table(fat & own | open_ & (found["side"] > 0) | border, **found, fat=fat & own, border=border)

    coded = tissue.select("volume_id", "k", "j", "i", F.when(F.col("tissue") == "dark", 1).when(F.col("tissue") == "fat", 2).otherwise(0).alias("code"))
    parts = materialize(slabs.over_slabs(coded, grid, kernel, f"{PLACE}, label long, side byte, face int, fat boolean, border boolean", fields=["code"], halo=2), "open")
    label, part = ["volume_id", "label"], F.coalesce("component", "label").alias("component")
    top = face_roots(face_edges(parts.filter("label >= 0")))
    outside = parts.filter("border").select(*label).join(top, label, "left").select("volume_id", part).distinct()
    inside = parts.filter("fat").join(top, label, "left").select(*VOXEL, "k", "j", "i", part).join(outside, ["volume_id", "component"], "left_anti")
    if least > 1:
        pockets = materialize(components(inside, grid, SIX), "pockets")
        big = pockets.groupBy("volume_id", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        inside = pockets.join(big, ["volume_id", "component"], "left_semi")
    marrow = inside.select(*VOXEL, F.lit(True).alias("marrow"))
    return tissue.join(marrow, VOXEL, "left").withColumn("tissue", F.when(F.col("marrow"), "marrow").otherwise(F.col("tissue"))).drop("marrow")


KINDS = ("tube", "sheet", "blob")


def shape_groups(shapes: DataFrame, grid: DataFrame, seed: float = 0.25) -> DataFrame:
    """volume_id, idx, k, j, i, kind, confidence, component, component_id of grouped dark voxels.

    Members share their kind with a neighbour of 26; a group needs one voxel as sure as
    ``seed``; ids follow the first such voxel, through all volumes in turn.
    """
    own = shapes.filter("kind <> 'none'").select(*VOXEL, "k", "j", "i", "kind", "confidence")
    coded = own.select(*VOXEL, "k", "j", "i", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("code"))
    parts = own.join(components(coded, grid, TWENTY_SIX, "code"), VOXEL)
    first = parts.filter(F.col("confidence") >= seed).groupBy("volume_id", "component").agg(F.min("idx").alias("first"))
    ids = numbered(first, ["volume_id", "first"], "component_id")
    return parts.join(ids.select("volume_id", "component", "component_id"), ["volume_id", "component"])


def numbered(rows: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of the distinct columns ``by``, from 0.

    Rows are dealt out by ranges of ``by``; a range starts where the ranges before it
    end, which is a sum over ranges, not over rows.
    """
    by = [by] if isinstance(by, str) else by
    ranged = materialize(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    return ranged.join(F.broadcast(before), "range").withColumn(name, F.col("before") + own).drop("range", "before")


def split_ends(groups: DataFrame, grid: DataFrame) -> DataFrame:
    """Voxels with their end of the long axis (0, 1, 2), and the group's axis and length."""
    sized = slabs.per_volume(groups, grid.select("volume_id", "sx", "sy", "sz"))
    p = sized.withColumns({f"p{a}": F.col(c) * F.col(f"s{a}") for a, c in zip("xyz", "ijk", strict=True)})
    centre = p.groupBy(*GROUP).agg(*(F.avg(c).alias("c" + c) for c in ("px", "py", "pz")))
    q = p.join(centre, GROUP)
    d = [F.col(c) - F.col("c" + c) for c in ("px", "py", "pz")]
    tip = q.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).groupBy(*GROUP).agg(F.min(F.struct((-F.col("d2")).alias("d2"), "idx", *(v.alias(n) for v, n in zip(d, ("ax", "ay", "az"), strict=True)))).alias("t"))
    size = F.sqrt(F.col("t.ax") * F.col("t.ax") + F.col("t.ay") * F.col("t.ay") + F.col("t.az") * F.col("t.az"))
    axis = tip.select(*GROUP, "t.ax", "t.ay", "t.az", F.when(size == 0, 1.0).otherwise(size).alias("size"))
    # one division after the product: voxels on the line between two ends fall where the exact values put them
    along = q.join(axis, GROUP).withColumn("t", (d[0] * F.col("ax") + d[1] * F.col("ay") + d[2] * F.col("az")) / F.col("size"))
    span = along.groupBy(*GROUP).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    edge = (F.col("high") - F.col("low")) * END_SHARE
    bucket = F.when(F.col("t") <= F.col("low") + edge, 0).when(F.col("t") >= F.col("high") - edge, 2).otherwise(1)
    return along.join(span, GROUP).select(*GROUP, "idx", "k", "j", "i", "kind", "confidence", *((F.col(a) / F.col("size")).alias(a) for a in ("ax", "ay", "az")), (F.col("high") - F.col("low")).alias("length_mm"), bucket.alias("bucket"))


#: What a ray can meet; other tissues end it too.
MET = ("marrow", "muscle", "fat")


def rays_met(tissue: DataFrame, grid: DataFrame, reach: float = REACH, names: tuple[str, ...] = MET) -> DataFrame:
    """volume_id, idx and r0 to r5 of every dark voxel: what the ray in each of the six directions meets first.

    A number is a place in ``names``, ``len(names)`` another tissue, -1 nothing within ``reach``.
    """

    def kernel(s: Slab) -> pa.Table:
        code = s.dense("code", np.int8, -1)
        dark = code == len(names) + 1
        limits = [max(1, int(reach // s.spacing[next(a for a, x in enumerate(o) if x)])) for o in SIX]
        met = {f"r{n}": s.own(slabs.first_met(dark, code, o, limit)) for n, (o, limit) in enumerate(zip(SIX, limits, strict=True))}
        return s.table(s.own(dark), **met).drop_columns(["k", "j", "i"])

    place = F.array_position(F.array(*map(F.lit, names)), F.col("tissue")).cast("int")
    code = F.when(F.col("tissue") == "dark", len(names) + 1).when(place > 0, place - 1).otherwise(len(names))
    coded = tissue.select("volume_id", "k", "j", "i", code.alias("code"))
    out = "volume_id string, idx long" + "".join(f", r{n} byte" for n in range(6))
    return slabs.over_slabs(coded, grid, kernel, out, fields=["code"], halo=F.greatest(F.lit(1), F.floor(reach / F.col("sz"))))


def contacts(ends: DataFrame, tissue: DataFrame, grid: DataFrame, reach: float = REACH) -> DataFrame:
    """volume_id, component_id and shares of marrow, muscle and fat that rays from it meet, whole and by end.

    Six rays a voxel (at an end only those along the axis), to the first voxel that is
    not dark within reach.
    """
    rays = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk"), F.col(f"r{n}").alias("met")) for n, (a, b, c) in enumerate(SIX)))
    out = F.when(F.col("bucket") == 2, 1.0).when(F.col("bucket") == 0, -1.0)
    r = ends.select(*GROUP, "idx", "bucket", "ax", "ay", "az").join(rays_met(tissue, grid, reach), VOXEL).withColumn("r", F.explode(rays)).filter("r.met >= 0")
    r = r.filter((F.col("bucket") == 1) | ((F.col("r.di") * F.col("ax") + F.col("r.dj") * F.col("ay") + F.col("r.dk") * F.col("az")) * out >= ALONG))
    share = lambda name, where: F.coalesce(F.try_divide(F.count_if((F.col("r.met") == MET.index(name)) & where), F.count_if(where)), F.lit(0.0))
    cols = [share(n, F.lit(True)).alias(n) for n in MET] + [share(n, F.col("bucket") == b).alias(f"{n}{b}") for b in (0, 2) for n in ("marrow", "muscle")]
    return r.groupBy(*GROUP).agg(*cols)


def agreement(groups: DataFrame, dark: DataFrame) -> DataFrame:
    """volume_id, component_id, agreement: of the dark voxels next in storage order, the share of the same kind (``dark``: volume_id, idx, kind)."""
    near = groups.select(*GROUP, F.col("kind").alias("own"), F.explode(F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("idx"))
    return near.join(dark.select(*VOXEL, "kind"), VOXEL).groupBy(*GROUP).agg((F.count_if(F.col("kind") == F.col("own")) / F.count("*")).alias("agreement"))


def evidence(groups: DataFrame, ends: DataFrame, dark: DataFrame, touched: DataFrame) -> DataFrame:
    """One row a component with all that the naming rule reads."""
    base = ends.groupBy(*GROUP).agg(F.first("kind").alias("kind"), F.count("*").alias("voxels"), F.avg("confidence").alias("shape_confidence"), F.max("length_mm").alias("length_mm"))
    out = base.join(agreement(groups, dark), GROUP, "left").join(touched, GROUP, "left")
    zero = ["agreement", "marrow", "muscle", "fat", "marrow0", "muscle0", "marrow2", "muscle2"]
    return out.fillna(0.0, zero)


def evidence_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("kind", "voxels", "agreement", "shape_confidence", "marrow", "muscle", "fat", "length_mm", "marrow0", "muscle0", "marrow2", "muscle2")}
