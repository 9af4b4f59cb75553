"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over XXH64 hashes. To find all pairs within
radius r, bit position i gets a vector of r+1 bits; for each non-zero vector v the
mask keeps the positions whose vector has an odd inner product with v. The
vectors of any r positions have a common orthogonal v, so the mask of that v
keeps none of the differing positions: every pair within the radius agrees on some
masked key, with 2^(r+1)-1 tables and no pair lost.

Only distinct fingerprints enter the tables (a group of exact copies is one row,
pre-aggregated before any shuffle by key). Tasks read keys in sorted order, hold
one bucket at a time, and emit a spanning forest of each bucket instead of its
pairs; large buckets are dealt out again by further masks. Components are found by
distributed star rounds.

Defined results: null, empty and word-less texts have fingerprint zero and link
like any other; fewer words than a shingle give one shingle of all words; ties at
exactly half give bit 0; repeated rows share their class; a null doc_id is kept
and is nobody's smallest id; very long texts are hashed in slices, whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm import prefix
from voxelake.llm.common import free_name, in_turn, materialize, mix64, slices
from voxelake.llm.components import components

SEED = 42
#: Buckets up to this size are compared directly, larger ones are cut again, so many times.
DIRECT, CUTS = 2048, 3
EDGES = "a long, b long"


def words_of(text: str | None) -> list[bytes]:
    """White-space words of the text with A-Z lower-cased (bytes.lower and split know ASCII only)."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; a shorter text is one shingle of all its words."""
    if k == 1 or len(words) <= k:
        return words if k == 1 else [b" ".join(words)] * bool(words)
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in parts), dtype=np.uint64, count=len(parts))


def majority(h: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The 64-bit word whose bits are set in over half (by weight) of ``h``."""
    if not len(h):
        return 0
    votes, total = np.zeros(64), 0.0
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            votes += bits.sum(axis=0, dtype=np.int32)
            total += len(part)
        else:
            votes += weights[i : i + (1 << 15)] @ bits
            total += float(weights[i : i + (1 << 15)].sum())
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [signed(majority(hashes(shingles(words_of(t), shingle)))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=16)
def covering_masks(radius: int, turn: int = 0) -> tuple[int, ...]:
    """The 2^(radius+1)-1 masks of 64 bits; ``turn`` selects an independent family.

    Position vectors run through all non-zero vectors in a fixed stride, the stride
    that leaves the poorest mask the most bits.
    """
    n = (1 << (radius + 1)) - 1

    def family(stride: int) -> list[int]:
        phi = [1 + (stride * (i + 1) + turn * 29) % n for i in range(64)]
        return [sum(((phi[i] & v).bit_count() & 1) << i for i in range(64)) for v in range(1, n + 1)]

    strides = [s for s in range(1, n + 1) if np.gcd(s, n) == 1][: 64 + turn] or [1]
    best = sorted(strides, key=lambda s: (-min(m.bit_count() for m in family(s)), s))
    return tuple(family(best[turn % len(best)]))


def _close(fp: np.ndarray, sketch: np.ndarray | None, i: np.ndarray, j: np.ndarray, radius: int, agree: int) -> np.ndarray:
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    if sketch is not None and agree:
        i, j = np.broadcast_arrays(i, j)
        x = (sketch[i[ok]] ^ sketch[j[ok]]).reshape(-1, 1).view(np.uint8)
        ok[ok] = (x == 0).sum(axis=1) >= agree
    return ok


def forest(fp: np.ndarray, node: np.ndarray, sketch: np.ndarray | None, radius: int, agree: int) -> list[np.ndarray]:
    """Edges (node, node) that connect what links within one bucket, at most one per row; pairs are compared in strips."""
    m = len(fp)
    label = np.arange(m)
    left, right = [], []
    for i in range(0, m, 512):
        rows = np.arange(i, min(m, i + 512))[:, None]
        a, b = np.nonzero(_close(fp, sketch, rows, np.arange(m)[None, :], radius, agree))
        keep = a + i < b
        left.append(a[keep] + i)
        right.append(b[keep])
    left, right = np.concatenate(left), np.concatenate(right)
    while True:  # smallest label of the neighbours, then of the label's label
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(m))
    return [np.stack([node[label[linked]], node[linked]], axis=1)] if len(linked) else []


def bucket_edges(tables: DataFrame, radius: int, agree: int, most: int | None) -> DataFrame:
    """Edges (a, b) between nodes whose rows (of, t, key, fp, node, sketch), sorted by (of, t, key), share a bucket and are close.

    Members of buckets over ``most`` come back as rows (node, fp, sketch, of), a bucket's
    number in ``of``, to be cut again.
    """
    names = ["a", "b", "fp", "sketch", "of"]

    def edges_of(of: np.ndarray, t: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (of[1:] != of[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        own = sketch if agree else None
        out = []
        small = starts[sizes == 2]
        ok = _close(fp, own, small, small + 1, radius, agree)
        out.append(np.stack([node[small[ok]], node[small[ok] + 1]], axis=1))
        large = np.repeat((sizes > most) if most else np.zeros(len(sizes), bool), sizes)
        fit = (sizes > 2) & ~((sizes > most) if most else np.zeros(len(sizes), bool))
        for s, n in zip(starts[fit].tolist(), sizes[fit].tolist(), strict=True):
            part = slice(s, s + n)
            out += forest(fp[part], node[part], None if own is None else own[part], radius, agree)
        return np.unique(np.sort(np.concatenate(out), axis=1), axis=0), large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, t, key, fp, node, sketch in prefix.whole_groups(batches, 3):
            e, large = edges_of(of, t, key, fp.view(np.uint64), node, sketch.view(np.uint64))
            none = pa.nulls(len(e), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), none, none, none], names)
            if large.any():
                number = mix64(of[large].view(np.uint64) + mix64(key[large].view(np.uint64) + t[large].astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(fp[large]), pa.array(sketch[large]), pa.array(number)], names)

    return tables.mapInArrow(run, "a long, b long, fp long, sketch long, of long")


def links(points: DataFrame, *, radius: int, agree: int = 0) -> DataFrame:
    """Distinct edges (a, b) that connect all ``points`` (node, fp, sketch) within ``radius`` bits.

    With ``agree``, linked rows must also agree on that many of the 8 sketch bytes.
    Buckets over ``DIRECT`` are dealt out again by further masks, up to ``CUTS`` times.
    """
    rows, out, cut = points.withColumn("of", F.lit(0).cast("long")), None, 0
    while True:
        masks = covering_masks(radius, cut)
        keep = F.array(*(F.lit(signed(m)) for m in masks))
        key = F.col("fp").bitwiseAND(F.get(keep, F.col("t")))  # made again after the shuffle
        dealt = rows.select("of", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"), "fp", "node", "sketch")
        dealt = dealt.repartition("of", "t", key).sortWithinPartitions("of", "t", key, "node")
        found = materialize(bucket_edges(dealt.select("of", "t", key.alias("key"), "fp", "node", "sketch"), radius, agree, DIRECT if cut < CUTS else None), "bucketed")
        edges = found.filter("b is not null").select("a", "b")
        out = edges if out is None else out.union(edges)
        rows = found.filter("b is null").select(F.col("a").alias("node"), "fp", "sketch", "of")
        if cut == CUTS or not rows.limit(1).count():
            return out.distinct()
        cut += 1


def classes(docs: DataFrame, *, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: documents whose fingerprints link within ``radius``."""
    fps = materialize(fingerprints(docs, shingle=shingle, doc_id=doc_id, text=text), "fingerprints")
    # a fingerprint held by null ids only has no smallest id: it is nobody's partner
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = links(nodes.filter("node is not null").select("node", "fp", F.lit(0).cast("long").alias("sketch")), radius=radius)
    comp = components(edges)
    of_fp = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates by word shingles: covering LSH and a prefix-filtered join propose, exact Jaccard decides ---


def bag_fingerprint(words: list[bytes]) -> int:
    """SimHash of the bag of words, each weighted by log(1 + its count)."""
    n: dict[bytes, int] = {}
    for w in words:
        n[w] = n.get(w, 0) + 1
    return majority(hashes(list(n)), np.log1p(np.fromiter(n.values(), dtype=np.float64, count=len(n))))


def similarity(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are equal."""
    x, y = (set(shingles(words_of(t), shingle)) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


#: Distinct texts in which common shingles are looked for, and the number of them that makes one common.
SAMPLE, OFTEN = 4096, 3


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Rows (hash, count) of shingles that several texts of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = [np.unique(hashes(shingles(words_of(t), shingle))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["h"])

    every = max(1, rows.count() // SAMPLE)
    texts = rows.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    found = texts.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    return np.array(found.orderBy(F.desc("count"), "h").limit(prefix.COMMON).collect(), dtype=np.int64).reshape(-1, 2)


def classes_of_texts(docs: DataFrame, *, shingle: int, threshold: float, radius: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, raw (digest of the text), class of each row of ``docs``, written: rows of one class are near-duplicates.

    Texts are known by a digest of their words, never by an id, and numbered by the
    first row that holds them. Texts equal in words are one class before anything else.
    Covering LSH on bag-of-words fingerprints (within ``radius`` bits) proposes a star for
    each bucket, which finds classes of light copies cheaply but not every link: two
    members that miss its hub may be close. A prefix-filtered join on the shingles then
    proposes every pair of different classes that can reach the threshold. Each proposal
    is verified exactly on the texts.
    """
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled.alias("text")).withColumn("raw", F.unhex(F.md5("text")))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_turn("near duplicates", dict)  # nothing of its own to forget
        order = prefix.Order(common.value)
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                h = np.unique(hashes(shingles(words, shingle)))
                out.append((xxhash.xxh128_digest(b" ".join(words)), signed(bag_fingerprint(words)), *order.prefix(h, threshold), prefix.bitmap(h)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "raw", "same", "fp", "keys", "n", "bits"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta"):
            ok = [similarity(x, y, shingle) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    made = rows.mapInArrow(points, "doc_id long, raw binary, same binary, fp long, keys array<long>, n int, bits binary")
    seen = materialize(made.withColumn("row", F.monotonically_increasing_id()), "points")
    texts = materialize(seen.groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("held")), "nodes")
    copies = sent(materialize(seen.select("row", "same").join(texts.filter("held > 1"), "same").filter("row <> node").select("row"), "copies"))
    own = seen.join(copies, "row", "left_anti").withColumnRenamed("row", "node")  # one row for each text
    edges = materialize(links(own.select("node", "fp", F.lit(0).cast("long").alias("sketch")), radius=radius), "proposed")

    def texts_of(some: DataFrame) -> DataFrame:
        nodes = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
        wanted = sent(materialize(own.select("node", "raw").join(nodes, "node"), "wanted"))
        return materialize(rows.join(wanted, "raw").groupBy("node").agg(F.first("text").alias("text")), "texts")

    def verified(some: DataFrame, of: DataFrame) -> DataFrame:
        left, right = (of.select(F.col("node").alias(c), F.col("text").alias("t" + c)) for c in "ab")
        return some.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(verify, EDGES)

    # All of these are verified at once: a text has no more proposals than there are masks.
    new = materialize(verified(edges, texts_of(edges)), "links")
    comp = components(new)

    # The rest, complete: what shares a prefix shingle and is not of one class yet, hubs first.
    classed = lambda some: some.join(sent(comp), "node", "left").withColumn("class", F.coalesce("component", "node"))
    listed = classed(own.select("node", "keys", "n")).select("node", "class", "n", F.posexplode("keys").alias("at", "key"))
    found = prefix.buckets(listed.select("key", "node", "class", "n", "at"), threshold)
    bits = own.select("node", "n", "bits")
    members = materialize(found.filter(F.col("part") > prefix.PAIR).join(bits.drop("n"), "node"), "members")
    tested, first = None, 0
    for most in (1, 16, None):
        if most == 1:  # the hubs of buckets that lie within a task are paired already
            ready = found.filter(F.col("part") == prefix.PAIR).select(F.col("node").alias("a"), F.col("class").alias("b")).distinct()
            some = prefix.alike(ready, bits, threshold).union(prefix.pairs(members.filter("part >= 0"), threshold, 0, 1)).distinct()
        else:
            some = prefix.pairs(classed(members.drop("class")), threshold, first, most)
        some = some if tested is None else some.join(tested, ["a", "b"], "left_anti")
        some = materialize(some, "tested")
        tested = some if tested is None else tested.union(some)
        first += most or 0
        if some.limit(1).count():
            new = materialize(verified(some, texts_of(some)), "links")
            if new.limit(1).count():  # classes so far are stars, to which the new links are added
                comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
    of_text = classed(texts).select("same", "class")
    return materialize(seen.select("doc_id", "raw", "same").join(of_text, "same").select("doc_id", "raw", "class"), "classes")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id: groups of rows linked by Jaccard >= ``threshold`` over word shingles.

    A class is called by its smallest doc_id, and by null if it has none. Rows that
    repeat a doc_id are of one class only if their texts are.
    """
    found = classes_of_texts(docs, shingle=shingle, threshold=threshold, radius=radius, doc_id=doc_id, text=text)
    return found.join(found.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class; all columns stay.

    The row of the smallest doc_id stays, or one without a doc_id if the class has none;
    of several rows with that doc_id the one whose text has the smallest digest, and any
    one of those that repeat both.
    """
    found = classes_of_texts(docs, shingle=shingle, threshold=threshold, radius=radius, doc_id=doc_id, text=text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw"))
    best = found.groupBy("class").agg(first.alias("best"), F.count("*").alias("held")).filter("held > 1")
    judged = found.join(best, "class").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw") == F.col("best.raw")))
    judged = materialize(judged.groupBy("doc_id", "raw", "stays").count(), "judged")
    raw = free_name(docs, "raw")
    rows = docs.withColumn(raw, F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))

    def within(some: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = sent(ids.select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")))
        return some.join(ids, some[doc_id].cast("long").eqNullSafe(ids["_id"]) & (some[raw] == ids["_raw"]), how)

    kept = within(rows, judged.filter("not stays"), "left_anti")
    repeated = judged.filter("stays and count > 1")  # only such rows are dealt out by their id and text
    once = within(kept, repeated, "left_semi").dropDuplicates([doc_id, raw])
    return within(kept, repeated, "left_anti").unionByName(once).select(*docs.columns)


#: Tables of ids up to this many rows (32 MB) are sent to every task, larger ones are joined by shuffle.
SENT = 1 << 20


def sent(ids: DataFrame) -> DataFrame:
    """``ids``, to be sent to every task if they are counted few enough."""
    return F.broadcast(ids) if ids.count() <= SENT else ids
