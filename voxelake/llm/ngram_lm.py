"""Stupid-backoff scores over n-gram count tables partitioned by hash.

Blocks of documents explode their texts into n-grams of all orders (56-bit
hashes) and send each distinct one with its count in the block to the table
partition its hash falls in; the partitions add up the counts of all blocks and
answer each block, in the order asked; the block joins its n-grams with the answers,
which gives every
document the corpus count of each of its n-grams, and a document's scores are
summed. Rows that travel hold sorted hash arrays, one row for each block and
partition, so a frequent n-gram costs one entry a block, whatever its count.

A document is scored by the other documents: its own counts are taken off first,
else nothing of a corpus would ever be unseen in it. With c the counts left, for
word i with h words before it (at most order-1): the longest n-gram that c knows
decides, c(n-gram)/c(its context), times ``alpha`` for each order backed off; a word
that is unknown counts as half an occurrence.

Defined results: null, empty and blank texts have no words, score 0 and no mean;
repeated rows score each other; null ids are scored and stay null; very long texts
are one document whole; a corpus of one document knows nothing, each word is then
an unknown one among one; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The n-gram of no words; its count is the corpus's words.
EMPTY = np.uint64(0x51F42D4C957F2D)
#: Bits of an n-gram's hash. What travels is mostly hashes: at 56 bits, one n-gram in ten million of a
#: corpus of ten thousand million distinct ones shares its count with another.
BITS = 56

#: Which bytes are white space between words.
_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
#: Texts are read in slices of about this many bytes.
SLICE = 2 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' white-space words, A-Z lower-cased, and how many each text has."""
    parts = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b" ".join(parts).lower() + b" ", dtype=np.uint8)
    gap = _SPACE[flat]
    inside = np.flatnonzero(~gap)
    if not len(inside):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])  # of the visible bytes, those that begin a word
    sizes = np.diff(np.r_[first, len(inside)])
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), _STEP))  # a polynomial of the bytes, mixed with the length
        sums = np.add.reduceat((flat[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return mix64(sums ^ sizes.astype(np.uint64)), np.diff(np.searchsorted(inside[first], starts))


def places(sizes: np.ndarray) -> np.ndarray:
    """The place of each word in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grams(h: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to ``order`` the hash of the n-gram that ends at each word from the n-th on."""
    out = [mix64(h ^ _STEP)]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            out.append(mix64(out[-1][:-1] * _STEP + h[n - 1 :] + np.uint64(n)) if len(h) >= n else np.empty(0, np.uint64))
    return [x >> np.uint64(64 - BITS) for x in out]


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the high planes of small numbers take next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    if len(found) == 1:
        return found[0]
    u, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate([f[1] for f in found]), minlength=len(u)).astype(np.int64)


def sliced(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def block_counts(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block of texts, with their counts; EMPTY counts the words."""
    found, n_words = [], 0
    for part in sliced(texts):
        h, sizes = word_hashes(part)
        place = places(sizes)
        n_words += len(h)
        found.append(np.unique(np.concatenate([g[place[n:] >= n] for n, g in enumerate(grams(h, order))]), return_counts=True))
        while len(found) > 1 and len(found[-2][0]) < 2 * len(found[-1][0]):
            found[-2:] = [merge(found[-2:])]
    return merge([*found, (np.array([EMPTY]), np.array([n_words]))])


def left_over(g: np.ndarray, text: np.ndarray, known: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often the corpus holds each n-gram outside its own text."""
    at = np.argsort(g, kind="stable")  # texts come in order, so equal n-grams of one text lie together
    g, text = g[at], text[at]
    new = np.r_[True, g[1:] != g[:-1]][: len(g)]
    run = np.cumsum(new | np.r_[True, text[1:] != text[:-1]][: len(g)]) - 1
    out = np.empty(len(g), dtype=np.int64)
    out[at] = total[np.searchsorted(known, g[new])][np.cumsum(new) - 1] - np.bincount(run, minlength=1)[run]
    return out


def log_scores(texts: list[str | None], order: int, alpha: float, known: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and sum of their log scores of each text, given the counts of all n-grams."""
    h, sizes = word_hashes(texts)
    if not len(h):
        return sizes, np.zeros(len(texts))
    place, text = places(sizes), np.repeat(np.arange(len(texts)), sizes)
    rest = np.repeat(total[np.searchsorted(known, EMPTY)] - sizes, sizes)  # of the n-gram before the word, none at first
    out = np.log(0.5 / np.maximum(1, rest))
    level = np.zeros(len(h), dtype=np.int64)
    for n, g in enumerate(grams(h, order)):
        c = np.zeros(len(h), dtype=np.int64)
        ends = n + np.flatnonzero(place[n:] >= n)
        c[ends] = left_over(g[ends - n], text[ends], known, total)
        seen = np.flatnonzero(c > 0)
        out[seen] = np.log(c[seen] / rest[seen])
        level[seen] = n
        rest = np.r_[0, c[:-1]]
    out += np.log(alpha) * (np.minimum(place, order - 1) - level)  # orders there is history for, less the one that decided
    return sizes, np.bincount(text, weights=out, minlength=len(texts))


def scores(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, block_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of each document.

    The corpus's bytes, read first, set how many blocks there are, about ``block_bytes``
    of text each; four table partitions for each block keep those as small. Rows that
    travel are blocks times partitions: a corpus of many TB wants blocks as large as its
    executors can hold.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // block_bytes))
    parts = 4 * n
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def request(table: pa.Table) -> pa.Table:
        g, c = block_counts(table["text"].to_pylist(), order)
        at = np.searchsorted(g, (np.arange(1, parts, dtype=np.float64) * (2.0**BITS / parts)).astype(np.uint64))
        out = [(p, pack_sorted(x), pack(y.astype(np.int32))) for p, (x, y) in enumerate(zip(np.split(g, at), np.split(c, at), strict=True)) if len(x)]
        block = table["block"][0].as_py()
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "grams": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x.as_py()) for x in table["grams"]]
        u, total = merge([*zip(asked, (unpack(x.as_py(), np.int32).astype(np.int64) for x in table["counts"]), strict=True), (np.empty(0, np.uint64), np.empty(0, np.int64))])
        told = [pack(total[np.searchsorted(u, g)]) for g in asked]
        return pa.table({"block": table["block"], "part": table["part"], "totals": pa.array(told, pa.binary())})

    def judge(texts: pa.Table, told: pa.Table) -> pa.Table:
        own = texts["text"].to_pylist()
        known, _ = block_counts(own, order)
        total = np.concatenate([unpack(told["totals"][i].as_py(), np.int64) for i in np.argsort(told["part"].to_numpy(), kind="stable").tolist()])
        n_words, sums = map(np.concatenate, zip(*(log_scores(part, order, alpha, known, total) for part in sliced(own)), strict=True))
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    asked = rows.groupBy("block").applyInArrow(request, "part int, block int, grams binary, counts binary")
    told = asked.groupBy("part").applyInArrow(answer, "block int, part int, totals binary")
    out = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


ORACLE = r"""
WITH w AS (SELECT rowid AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
t AS (SELECT d, i, ws[i] AS w1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3,
      CASE WHEN i > 1 THEN ws[i - 1] END AS p1, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] END AS p2
      FROM (SELECT d, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
o AS (SELECT d, g, count(*) AS n FROM (SELECT d, w1 AS g FROM t UNION ALL SELECT d, w2 FROM t UNION ALL SELECT d, w3 FROM t) WHERE g IS NOT NULL GROUP BY d, g),
c AS (SELECT d, g, CAST(sum(n) OVER (PARTITION BY g) - n AS DOUBLE) AS r FROM o),
z AS (SELECT d, len(ws) AS n, CAST((SELECT sum(len(ws)) FROM w) - len(ws) AS DOUBLE) AS r FROM w),
s AS (SELECT t.d, CASE WHEN c3.r > 0 THEN ln(c3.r / q2.r)
        WHEN c2.r > 0 THEN ln(c2.r / q1.r) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
        ELSE ln(CASE WHEN c1.r > 0 THEN c1.r / z.r ELSE 0.5 / greatest(z.r, 1) END) + least(i - 1, 2) * ln(0.4) END AS x
      FROM t JOIN z USING (d) JOIN c c1 ON c1.d = t.d AND c1.g = w1 LEFT JOIN c c2 ON c2.d = t.d AND c2.g = w2 LEFT JOIN c c3 ON c3.d = t.d AND c3.g = w3
      LEFT JOIN c q1 ON q1.d = t.d AND q1.g = p1 LEFT JOIN c q2 ON q2.d = t.d AND q2.g = p2)
SELECT doc_id, CAST(z.n AS BIGINT) AS n_words, round(coalesce(x, 0), 4) AS log_score, round(x / z.n, 6) AS mean_log_score
FROM w JOIN z USING (d) LEFT JOIN (SELECT d, sum(x) AS x FROM s GROUP BY d) USING (d)
"""
