"""Runs of periodic words by an enhanced suffix array (branching-tandem test).

A run is a stretch of words with smallest period q, at least ``least`` words and
``times`` periods long, that no neighbouring word extends with that period. The
suffix array of all texts of a slice is sorted by doubled prefixes; a word counts as
another one in every text, so that no prefix reaches from one text into the next.
With its inverse (ISA) and the common prefixes of neighbours (LCP) it takes the
place of a tree: an LCP interval is known by the next smaller values on either side
and its children by the places of its depth. In each interval the suffixes of all
children but the largest are tested: where i and i + depth lie in the interval and
the words after them differ, a square ends there that cannot be rotated to the
right. The two more periods that a run must have lie in the same interval. What is
left is rotated to the left as far as words agree, and squares with the same ends
are one run, whose period is their smallest.

Defined results: null, empty and blank texts have no words and no runs; every row is
judged by its own text, whatever its other columns hold, so that repeated rows get
equal results; texts of any length are taken whole, in memory of a few hundred bytes
a word of the longest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import free_name, slices

#: What parts words, as a Java pattern; the same that bytes.split() takes.
WHITE = r"[\x20\x09-\x0D]+"
REPEATS = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class SuffixArray:
    """Suffix array, its inverse and LCP of several texts at once; ``ends`` is the end of each word's text."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.sa = np.argsort(symbols, kind="stable")
        sorted_ = symbols[self.sa]
        head = np.ones(n + 1, dtype=bool)
        head[1:n] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, dtype=np.int32)
        rank[self.sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
        levels, split = [rank.copy()], np.full(n + 1, -1, dtype=np.int8)
        active = np.flatnonzero(~(head[:n] & head[1:]))
        while len(active):
            step, at = 1 << (len(levels) - 1), self.sa[active]
            after = at + step
            inside = after < ends[at]
            key = rank[at].astype(np.int64) * (n + 1)
            key[inside] += rank[after[inside]] + 1
            order = np.argsort(key, kind="stable")
            self.sa[active], key = at[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            split[active[new & ~head[active]]] = len(levels) - 1
            head[active[new]] = True
            rank[self.sa[active]] = active[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            levels.append(rank.copy())
            active = active[~(head[active] & head[active + 1])]
        self.isa = rank
        self.lcp = np.zeros(n + 1, dtype=np.int64)
        for level in range(len(levels) - 2, -1, -1):
            at = np.flatnonzero(split >= level)
            a, b = (self.sa[at - d] + self.lcp[at] for d in (1, 0))
            same = (a < ends[self.sa[at - 1]]) & (b < ends[self.sa[at]])
            same[same] = levels[level][a[same]] == levels[level][b[same]]
            self.lcp[at[same]] += 1 << level


def smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For the places ``at``, the next place in the direction of ``step`` whose value is smaller; pointers jump."""
    to, left = np.arange(len(lcp)) + step, at
    while len(left):
        left = left[lcp[to[left]] >= lcp[left]]
        to[left] = to[to[left]]
    return to[at]


def small_children(s: SuffixArray) -> tuple[np.ndarray, ...]:
    """Depth, first and last place of the interval, and suffix, for the suffixes of all children but each interval's largest."""
    at = np.flatnonzero(s.lcp > 0)
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    left, right, depth = smaller(s.lcp, at, -1), smaller(s.lcp, at, 1), s.lcp[at]
    order = np.argsort(left * (depth.max() + 1) + depth, kind="stable")
    at, left, right, depth = at[order], left[order], right[order], depth[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    last = np.append(first[1:], True)
    begin = np.concatenate([np.where(first, left, np.append(0, at[:-1])), at[last]])
    end = np.concatenate([at, right[last]])
    owner = np.concatenate([np.cumsum(first) - 1, np.arange(first.sum())])
    largest = np.zeros(first.sum(), dtype=np.int64)
    np.maximum.at(largest, owner, end - begin)
    is_largest = end - begin == largest[owner]
    skipped = np.unique(owner[is_largest], return_index=True)[1]
    keep = np.ones(len(owner), dtype=bool)
    keep[np.flatnonzero(is_largest)[skipped]] = False
    begin, size, owner = begin[keep], (end - begin)[keep], owner[keep]
    child = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + begin[child]
    whose = np.flatnonzero(first)[owner[child]]
    return depth[whose], left[whose], right[whose] - 1, s.sa[place]


def rotate(symbols: np.ndarray, i: int, period: int, begin: int) -> int:
    """How far the words before ``i`` agree with those a period later, not beyond ``begin``; looked at in doubled stretches."""
    stretch = 16
    while i > begin:
        low = max(begin, i - stretch)
        differ = np.flatnonzero(symbols[low:i] != symbols[low + period : i + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        i, stretch = low, stretch * 2
    return i


def find_runs(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> dict[tuple[int, int], int]:
    """(first word, end) -> smallest period of every run; ``begins`` and ``ends`` are those of each word's text.

    Words of different texts must be different symbols.
    """
    s = SuffixArray(symbols, ends)
    depth, low, high, i = small_children(s)

    def within(at: np.ndarray) -> np.ndarray:
        ok = (at >= begins[i]) & (at < ends[i])
        place = s.isa[np.where(ok, at, 0)]
        return ok & (low <= place) & (place <= high)

    squares: list[tuple[int, int, int]] = []
    for partner, square in ((i + depth, i), (i - depth, i - depth)):
        hit = np.flatnonzero(within(partner))
        a, d, lo, hi = square[hit], depth[hit], low[hit], high[hit]
        after = a + 2 * d
        open_ = after < ends[a]
        branching = ~open_
        branching[open_] = symbols[after[open_]] != symbols[(a + d)[open_]]
        for back in range(1, times - 1):  # the periods before the square lie in the interval too
            before = a - back * d
            ok = branching & (before >= begins[a])
            place = s.isa[np.where(ok, before, 0)]
            branching = ok & (lo <= place) & (place <= hi)
        squares += zip(after[branching].tolist(), d[branching].tolist(), a[branching].tolist(), strict=True)
    found: dict[tuple[int, int], int] = {}
    last, longest = -1, 0
    for end, period, at in sorted(squares):  # by ends, then periods: the smallest comes first
        if end != last:
            last, longest = end, 0
        if longest < 2 * period:  # else the square lies in a run whose period divides its own
            begin = rotate(symbols, at, period, int(begins[at]))
            longest = end - begin
            if longest >= least:
                found[begin, end] = min(period, found.get((begin, end), period))
    return found


def taken_apart(texts: list[bytes | None], least: int, times: int) -> list[tuple[int, list[dict[str, int]], bytes]]:
    """Number of words, runs by start and period, and the text without repeated periods, of each text."""
    words = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in words])
    n, ends = int(sizes.sum()), np.cumsum(sizes)
    of: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((x for w in words for x in map(of.__getitem__, w)), np.int64, n)
    text = np.repeat(np.arange(len(words)), sizes)
    runs: list[list[dict[str, int]]] = [[] for _ in words]
    if n:
        found = find_runs(text * len(of) + ids, (ends - sizes)[text], ends[text], least, times)
        for (a, b), q in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
            runs[text[a]].append({"start": a - int(ends[text[a]] - sizes[text[a]]), "length": b - a, "period": q})
    out = []
    for w, own in zip(words, runs, strict=True):
        m = len(w)
        if own:
            repeated = np.zeros(m, dtype=bool)
            for r in own:
                repeated[r["start"] + r["period"] : r["start"] + r["length"]] = True
            w = [w[k] for k in np.flatnonzero(~repeated).tolist()]
        out.append((m, own, b" ".join(w)))
    return out


def find_repeats(rows: DataFrame, *, text: str = "text", name: str = "repeats", least: int = 6, times: int = 4) -> DataFrame:
    """``rows`` with a struct ``name`` (n_words, runs, collapsed) of each row's text.

    ``collapsed`` is the words joined by one space, without those that a run holds
    after its first period. ``name`` must not be one of the columns (see ``free_name``).
    """
    kind = pa.struct({"n_words": pa.int64(), "runs": pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})), "collapsed": pa.binary()})
    shown = pa.struct({**{f.name: f.type for f in kind}, "collapsed": pa.string()})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            out = pa.array([dict(zip(("n_words", "runs", "collapsed"), r, strict=True)) for r in taken_apart(texts, least, times)], kind)
            fields = [pc.struct_field(out, [0]), pc.struct_field(out, [1]), pc.cast(pc.struct_field(out, [2]), pa.string(), safe=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(fields, fields=list(shown))], names=[*b.schema.names, name])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` {REPEATS}"])
    return rows.mapInArrow(judge, schema)


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document (by crc32 of its id) as repeated words, by the rule that the query fixes.

    Rows without an id or without words keep their text.
    """
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    h = F.crc32(doc_id.cast("string"))

    def periodic(t: Column) -> Column:  # what is not bound here would be computed anew for every word
        w, n = t["w"], F.size(t["w"]).cast("long")
        a = t["g"] % n
        p = 1 + F.floor((n - a) / (3 + t["g"] % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    bound = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), periodic)[0]
    return F.when((h % 10 == 0) & (F.size(words) > 0), bound).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of the runs and of the collapsed text."""
    text = free_name(docs, "repeated_text")
    found = find_repeats(docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias(text)), text=text)
    runs = F.col("repeats.runs")

    def stronger(best: Column, x: Column) -> Column:  # by exact exponents; runs come by start and period, so that the first of equals stays
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    best = F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), stronger)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("repeats.collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
