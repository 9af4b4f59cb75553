"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector w over hashed text features is shared by all grades; ordered
thresholds cut its score s into grades: P(grade <= k) = sigmoid(t_k - s). From it
follow the expected grade and the tail probability P(grade >= g) used to select.

Features: words, their first four letters, word shapes ("Ab,", "A!", "9#"), how large a share of the words
each shape has, and how much of the text repeats itself, hashed into ``width``
slots; each counts once a document. The fit reads about ``sample`` rated documents,
chosen by a hash of their id (a documented bound): tasks make features, one task
runs the bounded gradient descent. All documents are scored, in one pass.

Defined results: null and empty texts have no features and get the grades' prior;
rows without a rating are not learned; with no grade above 0 known, every text
gets grade 0 and tail 1, and is kept; repeated rows count each; very long
texts are read whole; ties at the limit are kept; an empty table gives an empty
result; other columns are handed on as they are, but for one that has the verdict's
name, which ``judge`` replaces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelake.llm.common import Memo, in_turn, slices

_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: cased(m[0])), (re.compile(r"\d+"), lambda m: "9"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1]))


def cased(letters: str) -> str:
    return "a" if letters.islower() else "A" if len(letters) > 1 and letters.isupper() else "Ab" if letters[0].isupper() else "a"


def shape(word: str) -> str:
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word[:12]


def bare_and_shape(word: str) -> tuple[str, str]:
    """The word's letters and digits, lower-cased, and its shape."""
    if word.isalpha():
        return word.lower(), cased(word)
    stem = word[:-1]
    if stem.isalpha() and not word[-1].isalnum() and word[-1] != "_":
        return stem.lower(), cased(stem) + word[-1]
    return re.sub(r"\W+", "", word.lower()), shape(word)


class Features:
    """Feature slots of texts; words' slots and shapes stay in a bounded memo."""

    def __init__(self, width: int, used: np.ndarray | None = None):
        self.width, self.used, self.memo = width, used, Memo(200_000)

    def slot(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.width

    def of(self, text: str | None) -> np.ndarray:
        self.memo.room()
        words = (text or "").split()
        if not words:
            return np.empty(0, dtype=np.int64)
        slots, shapes, get = set(), {}, self.memo.__getitem__
        distinct = Counter(words)
        for w in self.memo.missing(distinct):
            bare, form = bare_and_shape(w)
            own = [self.slot(f"{len(x)}:{x}") for x in {bare, bare[:4]} if x]
            self.memo[w] = (form, own if self.used is None else [x for x in own if self.used[x]])
        for w, n in distinct.items():
            known = get(w)
            if known[1]:
                slots.update(known[1])
            shapes[known[0]] = shapes.get(known[0], 0) + n
        for s, n in shapes.items():
            slots.add(self.slot(f"share:{s}:{round(2 * math.log2(n / len(words)))}"))
        slots.add(self.slot(f"repeats:{round(4 * len(distinct) / len(words))}:{min(12, len(words).bit_length())}"))
        return np.fromiter(slots, dtype=np.int64, count=len(slots))


@lru_cache(maxsize=2)
def features(width: int) -> Features:
    return Features(width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than there are grades
    grades: int
    width: int

    @cached_property
    def features(self) -> Features:
        return Features(self.width, self.weights != 0)

    def forget(self) -> None:
        self.__dict__.pop("features", None)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (columns) of each score."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    def verdicts(self, texts: list[str | None], tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= ``tail``) of each text; the highest grade is meant by None."""
        tails = self.tails(np.array([self.weights[self.features.of(t)].sum() for t in texts]))
        column = (self.grades - 1 if tail is None else tail) - 1
        return tails.sum(axis=1), tails[:, column] if tails.shape[1] else np.full(len(tails), float(self.grades == 1 and column < 0))


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int, width: int, *, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5, sure: float = 5.0, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the cumulative-link likelihood.

    Only slots whose documents' share of some grade is ``sure`` standard deviations off
    the sample's take part: the weights of others would only learn texts by heart.
    """
    slot = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(slot, minlength=width)
    told = np.zeros(width, dtype=bool)
    for k in range(grades):
        p = (grade == k).mean()
        if 0 < p < 1:
            here = np.bincount(slot, weights=(grade == k)[doc], minlength=width)
            told |= (seen >= least) & (np.abs(here - p * seen) >= sure * np.sqrt(np.maximum(1, seen) * p * (1 - p)))
    slot, doc = slot[told[slot]], doc[told[slot]]
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.log((1 - share) / share)
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(grades - 1))
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    gap = np.r_[cut[0], np.log(np.maximum(np.diff(cut), 1e-3))]  # first threshold, then logs of the steps
    gm, gv = np.zeros_like(gap), np.zeros_like(gap)
    for step in range(1, steps + 1):
        t = np.cumsum(np.r_[gap[0], np.exp(gap[1:])])
        s = np.bincount(doc, weights=w[slot], minlength=len(rows))
        edge = np.r_[-np.inf, t, np.inf]
        hi, lo = edge[grade + 1], edge[grade]
        fh, fl = sigmoid(hi - s), sigmoid(lo - s)
        p = np.maximum(fh - fl, 1e-12)
        dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p
        ds = dh - dl  # d(-log p)/ds
        g = np.bincount(slot, weights=ds[doc], minlength=width) / len(rows) + ridge * w
        dt = np.array([(dl[grade == k + 1].sum() - dh[grade == k].sum()) / len(rows) for k in range(grades - 1)])
        gg = np.r_[dt.sum(), [np.exp(gap[j]) * dt[j:].sum() for j in range(1, grades - 1)]]
        for x, d, a, b in ((w, g, m, v), (gap, gg, gm, gv)):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w, np.cumsum(np.r_[gap[0], np.exp(gap[1:])])


def train(rated: DataFrame, *, sample: int = 16_000, width: int = 1 << 18, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """Fit on about ``sample`` of the rows with a grade (0, 1, ...)."""
    rows = rated.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(grade).cast("int").alias("grade")).filter("grade is not null and grade >= 0")
    n, top = rows.agg(F.count("*"), F.max("grade")).first()
    if not n or not top:
        return Ordinal(np.zeros(width), np.empty(0), 1, width)
    grades = top + 1

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_turn("quality sample", features.cache_clear)
        for b in slices(batches):
            slots = [features(width).of(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.binary())], ["grade", "slots"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, own = [], []
        for b in batches:
            g += b.column(0).to_pylist()
            own += [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in b.column(1).to_pylist()]
        if g:
            w, t = fit(own, np.array(g), grades, width)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([t.tobytes()])], ["w", "t"])

    chosen = rows.filter(drawn() < min(1.0, sample / n)).select("grade", "text")
    made = chosen.mapInArrow(extract, "grade int, slots binary").coalesce(1) if n < 100 else chosen.mapInArrow(extract, "grade int, slots binary").repartition(1)
    solved = made.mapInArrow(solve, "w binary, t binary").collect()
    if not solved:
        return Ordinal(np.zeros(width), np.empty(0), 1, width)
    return Ordinal(np.frombuffer(solved[0].w, dtype=np.float32).astype(np.float64), np.frombuffer(solved[0].t, dtype=np.float64), grades, width)


def judge(docs: DataFrame, model: Ordinal, *, tail: int | None = None, least: float = 0.5, text: str = "text", into: str = "quality") -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: expected_grade, tail_prob, keep.

    tail_prob is P(grade >= ``tail``), the highest grade unless told otherwise; ``keep``
    says that it is at least ``least``. A column that has the struct's name already is
    replaced.
    """
    docs = docs.drop(into)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        in_turn("quality", own.forget)
        for b in slices(batches, text):
            expected, p = own.verdicts(b.column(at).to_pylist(), tail)
            rows = [{"expected_grade": float(e), "tail_prob": float(x), "keep": bool(x >= least)} for e, x in zip(expected, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, VERDICT)], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, OUT)]))


def keep_good(docs: DataFrame, model: Ordinal, *, tail: int | None = None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with just their own columns, whose tail probability is at least ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        in_turn("quality", own.forget)
        for b in slices(batches, text):
            yield b.filter(pa.array(own.verdicts(b.column(at).to_pylist(), tail)[1] >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


OUT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType()), T.StructField("keep", T.BooleanType())])
VERDICT = pa.struct([("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("keep", pa.bool_())])


def graded(docs: DataFrame, labels: DataFrame, sample: int = 16_000) -> DataFrame:
    """doc_id, text, grade of about ``sample`` rated documents: 0 poor, 1 good but toxic, 2 good.

    Unrated quality is no rating; several ratings of a document count as the poorest
    one. The sample is drawn from the ratings by a hash of the id, which bounds it, so
    that it goes to the texts and no text is shuffled.
    """
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    known = labels.filter("quality is not null and doc_id is not null")
    n = known.count()
    chosen = known.filter(drawn() < min(1.0, sample / max(1, n))).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def drawn() -> Column:
    """A number from 0 to 1 by the id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
