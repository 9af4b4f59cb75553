"""Language identification by interpolated Kneser-Ney character models.

Each language has a character n-gram model within words (marked begin and end).
Spark counts the longest n-grams of a sample of labelled documents; a task for each
language derives the shorter orders' continuation counts and fits its model. A model is a few sorted
arrays of n-gram hashes with their probabilities and back-off weights. A text's
language is that of the lowest cross-entropy per predicted character; entropies of
words are kept in a bounded memo, so a whole text costs one lookup a word.

Rejection is calibrated on labelled documents that were not fitted: a text is
rejected if its lowest cross-entropy is over the ``quantile`` of theirs, for that
language, times ``margin``, or if it has no letter.

The fit reads a sample: about ``sample`` documents of each language (and as many
again to calibrate), chosen by a hash of their id; that is a documented bound. All
documents are predicted.

Defined results: null and letterless texts are ``und`` with score 0 and rejected;
texts of any length are read whole; ties in entropy go to the smaller language
name; documents without a language are predicted, not learned; repeated rows count
each; if nothing can be learned everything is ``und``; an empty table gives an
empty result; other columns are handed on as they are, but for one that has the
verdict's name, which ``identify`` replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelake.llm.common import in_turn, materialize, mix64, slices

UND = "und"
BEGIN, END = "\x02", "\x03"
_LETTERS = regex.compile(r"\p{L}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: So many languages' shares are sent to every task; more are joined.
SENT = 100_000


def context_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n-1 characters before the last column of ``chars`` (rows: n-grams)."""
    h = np.zeros(len(chars), dtype=np.uint64)
    out = [h]
    with np.errstate(over="ignore"):
        for n in range(1, chars.shape[1]):
            h = mix64(h + (chars[:, -1 - n] + np.uint64(1)) * _STEP + np.uint64(n))
            out.append(h)
    return out


def characters(grams: list[str]) -> np.ndarray:
    """Code points of equally long strings, a row each."""
    flat = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(grams), -1).astype(np.uint64)


def with_char(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h ^ ((c + np.uint64(7)) * _STEP))


@dataclass
class Order:
    grams: np.ndarray  # sorted hashes of context and character
    prob: np.ndarray  # discounted probability
    heads: np.ndarray  # sorted hashes of contexts
    back: np.ndarray  # weight of the lower order


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def fit_order(rows: list[tuple[str, int]]) -> Order:
    """Absolute discounting of (n-gram, count) rows of one order."""
    count = np.array([n for _, n in rows], dtype=np.float64)
    n1, n2 = (count == 1).sum(), (count == 2).sum()
    d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    chars = characters([g for g, _ in rows])
    heads, last = context_hashes(chars)[-1], chars[:, -1]
    keys, at = np.unique(heads, return_inverse=True)
    total = np.bincount(at, weights=count)
    types = np.bincount(at)
    grams = with_char(heads, last)
    order = np.argsort(grams, kind="stable")
    return Order(grams[order], ((count - d) / total[at])[order], keys, d * types / total)


class Rows:
    """Rows of numbers by key, in two generations of about ``most`` each (as ``Memo`` has them)."""

    def __init__(self, most: int, width: int):
        self.most, self.at, self.values = most, {}, np.empty((0, width))
        self.older: tuple[dict, np.ndarray] = {}, self.values

    def places(self, keys: list[str], make: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """Where in ``values`` each key's row is; ``make`` gives the rows of new keys."""
        if len(self.at) > self.most:
            self.older, self.at, self.values = (self.at, self.values), {}, self.values[:0]
        found = list(map(self.at.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            old, rows = self.older
            distinct = dict.fromkeys(keys[i] for i in new)
            known, fresh = [k for k in distinct if k in old], [k for k in distinct if k not in old]
            first = len(self.at)
            self.at.update(zip(known + fresh, range(first, first + len(distinct)), strict=True))
            parts = [self.values, rows[[old[k] for k in known]]] + ([make(fresh)] if fresh else [])
            self.values = np.vstack(parts)
            for i in new:
                found[i] = self.at[keys[i]]
        return np.array(found, dtype=np.int64)


class Models:
    """Kneser-Ney models of several languages; entropies of n-grams and words are kept within bounds."""

    def __init__(self, languages: list[str], orders: list[list[Order]], alphabet: int):
        self.languages, self.orders, self.alphabet = languages, orders, alphabet
        self.order = len(orders[0])
        self.forget()

    def forget(self) -> None:
        self.grams, self.words = Rows(150_000, len(self.languages)), Rows(300_000, len(self.languages) + 1)

    def __reduce__(self):  # what is kept is the worker's own
        return Models, (self.languages, self.orders, self.alphabet)

    def gram_bits(self, grams: list[str]) -> np.ndarray:
        """Negative log probability of each n-gram's last character in each language (columns)."""
        chars = characters(grams)
        heads, out = context_hashes(chars), np.empty((len(grams), len(self.languages)))
        for j, orders in enumerate(self.orders):
            p = np.full(len(grams), 1.0 / self.alphabet)
            for h, o in zip(heads, orders, strict=True):
                p = lookup(o.grams, o.prob, with_char(h, chars[:, -1]), 0.0) + lookup(o.heads, o.back, h, 1.0) * p
            out[:, j] = -np.log(p)
        return out

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word with its end, and its predicted characters (last column)."""
        k = self.order
        padded = [BEGIN * (k - 1) + w + END for w in words]
        at = self.grams.places([s[i : i + k] for s in padded for i in range(len(s) - k + 1)], self.gram_bits)
        sizes = np.array([len(w) + 1 for w in words])
        return np.hstack([np.add.reduceat(self.grams.values[at], np.cumsum(sizes) - sizes, axis=0), sizes[:, None]])

    def chunk_bits(self, chunks: list[str]) -> np.ndarray:
        """The same, summed over the words of chunks between white space."""
        rows = np.zeros((len(chunks), len(self.languages) + 1))
        for i in range(0, len(chunks), 20_000):  # n-grams of so many words at once
            found = [_LETTERS.findall(c) for c in chunks[i : i + 20_000]]
            flat = [x for f in found for x in f]
            if flat:
                np.add.at(rows, i + np.repeat(np.arange(len(found)), [len(f) for f in found]), self.word_bits(flat))
        return rows

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed negative log probability in each language, and predicted characters, of each text."""
        parts = [t.lower().split() for t in texts]
        at = self.words.places([w for p in parts for w in p], self.chunk_bits)
        total, done = np.zeros((len(texts), len(self.languages) + 1)), 0
        for i, p in enumerate(parts):
            total[i] = self.words.values[at[done : done + len(p)]].sum(axis=0)
            done += len(p)
        return total[:, :-1], total[:, -1]


def _spread(docs: DataFrame, sample: int) -> DataFrame:
    """Labelled documents of the fit (part 0) and of the calibration (part 1), by a hash of the id.

    The languages' shares go to the texts, as long as there are no more than ``SENT``
    languages, so that no text is shuffled to draw the sample.
    """
    per = materialize(docs.groupBy("lang").agg(F.least(F.lit(0.5), F.lit(float(sample)) / F.count("*")).alias("share")), "languages")
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.join(F.broadcast(per) if per.count() <= SENT else per, "lang")
    return rows.withColumn("part", F.when(u < F.col("share"), 0).when(u < 2 * F.col("share"), 1)).filter("part is not null").select("lang", "text", "part")


@dataclass
class Identifier:
    models: Models | None
    limits: np.ndarray  # highest accepted entropy per character, by language

    def forget(self) -> None:
        if self.models:
            self.models.forget()

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, entropy per character and rejection of each text."""
        if self.models is None:
            return [(UND, 0.0, None, True)] * len(texts)
        bits, n = self.models.texts(texts)
        out = []
        for b, m in zip(bits, n, strict=True):
            if not m:
                out.append((UND, 0.0, None, True))
                continue
            ce = b / m
            j = int(np.argmin(ce))
            # posterior of at most 40 characters' worth of evidence
            out.append((self.models.languages[j], float(1 / np.exp(-(ce - ce[j]) * min(m, 40.0)).sum()), float(ce[j]), bool(ce[j] > self.limits[j])))
        return out


def fit_language(counts: pa.Table) -> pa.Table:
    """The orders of one language's model, of rows (lang, gram, n) of its longest n-grams."""
    grams = dict(zip(counts["gram"].to_pylist(), counts["n"].to_pylist(), strict=True))
    orders = []
    while grams:
        orders.append(fit_order(sorted(grams.items())))
        shorter: dict[str, int] = {}
        for g in grams:  # continuation counts: how many different characters a shorter n-gram follows
            if len(g) > 1:
                shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        grams = shorter
    rows = [(k, *(x.tobytes() for x in (o.grams, o.prob, o.heads, o.back))) for k, o in enumerate(reversed(orders))]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)]
    return pa.Table.from_arrays([pa.array([counts["lang"][0].as_py()] * len(rows)), *columns], ["lang", "k", "grams", "prob", "heads", "back"])


def train(docs: DataFrame, *, sample: int = 3000, order: int = 4, quantile: float = 0.999, margin: float = 1.1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """Fit and calibrate on documents with a language.

    Each language is fitted in a task of its own; the finished models, whose size
    ``sample`` bounds, come to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    chosen = _spread(rows, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], int] = {}
        words: dict[tuple[str, str], int] = {}
        for b in slices(batches):
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in t.split():
                    words[name, w] = words.get((name, w), 0) + 1
        for (name, chunk), k in words.items():
            for w in _LETTERS.findall(chunk):
                s = BEGIN * (order - 1) + w.lower() + END
                for i in range(len(s) - order + 1):
                    key = name, s[i : i + order]
                    n[key] = n.get(key, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "gram", "n"])

    level = chosen.filter("part = 0").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    level = materialize(level, "grams")
    found = level.groupBy("lang").applyInArrow(fit_language, "lang string, k int, grams binary, prob binary, heads binary, back binary").collect()
    if not found:
        return Identifier(None, np.empty(0))
    orders: dict[str, list[Order]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.k)):
        orders.setdefault(r.lang, []).append(Order(*(np.frombuffer(x, kind) for x, kind in ((r.grams, np.uint64), (r.prob, float), (r.heads, np.uint64), (r.back, float)))))
    names = list(orders)
    # a begin mark is never predicted: n-grams ending in one don't occur
    alphabet = 1 + level.select(F.substring("gram", -1, 1)).distinct().count()
    models = Models(names, [orders[name] for name in names], alphabet)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        in_turn("langid calibration", own.forget)
        at = {name: j for j, name in enumerate(own.languages)}
        for b in slices(batches):
            bits, n = own.texts(b.column(1).to_pylist())
            ce = [float(x[at[name]] / m) if m and name in at else None for x, m, name in zip(bits, n, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ce, pa.float64())], ["lang", "ce"])

    seen = chosen.filter("part = 1").select("lang", "text").mapInArrow(entropy, "lang string, ce double").groupBy("lang").agg(F.percentile_approx("ce", quantile, 10_000).alias("q"))
    limit = {r.lang: r.q for r in seen.collect() if r.q is not None}
    return Identifier(models, np.array([margin * limit.get(name, np.inf) for name in names]))


def identify(docs: DataFrame, model: Identifier, *, text: str = "text", into: str = "langid") -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: lang_pred, score, entropy, rejected.

    A column that has the struct's name already is replaced.
    """
    docs = docs.drop(into)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        in_turn("langid", own.forget)
        for b in slices(batches, text):
            rows = own.predict([t or "" for t in b.column(at).to_pylist()])
            found = pa.array([dict(zip(("lang_pred", "score", "entropy", "rejected"), r, strict=True)) for r in rows], FOUND)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, OUT)]))


def keep_identified(docs: DataFrame, model: Identifier, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with just their own columns, that are not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        in_turn("langid", own.forget)
        for b in slices(batches, text):
            yield b.filter(pa.array([not r[3] for r in own.predict([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def held_out(doc_id: Column) -> Column:
    """Documents whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected; fitted on what is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows.filter(~held_out(F.col("doc_id"))), **how)
    return identify(rows.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "langid.lang_pred", "langid.score", "langid.entropy", "langid.rejected")
