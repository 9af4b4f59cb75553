"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows (ten consecutive words) are the sets to be contained. Tokens are
the words, ordered by rarity over the whole corpus. For exact containment the
necessary prefix is one token: a document that holds a window holds the window's
rarest word. Documents join the windows on that word; the positional bound says
where the window would have to start (word position minus the word's place in the
window), the length bound that it ends inside the document; what is left is
compared word by word.

Two joins give the same rows. If the windows' size, counted before, is at most
``broadcast_bytes``, they go to every task and the corpus is read without a
shuffle. Beyond that, occurrences of prefix words (with the words around them) and
windows are both dealt out by prefix word, common ones in portions.

Defined results: null, empty and word-less texts have no words and no hits;
items without words have no windows; equal items are each listed; repeated
document rows are each judged; a null item_id is listed as no id; ties in rarity
go to the smaller word; an empty benchmark contaminates nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelake.llm.common import Memo, free_name, materialize, slices

#: Everything in ASCII that is not a digit or a lower-case letter separates words.
_GAPS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_GAPS).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Windows:
    """Windows by their rarest word: word -> [(place in the window, window, items)]."""

    def __init__(self, rows: Iterable[tuple[bytes, tuple[bytes, ...], list]]):
        self.by_word: dict[bytes, list[tuple[int, list[bytes], list]]] = defaultdict(list)
        for rare, window, items in rows:
            self.by_word[rare].append((window.index(rare), list(window), items))

    def hits(self, words: list[bytes]) -> tuple[int, set]:
        """Words inside any occurrence, items with occurrences."""
        by_word, ends, items = self.by_word, [], set()
        if not by_word or by_word.keys().isdisjoint(words):
            return 0, items
        for i, w in enumerate(words):
            if w in by_word:
                for place, window, own in by_word[w]:
                    start = i - place  # positional bound
                    if start >= 0 and words[start : start + len(window)] == window:
                        ends.append((start, start + len(window)))
                        items.update(own)
        return covered(ends), items


def covered(spans: list[tuple[int, int]]) -> int:
    n = at = 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def digest(items: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


def _windows(bench: DataFrame, size: int) -> DataFrame:
    """One row for each distinct window: its words and the items it is from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, found = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in dict.fromkeys(windows_of(words_of(text), size)):
                    ids.append(item)
                    found.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["item_id", "window"])

    return bench.mapInArrow(run, "item_id long, window string").groupBy("window").agg(F.collect_set("item_id").alias("items"))


def _word_counts(docs: DataFrame, wanted: DataFrame | None, small: frozenset[bytes] | None) -> DataFrame:
    """Occurrences in the corpus of the windows' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for b in slices(batches):
            for t in b.column(1).to_pylist():
                for w in words_of(t) if small is None else filter(small.__contains__, words_of(t)):
                    n[w] += 1
            if len(n) > 200_000:
                yield flush(n)
        if n:
            yield flush(n)

    def flush(n: dict[bytes, int]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
        n.clear()
        return out

    counts = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts if wanted is None else counts.join(wanted, "word", "left_semi")


def find(docs: DataFrame, bench: DataFrame, *, window: int = 10, broadcast_bytes: int = 32 << 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bench = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    if _fits(bench, window, broadcast_bytes):
        return _broadcast(docs, bench, window)
    return _dealt(docs, bench, window)


def keep_clean(docs: DataFrame, bench: DataFrame, *, window: int = 10, broadcast_bytes: int = 32 << 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window: each row is judged by its own text."""
    bench = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    at = docs.columns.index(text)
    if _fits(bench, window, broadcast_bytes):
        index = _index(texts, bench, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Windows(index.value)
            for b in slices(batches, text):
                yield b.filter(pa.array([not own.hits(words_of(t))[0] for t in b.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    leaks = _dealt(texts, bench, window, True)
    names = [free_name(docs, "k1"), free_name(docs, "k2")]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            keys = [text_key(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([k[n] for k in keys], pa.int64()) for n in (0, 1))], [*b.schema.names, *names])

    marked = docs.mapInArrow(keyed, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))
    return marked.join(leaks.toDF(*names), names, "left_anti").select(*docs.columns)


def _fits(bench: DataFrame, window: int, broadcast_bytes: int) -> bool:
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a window repeats its words, so an index takes about `window` times the text
    return size * window <= broadcast_bytes


def _index(docs: DataFrame, bench: DataFrame, window: int) -> Broadcast:
    """The windows by rarest word, sent to every task."""
    found = [(tuple(w.encode().split(b" ")), items) for w, items in _windows(bench, window).collect()]
    vocabulary = frozenset(w for ws, _ in found for w in ws)
    n = {w.encode(): k for w, k in _word_counts(docs, None, vocabulary).collect()} if vocabulary else {}
    rows = [(min(ws, key=lambda w: (n.get(w, 0), w)), ws, items) for ws, items in found]
    # windows whose rarest word is nowhere in the corpus can't occur
    return docs.sparkSession.sparkContext.broadcast([r for r in rows if n.get(r[0], 0)])


def _broadcast(docs: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    index = _index(docs, bench, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(index.value)
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                rows.append((len(words), *own.hits(words)))
            yield _rows(b.column(0), rows)

    return docs.mapInArrow(run, OUT)


def _rows(ids: pa.Array, rows: list[tuple[int, int, Iterable]]) -> pa.RecordBatch:
    hit = pa.array([r[1] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([r[0] for r in rows], pa.int64()), hit, pa.array([len([x for x in r[2] if x is not None]) for r in rows], pa.int64()), pa.array([digest(r[2]) for r in rows], pa.string()), pc.greater(hit, 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


#: A prefix word's occurrences are dealt out in portions of about this many.
PORTION = 100_000
#: Up to so many prefix words are sent to every task (16 bytes each), so that other words never travel.
SENT = 2_000_000


def text_key(text: str | None) -> tuple[int, int]:
    """128 bits that stand for a text, as two signed longs."""
    return struct.unpack("<2q", xxhash.xxh128_digest((text or "").encode()))


def word_key(word: bytes) -> int:
    """What Spark's xxhash64 makes of the word."""
    return struct.unpack(">q", xxhash.xxh64_digest(word, 42))[0]


def _prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """h, place, size, window, window_id, portions: each window under its rarest word, which is somewhere in the corpus."""
    terms = windows.select("window_id", F.explode(F.array_distinct(F.split("window", " "))).alias("word"))
    counts = _word_counts(docs, terms.select("word").distinct(), None)
    rarest = terms.join(counts, "word").groupBy("window_id").agg(F.min(F.struct("n", "word")).alias("least"))
    own = windows.join(rarest, "window_id").select("window_id", "window", F.split("window", " ").alias("ws"), "least.word", "least.n")
    return own.select(F.xxhash64("word").alias("h"), (F.array_position("ws", F.col("word")) - 1).cast("int").alias("place"), F.size("ws").alias("size"), "window", "window_id", F.ceil(F.col("n") / PORTION).cast("int").alias("portions"))


def _occurrences(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """h, portion, k1, k2, at, before, around: each occurrence of a prefix word, with the words around it that a window could hold."""
    known = prefixes.groupBy("h").agg(F.max("portions").alias("portions"))
    few = known.limit(SENT + 1).count() <= SENT
    sent = docs.sparkSession.sparkContext.broadcast({r.h: r.portions for r in known.collect()} if few else None)
    names = ["h", "portion", "k1", "k2", "at", "before", "around"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in slices(batches, "text", 1 << 18):
            rows = []
            for t in b.column(1).to_pylist():
                ws = words_of(t)
                memo.room()
                memo.update((w, word_key(w)) for w in memo.missing(set(ws)))
                k1, k2 = text_key(t)
                for at, h in enumerate(map(memo.__getitem__, ws)):
                    portions = 1 if sent.value is None else sent.value.get(h)
                    if portions:
                        low = max(0, at - window + 1)
                        rows.append((h, (k1 + at) % portions, k1, k2, at, at - low, b" ".join(ws[low : at + window]).decode()))
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    if not few:
        prefixes = prefixes.withColumn("portions", F.lit(1))
    found = docs.mapInArrow(run, "h long, portion int, k1 long, k2 long, at long, before int, around string")
    return found.join(prefixes.withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))), ["h", "portion"])


def _dealt(docs: DataFrame, bench: DataFrame, window: int, by_key: bool = False) -> DataFrame:
    """The join dealt out by prefix word; with ``by_key`` one row (k1, k2) for each text that holds a window.

    Occurrences carry the words around them, so the join itself verifies: no text is
    shuffled and no list of candidates is gathered. Common prefix words are split
    into portions of their occurrences.
    """
    windows = materialize(_windows(bench, window).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    near = _occurrences(docs, _prefixes(docs, windows), window)
    first = F.col("before") - F.col("place")  # positional bound: where the window would have to begin
    there = F.array_join(F.slice(F.split("around", " "), first + 1, F.col("size")), " ")
    hits = near.filter(first >= 0).filter(there == F.col("window")).select("k1", "k2", (F.col("at") - F.col("place")).alias("start"), "size", "window_id").distinct()
    hits = materialize(hits, "hits")
    if by_key:
        return hits.select("k1", "k2").distinct()
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))  # no more than a text has words, a window size each
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    reach = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["at"]))).alias("n"), F.greatest(acc["at"], x["end"]).alias("at"))
    covers = hits.select("k1", "k2", "start", "size").distinct().groupBy("k1", "k2").agg(F.aggregate(spans, zero, reach)["n"].alias("n_hit"))
    items = hits.select("k1", "k2", "window_id").distinct().join(windows.select("window_id", F.explode("items").alias("item")), "window_id").select("k1", "k2", F.col("item").cast("string").alias("item")).distinct()
    listed = items.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            keys = [text_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[n] for k in keys], pa.int64()) for n in (0, 1)), pa.array([len(words_of(t)) for t in texts], pa.int64())], ["doc_id", "k1", "k2", "n_words"])

    own = docs.mapInArrow(keyed, "doc_id long, k1 long, k2 long, n_words long")
    out = own.join(covers.join(listed, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    zero_long = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero_long).alias("n_hit"), F.coalesce("n_items", zero_long).alias("n_items"), F.coalesce("items_sha256", F.lit(digest(()))).alias("items_sha256"), (F.coalesce("n_hit", zero_long) > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, win.item_id, dw.i, dw.k FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
