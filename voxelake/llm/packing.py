"""Best-fit packing of tokenised documents: hierarchical residual packing.

Each task tokenises its documents, cuts those longer than a sequence, packs its
pieces best-fit (longest first) and emits nearly full bins for good. Underfull
bins then travel as items, with their members packed in a byte string, to fewer
tasks, which best-fit them again, and so on up the tree. A round's task count
follows the number of bins left, so no task holds more than about
``bins_per_task`` of them; the tree ends at one task, or when a round no longer
saves bins (bins all over half full cannot be joined by anyone).

Defined results: null and empty texts are one end token, hence one piece of
length 1; equal lengths pack in task order, the assignment is one of many equally
good ones; repeated rows are packed each on its own; a null doc_id stays null;
very long texts give full pieces that need no packing; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import Memo, in_turn, materialize, slices

#: Letters below this one are lower-cased and normalised one by one, into one letter.
PLAIN = "\u0130"
#: Letters with ASCII marks after them (no apostrophe: the vocabulary has rules for it).
STEM_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: The same for the Latin letters below ``PLAIN``, marks or not, as Arrow reads it.
STEM_AND_MARKS = r"^(?P<stem>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: One piece as it travels: ids are gone by then, only their checksum stays.
MEMBER = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i4")])
BIN = pa.schema([("fill", pa.int32()), ("members", pa.binary())])
BIN_DDL = "fill int, members binary"


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, through bounded memos of words.

    The vocabulary drops white space and never joins over it, so a text's ids are
    its words' ids in a row. Nor does it join letters with an ASCII mark after them,
    so most words are a stem of letters and a mark. Arrow finds the distinct words of
    the texts and tells stem and marks apart. New stems are encoded as one long
    text, whose ids are cut where a token ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.words, self.stems = Memo(150_000), Memo(300_000)
        ends = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in ends.items() if t.endswith("</w>")]] = True

    def single(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn_stems(self, stems: list[str]) -> None:
        for i in range(0, len(stems), 5000):
            part = stems[i : i + 5000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for w, e in zip(part, (4 * ends).tolist(), strict=True):
                    self.stems[w] = data[at:e]
                    at = e
            else:  # lower-casing took a stem apart
                self.stems.update((w, self.single(w)) for w in part)

    def learn(self, words: list[str]) -> None:
        stems, marks = [], []  # two lists of strings: nothing for the garbage collector to walk
        for w in words:
            stem, mark = "", w
            if w.isalpha():
                stem, mark = folded(w), ""
            elif (m := STEM_MARKS.fullmatch(w)) and (w.isascii() or max(w) < PLAIN):
                stem, mark = m[1].lower(), m[2]
            stems.append(stem)
            marks.append(mark)
        self.learn_stems(self.stems.missing(set(filter(None, stems))))
        parted = {m for s, m in zip(stems, marks, strict=True) if s and m}
        self.stems.update((m, self.single(m)) for m in self.stems.missing(parted))
        known = self.stems
        for w, s, m in zip(words, stems, marks, strict=True):
            self.words[w] = (known[s] + known[m] if m else known[s]) if s else self.single(m) if m else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        self.words.room()
        self.stems.room()
        parts = pc.split_pattern(pa.array([lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        known = self.ids_of(coded.dictionary).take(coded.indices)
        _, ends, data = known.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[parts.offsets.to_numpy()].tolist() if texts else []
        held = memoryview(data or b"")
        return [bytes(held[a:b]) for a, b in pairwise(at)]

    def ids_of(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words: known letters and marks are told apart at once, other words one by one."""
        cut = pc.extract_regex(words, STEM_AND_MARKS)
        plain = pc.is_valid(cut)
        cut, other = cut.filter(plain), listed(words.filter(pc.invert(plain)))
        stems, marks = (pc.dictionary_encode(cut.field(n)) for n in ("stem", "marks"))
        stems = pa.DictionaryArray.from_arrays(stems.indices, pc.utf8_lower(stems.dictionary))
        self.learn_stems(self.stems.missing(set(filter(None, listed(stems.dictionary)))))
        self.stems.update((m, self.single(m)) for m in self.stems.missing(listed(marks.dictionary)))
        self.learn(self.words.missing(other))
        halves = (pa.array([self.stems[x] for x in listed(d.dictionary)], pa.large_binary()).take(d.indices) for d in (stems, marks))
        joined = pc.binary_join_element_wise(*halves, pa.scalar(b"", pa.large_binary()))
        rest = pa.array([self.words[w] for w in other], pa.large_binary())
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, len(joined) + np.cumsum(~mask) - 1)
        return pa.concat_arrays([joined, rest]).take(pa.array(place))


def listed(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls, by way of numpy, which is faster."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def lowered(text: str) -> str:
    """Lower case where all letters are Latin-1, as the vocabulary's own rule has it there; other texts as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def folded(stem: str) -> str:
    """Lower case where it is letter by letter; the vocabulary's own rule decides elsewhere."""
    return stem.lower() if stem.isascii() or max(stem) < PLAIN else stem


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Encoder(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each item, number of bins.

    Open bins stand in one stack per room left; a bit mask of the non-empty stacks
    finds the tightest room that fits with one shift.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            open_ |= 1 << left
    return bins, offsets, n


def join_bins(fills: np.ndarray, members: list[bytes], capacity: int) -> Iterator[tuple[int, bytes]]:
    """Best-fit whole bins into each other; each result is (fill, members)."""
    bins, offsets, n = best_fit(fills, capacity)
    held: list[list[int]] = [[] for _ in range(n)]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    for own in held:
        parts = []
        for i in own:
            m = members[i]
            if offsets[i]:
                m = np.frombuffer(m, dtype=MEMBER).copy()
                m["offset"] += offsets[i]
                m = m.tobytes()
            parts.append(m)
        yield int(fills[own].sum()), b"".join(parts)


def _emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=BIN)


def pieces_of(data: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of a document's ids (4 bytes each)."""
    for k, at in enumerate(range(0, len(data), capacity * 4)):
        part = data[at : at + capacity * 4]
        yield k, k * capacity, len(part) // 4, zlib.crc32(part)


def pack(
    docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, slack: int = 16, bins_per_task: int = 20_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A bin is nearly full, and final, when at most ``slack`` tokens are free.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_turn("packing", encoder.cache_clear)
        own = encoder(vocabulary)
        held: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = np.array(held, dtype=MEMBER)
            members = [rows[i : i + 1].tobytes() for i in range(len(rows))]
            out = list(join_bins(rows["length"].astype(np.int64), members, capacity))
            for i in range(0, len(out), 8192):
                yield _emit(out[i : i + 8192])

        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for d, data in zip(b.column(0).to_pylist(), own.encode(texts), strict=True):
                for k, start, length, crc in pieces_of(data + end, capacity):
                    held.append((d or 0, d is None, k, start, length, crc, 0))
            if len(held) >= 5 * bins_per_task:
                yield from packed()
                held.clear()
        if held:
            yield from packed()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(f, m) for b in batches for f, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if held:
            out = list(join_bins(np.array([f for f, _ in held], dtype=np.int64), [m for _, m in held], capacity))
            for i in range(0, len(out), 8192):
                yield _emit(out[i : i + 8192])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(m, dtype=MEMBER) for m in b.column(1).to_pylist()]
            rows = np.concatenate(parts) if parts else np.empty(0, MEMBER)
            seq = np.repeat(b.column(0).to_numpy(), [len(p) for p in parts])
            null = rows["null"].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], mask=null), *(pa.array(rows[c].astype(np.int64)) for c in ("piece", "start", "length", "crc")), pa.array(seq), pa.array(rows["offset"].astype(np.int64))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    level = materialize(rows.mapInArrow(first, BIN_DDL), "bins0")
    full = F.col("fill") >= capacity - slack
    done = level.filter(full)
    rest = level.filter(~full)
    left = rest.count()
    while left > 1:
        tasks = max(1, -(-left // bins_per_task))
        level = materialize(rest.repartition(tasks).mapInArrow(again, BIN_DDL), "bins")
        done = done.unionByName(level.filter(full))
        rest = level.filter(~full)
        now = level.count()
        if tasks == 1 or now == left:
            break
        left = rest.count()
    bins = done.unionByName(rest).select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return bins.mapInArrow(unfold, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("piece", F.col("piece").cast("int"))
