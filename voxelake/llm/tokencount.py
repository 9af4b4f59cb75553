"""Token counts: rank-synchronous byte-pair merging over ragged numpy arrays.

A batch of distinct pre-tokens lies as one flat symbol array with sequence
offsets. In each round every sequence finds its own lowest-rank adjacent pair
(one segmented minimum) and all its occurrences merge at once; sequences without
a mergeable pair leave the batch. What survives is the token count. Counts of
pre-tokens are kept in a bounded per-worker memo, so a corpus's frequent words
are merged once.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the
limit); empty text is 0 tokens; repeated rows are counted each on its own; a text
of any length is handled whole, in slices cut where pre-tokens end; an empty
table gives an empty result; only the id and text columns are read, so other
columns, whatever their names, play no part. The vocabulary's special strings
inside a text count as one token each, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import SLICE_CHARS, Memo, in_turn, slices

NONE = np.int64(1 << 40)

#: The byte-level vocabulary's published pre-token pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies show each byte as."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary file (tokenizers JSON) as merge-rank arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each (non-empty) word after all merges."""
        counts = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), NONE)
        inside = seq[:-1] == seq[1:]
        rank[:-1][inside] = self.rank(ids[:-1][inside], ids[1:][inside])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                counts[seq[starts[over]]] = lengths[over]
                stay = np.repeat(~over, lengths)
                ids, seq, rank = ids[stay], seq[stay], rank[stay]
                lengths, least = lengths[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # in a run such as "aaa" pairs overlap: every other one merges, from the left
            first = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))
            ids, seq, rank = ids[keep], seq[keep], rank[keep]
            for p in (now, now[now > 0] - 1):  # only pairs next to a merge change
                rank[p] = NONE
                q = p[p + 1 < len(ids)]
                q = q[seq[q] == seq[q + 1]]
                rank[q] = self.rank(ids[q], ids[q + 1])
        return counts


class Counter:
    """Counts tokens of texts; keeps what it learned about words within bounds."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.words, self.chunks = Memo(), Memo()

    def pretokens(self, found: list[list[str]]) -> list[int]:
        """Token count of each list of pre-tokens."""
        self.words.room()
        new = self.words.missing({w for ws in found for w in ws})
        if new:
            self.words.update(zip(new, self.bpe.surviving([w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(self.words.__getitem__, ws)) for ws in found]

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings.

        A single space between two visible characters always starts a pre-token, so
        most texts fall into space-led chunks which the memo knows. A chunk that
        begins or ends with other white space (marked -1) sends its text the long way.
        """
        self.chunks.room()
        parts = [t.split(" ") for t in texts]
        new = self.chunks.missing({c for p in parts for c in p[1:]})
        good = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        self.chunks.update(dict.fromkeys(new, -1))
        self.chunks.update(zip(good, self.pretokens([self.bpe.split.findall(" " + c) for c in good]), strict=True))
        out, slow = [0] * len(texts), []
        heads = self.pretokens([self.bpe.split.findall(p[0]) for p in parts])
        for i, p in enumerate(parts):
            n = list(map(self.chunks.__getitem__, p[1:]))
            if -1 in n or (len(p) > 1 and (not p[0] or p[0][-1].isspace())):
                slow.append(i)
            else:
                out[i] = heads[i] + sum(n)
        for i in slow:
            for part in cut(texts[i]):
                out[i] += self.pretokens([self.bpe.split.findall(part)])[0]
        return out

    def count(self, texts: list[str]) -> list[int]:
        pieces: list[str] = []
        owner: list[int] = []
        out = [0] * len(texts)
        for i, t in enumerate(texts):
            own = [t]
            if self.bpe.special and any(s in t for s in self.bpe.specials):
                own = self.bpe.special.split(t)
                out[i] = len(own) - 1
            for x in own:
                for part in cut(x):
                    pieces.append(part)
                    owner.append(i)
        held, size = [], 0
        for j, p in enumerate(pieces):
            held.append(p)
            size += len(p)
            if size >= SLICE_CHARS or j + 1 == len(pieces):
                for k, n in zip(range(j + 1 - len(held), j + 1), self.plain(held), strict=True):
                    out[owner[k]] += n
                held, size = [], 0
        return out


def cut(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """Cut a long text in front of single spaces between visible characters, where pre-tokens end."""
    start = 0
    while len(text) - start > most:
        at = start + most
        while at > start + 1:
            at = text.rfind(" ", start + 1, at)
            if at < 0 or not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace():
                break
        if at <= start + 1:  # none in this stretch: look ahead
            at = text.find(" ", start + most)
            while 0 <= at and (text[at - 1].isspace() or at + 1 >= len(text) or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has.
    One pass without a shuffle; the work of a task follows its input split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_turn("tokencount", counter.cache_clear)
        own = counter(vocabulary)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            size = pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(own.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
