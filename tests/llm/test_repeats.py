"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import time
import zlib

from voxelake.llm import registry, repeats

ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "a b " * 3 + "a"), (6, "a b " * 4), (6, "a b " * 4), (None, "x " * 9), (7, "x " * 200_000), (8, "é\xa0é é\xa0é \x1c \x1c \x1c \x1c \x1c \x1c"), (9, "x x x x x"), (10, "y" * 300_000)]


def brute(w: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def expected(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w) if len(set(w)) > 1 else [(0, n, 1)] if n >= 6 else []
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for k, x in enumerate(w) if k not in gone))]
    return (str(doc_id), len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_runs_equal_a_scan_of_every_period():
    rng = random.Random(3)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(0, 6)):
            d = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 40))]
            docs.append(d[: rng.randint(1, 5)] * rng.randint(1, 9) + d if rng.random() < 0.5 else d)
        for least, times in ((6, 4), (2, 2), (9, 3)):
            got = repeats.taken_apart([" ".join(d).encode() for d in docs] + [None], least, times)
            assert [[tuple(r.values()) for r in runs] for _, runs, _ in got] == [*(brute(d, least, times) for d in docs), []]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.queries()["op12_periodic_runs"](spark, sf_dir).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, repeats int")
    assert sorted((str(r[0]), *r[1:]) for r in repeats.query(df).collect()) == sorted(expected(*r) for r in ODD)
    assert repeats.query(df.limit(0)).count() == 0
    own = repeats.find_repeats(df.withColumnRenamed("repeats", "n_words")).filter("doc_id = 5").first()
    assert own.repeats.collapsed == "a b a b a b a" and own.n_words == 1 and own.repeats.n_words == 7


def test_one_word_for_ever_takes_no_square_of_its_length():
    t = time.time()
    assert repeats.taken_apart([b"x " * 500_000], 6, 4)[0][1] == [{"start": 0, "length": 500_000, "period": 1}]
    assert time.time() - t < 60
