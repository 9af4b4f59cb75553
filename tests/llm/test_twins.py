"""Plain twins of the fitted operators: the same rules, written out word by word."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxelake.llm import langid, quality

# --- quality ---


def plain_shape(word: str) -> str:
    def cased(m: re.Match) -> str:
        x = m[0]
        return "a" if x.islower() else "A" if len(x) > 1 and x.isupper() else "Ab" if x[0].isupper() else "a"

    return re.sub(r"([^\w\s])\1+", r"\1", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", cased, word)))[:12]


def plain_slots(text: str, width: int) -> set[int]:
    words, names = text.split(), set()
    shapes = Counter(plain_shape(w) for w in words)
    for w in words:
        bare = re.sub(r"\W+", "", w.lower())
        names |= {f"{len(x)}:{x}" for x in (bare, bare[:4]) if x}
    names |= {f"share:{s}:{round(2 * math.log2(n / len(words)))}" for s, n in shapes.items()}
    names.add(f"repeats:{round(4 * len(set(words)) / len(words))}:{min(12, len(words).bit_length())}")
    return {zlib.crc32(n.encode()) % width for n in names}


def rated_rows(n: int) -> list:
    rng, rows = random.Random(7), []
    for i in range(n):
        words = [rng.choice(("Good", "fine,", "w12", "ende.", "x-y")) + str(rng.randint(0, 60)) for _ in range(rng.randint(5, 60))]
        grade = i % 3
        if grade == 0:
            words = [w + "$$$" if rng.random() < 0.6 else w for w in words]
        if grade == 1:
            words[rng.randrange(len(words))] = "Rude!"
        rows.append((i, " ".join(words), grade))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.createDataFrame(rated_rows(900), "doc_id long, text string, grade int"))


def test_verdicts_equal_the_plain_formula(spark, model):
    rows = rated_rows(60)
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, grade int, Quality string, keep int")
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    for i, text, _ in rows:
        s = sum(model.weights[x] for x in plain_slots(text, model.width))
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert got[i].quality.expected_grade == pytest.approx(sum(tails)) and got[i].quality.tail_prob == pytest.approx(tails[-1])
        assert got[i].keep == 1 and (i in kept) == got[i].quality.keep  # a column named like the verdict is replaced, others stay
    assert quality.keep_good(docs, model).columns == docs.columns


def test_fit_is_as_likely_as_plain_descent():
    rng = np.random.default_rng(3)
    width, rows, grade = 16, [], []
    for i in range(240):
        g = i % 3
        rows.append(np.unique(np.r_[rng.integers(0, 10, 3), 10 + g, 13 + (g if rng.random() < 0.7 else rng.integers(0, 3))]))
        grade.append(g)
    grade = np.array(grade)
    x = np.zeros((240, width))
    for i, r in enumerate(rows):
        x[i, r] = 1

    def loss(w: np.ndarray, t: np.ndarray) -> float:
        edge = np.r_[-1e9, t, 1e9]
        s = x @ w
        p = 1 / (1 + np.exp(np.clip(s - edge[grade + 1], -500, 500))) - 1 / (1 + np.exp(np.clip(s - edge[grade], -500, 500)))
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    w, t = quality.fit(rows, grade, 3, width, ridge=0.0, steps=400)
    used = np.flatnonzero(w)
    v, cut = np.zeros(width), np.array([-0.7, 0.7])
    for _ in range(400):  # finite differences over the slots that take part
        for z in (v, cut):
            for j in used if z is v else range(2):
                d = np.zeros_like(z)
                d[j] = 1e-5
                up = loss(v + d, cut) - loss(v - d, cut) if z is v else loss(v, cut + d) - loss(v, cut - d)
                z[j] -= 0.5 * up / 2e-5
    assert (np.diff(t) > 0).all() and len(used) >= 5 and loss(w, t) <= loss(v, cut) + 0.02


# --- language ---


def plain_models(rows: list[tuple[str, str]], k: int = 4) -> tuple[dict, int]:
    """Per language a function (context, character) -> probability, by interpolated Kneser-Ney."""
    longest: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for chunk in text.split():
            for w in langid._LETTERS.findall(chunk):
                s = langid.BEGIN * (k - 1) + w.lower() + langid.END
                longest[lang].update(s[i : i + k] for i in range(len(s) - k + 1))
    counts: dict[str, dict[int, Counter]] = {}
    for lang, n in longest.items():
        counts[lang] = {k: n}
        for m in range(k - 1, 0, -1):
            counts[lang][m] = Counter(g[1:] for g in counts[lang][m + 1])
    alphabet = 1 + len({g for own in counts.values() for g in own[1]})

    def model(own: dict[int, Counter]):
        heads, ones = {}, {}
        for m, c in own.items():
            heads[m] = defaultdict(list)
            for g, n in c.items():
                heads[m][g[:-1]].append(n)
            n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            ones[m] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

        def p(context: str, char: str) -> float:
            out = 1 / alphabet
            for m in range(1, k + 1):
                h = context[len(context) - m + 1 :]
                if seen := heads[m].get(h):
                    out = max(own[m].get(h + char, 0) - ones[m], 0) / sum(seen) + ones[m] * len(seen) / sum(seen) * out
            return out

        return p

    return {lang: model(own) for lang, own in counts.items()}, alphabet


def test_languages_equal_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    odd = spark.createDataFrame([(10_001, "Zzyx qqq żółw", None, "a", 1), (10_002, "1 2 3 ...", "en", "a", 1), (10_003, None, "xx", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd).withColumn("LangId", docs["doc_id"])
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    fitted = [(r.lang, r.text) for r in langid._spread(labelled, 3000).filter("part = 0").collect()]
    models, _ = plain_models(fitted)
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    for r in docs.collect():
        bits, n = dict.fromkeys(models, 0.0), 0
        for w in langid._LETTERS.findall((r.text or "")[:4000].lower()) if len(r.text or "") <= 4000 else ():
            s = langid.BEGIN * 3 + w + langid.END
            n += len(w) + 1
            for lang, p in models.items():
                bits[lang] -= sum(math.log(p(s[i : i + 3], s[i + 3])) for i in range(len(s) - 3))
        mine = got[r.doc_id].langid
        if n:
            best = min(sorted(bits), key=bits.get)
            assert mine.lang_pred == best and mine.entropy == pytest.approx(bits[best] / n, rel=1e-9)
        elif not r.text or len(r.text) <= 4000:
            assert mine.lang_pred == "und" and mine.rejected
