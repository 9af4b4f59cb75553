"""The training-data operators: contracts on small tables, edge cases, brute-force twins."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from oracle import connect, same
from voxelake.llm import ann, chat, components, decontam, html_extract, langid, ngram_lm, packing, quality, registry, simhash, tokencount

DOC = "doc_id long, text string, lang string"
ODD = [(1, None, None), (2, "", "en"), (3, "  \n ", "xx"), (4, "word", None), (4, "word", None), (None, "no id here", "en"), (5, "x " * 40_000, "en"), (6, "é́ İı 😀\x1c<|endoftext|>'s", "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated, very long and strange texts, with a column whose name clashes."""
    return spark.createDataFrame([(*r, 7) for r in ODD], DOC + ", n_tokens int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_equals_sql(key, spark, sf_dir):
    same(registry.queries()[key](spark, sf_dir).toPandas(), connect(sf_dir).sql(registry.oracle_sql()[key]).df())


def test_token_counts_equal_the_library(odd, none):
    tok = Tokenizer.from_file(registry.COUNT_VOCABULARY)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(odd, registry.COUNT_VOCABULARY).collect())
    want = []
    for d, t, _ in ODD:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((str(d), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokencount.count_tokens(none, registry.COUNT_VOCABULARY).count() == 0


def test_token_counts_on_random_texts():
    tok, own = Tokenizer.from_file(registry.COUNT_VOCABULARY), tokencount.Counter(registry.COUNT_VOCABULARY)
    rng = random.Random(1)
    alphabet = [*"ab '\n\t  éß1二\x1c\xa0s'tZ#!aaa\ŕ😀", "<|endoftext|>", " the", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert own.count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(rng.choice(["foo", " bar", "\nx"]) for _ in range(600_000))
    assert "".join(tokencount.cut(long)) == long and own.count([long]) == [len(tok.encode(long).ids)]


def check_packing(got: pd.DataFrame, docs: list, capacity: int = 2048):
    tok = Tokenizer.from_file(registry.PACK_VOCABULARY)
    want = []
    for d, t, *_ in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((str(d), n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    ids = [None if pd.isna(d) else int(d) for d in got.doc_id]
    assert sorted(zip(map(str, ids), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= capacity and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    return got.sequence_id.nunique(), -(-got.length.sum() // capacity)


def test_packing_round_trip(spark, odd, none, sf_dir):
    check_packing(packing.pack(odd, registry.PACK_VOCABULARY).toPandas(), ODD)
    assert packing.pack(none, registry.PACK_VOCABULARY).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    used, least = check_packing(packing.pack(docs, registry.PACK_VOCABULARY, bins_per_task=40).toPandas(), rows)
    assert used <= 1.05 * least + 1


def test_packing_words_on_random_texts():
    tok, own = Tokenizer.from_file(registry.PACK_VOCABULARY), packing.Encoder(registry.PACK_VOCABULARY)
    rng = random.Random(2)
    alphabet = [*"abS '\n\t  éÉß1二<\x1c\xa0's\x85t'Z#!ΣİıᾼŒ\r가😀ǅ", "<|endoftext|>", " the", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_takes_latin_words_at_once():
    tok, own = Tokenizer.from_file(registry.PACK_VOCABULARY), packing.Encoder(registry.PACK_VOCABULARY)
    texts = ["Ärger, été! Été... Ōsaka naïve## naïve ×× µ½ it's", "", "x9 Łódź\tŁódź İx ÷a a÷ Σ. \u0130 \u012f?", "été! Ärger, " * 50]
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    # only what is not letters below U+0130 and marks is looked at word by word
    assert set(own.words) == {"", "Ōsaka", "××", "µ½", "it's", "x9", "Łódź\tŁódź", "İx", "÷a", "a÷", "Σ.", "\u0130"}


def test_best_fit_beats_nothing_smaller():
    bins, offsets, n = packing.best_fit(np.array([5, 7, 3, 5]), 10)
    assert n == 2 and sorted(np.bincount(bins, [5, 7, 3, 5])) == [10, 10] and offsets.max() <= 7


def test_best_fit_equals_a_plain_search():
    """The tightest open bin by looking at all of them, largest item first."""
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 80))])
        rooms: list[int] = []
        for size in sorted(sizes.tolist(), reverse=True):
            fits = [(r, b) for b, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[min(fits)[1]] -= size
            else:
                rooms.append(capacity - size)
        bins, offsets, n = packing.best_fit(sizes, capacity)
        fills = np.bincount(bins, sizes).astype(int)
        assert n == len(rooms) and sorted(fills) == sorted(capacity - r for r in rooms)
        for b in range(n):
            own = np.argsort(offsets[bins == b])
            assert offsets[bins == b][own].tolist() == [0, *np.cumsum(sizes[bins == b][own])[:-1]]


def brute_components(fps: dict, radius: int) -> dict:
    ids = list(fps)
    label = {i: i for i in ids}
    while True:
        old = dict(label)
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    label[i] = min(label[i], label[j])
        if old == label:
            return label


def test_simhash_classes_equal_brute_force(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.classes(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {}
    for d, t in texts.items():
        h = simhash.hashes(simhash.shingles(simhash.words_of(t), 3)).tolist()
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert dict(zip(got.doc_id, got.fingerprint, strict=True)) == {d: f"{f:016x}" for d, f in fps.items()}
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == brute_components(fps, 2)
    r = {(x.doc_id, x.fingerprint == "0" * 16, x.component_id) for x in simhash.classes(odd).collect()}
    assert {(1, True, 1), (2, True, 1), (3, True, 1)} <= r and len(r) == 7
    assert simhash.classes(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 6])
def test_masks_cover_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & diff for m in masks)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3, 900)).astype(np.uint64), axis=0)
    fp = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2

    def roots(edges):
        label = np.arange(len(fp))
        while True:
            old = label.copy()
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if (old == label).all():
                return label

    points = spark.createDataFrame([(i, int(x.view(np.int64)), 0) for i, x in enumerate(fp)], "node long, fp long, sketch long").cache()
    want = roots(np.argwhere(near))
    for direct in (simhash.DIRECT, 20):
        monkeypatch.setattr(simhash, "DIRECT", direct)
        got = [tuple(r) for r in simhash.links(points, radius=2).collect()]
        assert (roots(got) == want).all() and len(set(want.tolist())) > 1


def test_near_duplicates_by_shingles(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    a, other = text(300), text(300)
    near = [*a[:100], "changed", *a[101:]]
    far = [w if i % 20 else "x" for i, w in enumerate(a)]
    rows = [(1, " ".join(a)), (2, " ".join(a).upper()), (3, " ".join(near)), (4, " ".join(other)), (5, " ".join(far)), (6, None), (7, ""), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, None: None}
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {1, 4, 5, 6, None}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(80):
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    assert got == {n: c for n, c in label.items() if n in got} and len(got) >= 90


def test_decontamination_both_ways(spark, odd, none, sf_dir):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Tiny item!"), (3, None), (4, ""), (5, " ".join(words[:12])), (None, "tiny, ITEM"), (6, "a b " * 10)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " + " ".join(words[2:12]) + " y"), (2, " ".join(words[:11])), (3, "the TINY-item"), (4, " ".join(words[3:12])), (5, None), (6, ""), (7, "!!"), (7, "!!"), (8, "a b " * 12), (None, "tiny item")], "doc_id long, text string"
    )
    want = {1: (12, 10, 2), 2: (11, 11, 2), 3: (3, 2, 1), 4: (9, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0), 8: (24, 24, 1), None: (2, 2, 1)}
    for limit in (1 << 25, 0):
        got = decontam.find(docs, bench, broadcast_bytes=limit).collect()
        assert len(got) == 10 and {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == want
        assert all(r.contaminated == (r.n_hit > 0) for r in got)
        assert decontam.find(odd, bench.limit(0), broadcast_bytes=limit).filter("contaminated").count() == 0
        assert decontam.find(none, bench, broadcast_bytes=limit).count() == 0


def test_decontamination_by_shuffle_equals_sql(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    same(decontam.find(docs, bench, broadcast_bytes=0).toPandas(), connect(sf_dir).sql(decontam.ORACLE).df())


def test_backoff_on_strange_texts(spark, odd, none):
    got = {(r.doc_id, r.n_words): (r.log_score, r.mean_log_score) for r in ngram_lm.scores(odd).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == (0.0, None) and (None, 3) in got
    assert ngram_lm.scores(none).count() == 0
    documents = pd.DataFrame([r[:2] for r in ODD], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    want = duckdb.sql(ngram_lm.ORACLE).df()
    clash = odd.selectExpr("*", "1 as block", "2 as part", "'x' as log_score", "n_tokens as n_words")
    have = ngram_lm.scores(clash, block_bytes=100_000).selectExpr("doc_id", "n_words", "round(log_score, 4) as log_score", "round(mean_log_score, 6) as mean_log_score").toPandas()
    same(have, want)
    assert len(documents) == len(have)


def test_quality_learns_an_order(spark, none):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        g = i % 3
        words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        if g == 0:
            words = [w + "###" for w in words]
        if g == 1:
            words[5] = "idiot"
        rows.append((i, " ".join(words), g))
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(rated.filter("doc_id < 600"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.judge(rated.filter("doc_id >= 600"), model).toPandas()
    p = pd.DataFrame(list(got.quality.map(lambda r: r.asDict())))
    assert (p.keep == (got.grade == 2)).mean() > 0.95
    assert p.expected_grade[got.grade == 0].mean() < p.expected_grade[got.grade == 1].mean() < p.expected_grade[got.grade == 2].mean()
    strange = spark.createDataFrame([(1, None, None), (2, "", 1)], "doc_id long, text string, quality string")
    assert quality.judge(strange.drop("quality"), model).count() == 2
    empty = quality.train(rated.limit(0))
    assert [r.quality.tail_prob for r in quality.judge(rated.limit(2), empty).collect()] == [1.0, 1.0]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "t") for i in range(1, 6)], "doc_id long, text string")
    assert {r.doc_id: r.grade for r in quality.graded(docs, labels).collect()} == {1: 0, 2: 1, 4: 2}


def test_language_models(spark, odd, none, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held.held_out.tolist() == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.rejected.mean() < 0.02
    assert got.score.between(0, 1).all()
    model = langid.train(docs)
    letters = {c for r in docs.select("text").collect() for w in langid._LETTERS.findall(r.text.lower()) for c in w} | {langid.END}
    p = np.exp(-model.models.gram_bits(["\x02th" + c for c in sorted(letters)]))
    assert (p.sum(axis=0) <= 1 + 1e-6).all()
    strange = langid.identify(odd, model).collect()
    assert [r.langid.lang_pred for r in strange if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert langid.identify(spark.createDataFrame([(1, "кириллица здесь совсем другая")], "doc_id long, text string"), model).first().langid.rejected
    assert {r.lang_pred for r in langid.predictions(odd.filter("doc_id = 1")).collect()} == {"und"}
    assert langid.predictions(none).count() == 0


PAGE = """<html><head><title>T</title></head><body><header>Site</header><div class="cookie-banner">We use cookies</div><div id="wrap"><div class="sidebar"><p>Side text that
is quite long here</p></div><div class="content"><h1>Head &amp; line</h1><p>First   para <b>bold</b>text &lt;x&gt;.</p><p>Short.<ul><li>one<li>two</ul><blockquote>quote</blockquote>
<form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script><div class="comments"><p>reader comment long long long long</p></div></div></div><footer>f</footer></body></html>"""


def test_main_text(spark):
    assert html_extract.main_text(PAGE) == "Head & line\nFirst para boldtext <x>.\nShort.\none\ntwo\nquote"
    assert html_extract.main_text("<article><p>a<br>b</article><nav>x</nav>") == "a b"
    assert html_extract.main_text("<nav>only menu</nav>") == "" and html_extract.main_text("plain") == "plain"
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<p>" + "long " * 200_000)], "page_id long, url string, html string")
    got = [(r.page_id, r.n_chars) for r in html_extract.extract(pages).collect()]
    assert (1, 0) in got and (2, 0) in got and got.count((3, 57)) == 2 and (None, 999_999) in got


CHAT = [
    (1, 0, "user", "Hello there my friend, how are you?\nSecond line of the message here"),
    (1, 1, "assistant", "Bob wrote:\n> Hello there my friend, how are you?\n> Second line of the message here\nI am fine, thanks a lot."),
    (1, 2, "user", "> > hello there my  FRIEND, how are you?\n> I am fine, thanks a lot.\nGreat to hear that from you"),
    (1, 3, "assistant", ">> I am fine, thanks a lot.\n\n\n\nok\n> unknown passage never said by anyone"),
    (1, 4, "user", None),
    (1, 5, "user", ""),
    (2, 0, "user", "> I am fine, thanks a lot.\nnot in this conversation"),
    (2, 1, "a", "x"),
    (2, 1, "a", "x"),
    (None, 1, "a", "> not in this conversation"),
    (3, None, "a", "foo bar baz qux"),
    (2, 2, None, "Para one is long enough\n\nPara two is long enough"),
    (2, 3, "u", "> Para two is long enough\r\nyes"),
    (2, 4, "u", ">not in this conversation\n>> Para one is long enough"),
]


def test_quotation_links(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHAT], "conv_id long, turn long, role string, text string, depth int")
    got = chat.format_chat(df).toPandas()
    conversations = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    same(got, duckdb.sql(chat.ORACLE).df())
    assert len(conversations) == len(got)
    one = got[got.conv_id == 1].sort_values("turn")
    assert one.parent_turn.fillna(-1).tolist() == [-1, 0, 1, 1, -1, -1] and one.depth.tolist() == [0, 1, 2, 2, 0, 0]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_short_quotes_of_whole_messages_link(spark):
    rows = [(1, 0, "u", "How old?"), (1, 1, "a", "Nine\nYes, please"), (1, 2, "u", "> How old?\nas said"), (1, 3, "u", ">yes, PLEASE"), (1, 4, "u", "ok"), (1, 5, "a", ">\n> \nempty quotes"), (1, 6, "a", "> OK\n>> How old?")]
    got = {r.turn: r.parent_turn for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: None, 5: None, 6: 4}  # one line of a message is no whole message


def random_thread(rng: random.Random, conv: int, turns: int) -> list[tuple]:
    """Messages that quote earlier ones, quotes and all, whole or in part."""
    words = ("yes", "no", "well", "the box was opened", "Nobody knew", "and then?", "écrit", "à bientôt")
    rows = []
    for turn in range(turns):
        lines = []
        for _ in range(rng.randint(0, 3)):
            if rows and rng.random() < 0.7:
                old = (rng.choice(rows)[3] or "").split("\n")
                part = old if rng.random() < 0.5 else old[rng.randrange(len(old)) :][: rng.randint(1, 3)]
                if rng.random() < 0.3:
                    lines.append("Ann wrote:")
                lines += [rng.choice((">", "> ", " > ")) + x for x in part]
            else:
                lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))))
            if rng.random() < 0.2:
                lines.append("")
        rows.append((conv, turn, rng.choice(("user", "assistant")), None if rng.random() < 0.03 else "\n".join(lines)))
    return rows


def test_nested_quotes_equal_sql(spark):
    rng = random.Random(9)
    rows = [r for c in range(60) for r in random_thread(rng, c, rng.randint(1, 25))]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    same(got, duckdb.sql(chat.ORACLE).df())
    assert len(conversations) == len(got) and got.parent_turn.notna().sum() > 150 and got.depth.max() >= 3


def test_neighbours_recall_and_order(spark, sf_dir):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e).toPandas()
    x, ids = np.array([r.embedding for r in e.collect()], dtype=float), np.array([r.vec_id for r in e.collect()])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all() and q not in set(g.vec_id)
    assert hit / len(got) > 0.9


def test_neighbours_of_strange_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 1.0]), (20, [0.0, 3.0]), (None, [1.0, 1.0]), (9, []), (40, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, rank int, vec string")
    got = ann.search(df).orderBy("query_id", "rank").collect()
    own = [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (0, 4, 8, -1.0), (20, 1, 8, 3.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [*own, (40, 1, 7, 1.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_tie_to_the_smaller_id(spark):
    """Hundreds of equal vectors at odd places of their shards: the smallest ids win."""
    rng = np.random.default_rng(4)
    base, rows = rng.normal(size=64), []
    for i in range(3000):
        rows.append((i, (base if i % 7 == 3 else rng.normal(size=64) * 0.5).astype(np.float32).tolist()))
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=700).filter("query_id % 140 = 80").toPandas()
    alike = [i for i in range(3000) if i % 7 == 3]
    assert len(got) == 20 * 21
    for q, g in got.groupby("query_id"):
        own = [i for i in alike if i != q][:20]
        if q % 7 == 3:
            assert g.sort_values("rank").vec_id.tolist() == own and g.score.nunique() == 1


def test_neighbours_by_regions(spark):
    """Clustered vectors: few regions are visited, and the recall holds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    how = dict(pivots=64, block=128, length=32, share=0.5, at_least=40)
    known = ann.spaces(ann.usable(df, "vec_id", "embedding"), pivots=64, sample=2048, block=128, is_query="vec_id % 20 = 0")
    ann.calibrate(ann.usable(df, "vec_id", "embedding"), known, is_query="vec_id % 20 = 0", k=20, within=0.98, tried=256)
    assert 1 <= known[16].visits < known[16].regions / 2
    hit = total = 0
    for q, g in ann.search(df, **how).toPandas().groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        total += 20
    assert total == 300 * 20 and hit / total > 0.9


def test_pipeline_against_its_operators(spark):
    """run() equals its stages by hand: kept sets by brute force on each stage's own input."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == columns and {r.doc_id for r in kept.collect()} <= set(before)
        after = {r.doc_id for r in kept.collect()}
        if name == "near_duplicates":
            sets = {d: set(simhash.shingles(simhash.words_of(t), 5)) for d, t in before.items()}
            first = {d: d for d in sets}  # the smallest document that links lead to, by all pairs
            linked = [(x, y) for x in sets for y in sets if x < y and 5 * len(sets[x]) >= 4 * len(sets[y]) >= 3.2 * len(sets[x]) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
            for _ in sets:
                old = dict(first)
                for x, y in linked:
                    first[x] = first[y] = min(first[x], first[y])
                if old == first:
                    break
            assert after == {d for d in sets if first[d] == d} and len(after) < len(before)
        if name == "decontamination":
            items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in decontam.windows_of(decontam.words_of(r.text), 10)]
            dirty = {d for d, t in before.items() if any(w in set(decontam.windows_of(decontam.words_of(t), len(w))) for w in items)}
            assert after == set(before) - dirty
    got = c.run(spark, sf).toPandas()
    check_packing(got, [(r.doc_id, r.text) for r in kept.collect()])
    assert P.path("word_bpe_49k.json") == registry.PACK_VOCABULARY
