"""The region follows the content lines, not a tag's name."""

import math
import random
from unittest import mock

import numpy as np
import pytest

from voxelake.llm import html_extract
from voxelake.llm.html_extract import main_text

LONG = [f"Paragraph {i} holds a good many words so that its ratio of text to tags is high enough to count." for i in range(9)]
P = [f"<p>{x}</p>" for x in LONG]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_text_beside_teasers_stays(tag):
    got = main_text(f"<body><div>{''.join(P[:5])}</div><{tag}>{''.join(P[5:])}</{tag}></body>")
    assert got.split("\n") == LONG


def test_headline_and_lead_outside_the_body_block_stay():
    page = f"<div><div class=post><h1>Head</h1><div class=body>{''.join(P[:8])}</div></div><nav>menu</nav></div>"
    assert main_text(page).split("\n") == ["Head", *LONG[:8]]
    page = f"<div class=post><div class=lead>{''.join(P[:3])}</div><div class=body>{''.join(P[3:])}</div></div>"
    assert main_text(page).split("\n") == LONG


def test_article_decides_between_blocks_that_hold_the_content():
    page = f"<div><article><p>by <a>A</a> <a>B</a> <a>C</a></p><div>{''.join(P)}</div></article><ul><li><a>x</a><li><a>y</a></ul></div>"
    assert main_text(page).split("\n") == ["by A B C", *LONG]
    assert main_text("") == "" and main_text("<p>0.1</p>" * 3).split("\n") == ["0.1"] * 3


def test_links_around_the_content_go_by_their_ratio():
    """No article, no names: only the ratio tells the links from the text."""
    links = "".join(f"<li><a href=/{i}><b>l{i}</b></a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div>{''.join(P)}</div><div><ul>{links}</ul></div></body>"
    assert main_text(page).split("\n") == LONG
    with mock.patch.object(html_extract, "smooth", lambda x, sigma: np.ones(len(x))):
        assert main_text(page).split("\n") != LONG


def test_names_drop_containers_only():
    kept = ["Head", "What others did", "A way to find things, step by step, told at some length here.", "Talk to us."]
    page = f"<article><h1>Head</h1><h2 id=related-work>{kept[1]}</h2><section id=search-methods><p>{kept[2]}</p></section><p class=social>{kept[3]}</p>{''.join(P)}<div class='ad-slot'>Buy now</div><div id=relatedPosts><a>x</a></div></article>"
    assert main_text(page).split("\n") == [*kept, *LONG]
    assert main_text(f"<div class=widget>{''.join(P)}</div><p>end</p>").split("\n") == LONG  # a name that holds most of the page


def test_deep_and_stray_markup_takes_time_by_its_length():
    assert len(main_text("<div>x" * 170_000)) == 2 * 170_000 - 1
    assert len(main_text("<ul><li>" + "<div>" * 50_000 + "<li>a" * 50_000 + "</span></i></p>" * 50_000)) == 99_999


def random_page(rng: random.Random) -> tuple[str, list]:
    """A page of nested blocks, and its lines (text, tags since the last line, the path of block numbers)."""
    html, lines, state = [], [], {"tags": 0, "n": 0}

    def put(tag: str) -> None:
        html.append(tag)
        state["tags"] += 1

    def block(path: tuple) -> None:
        state["n"] += 1
        path = (*path, state["n"])
        put("<div>")
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.35 and len(path) < 5:
                block(path)
            else:
                put("<p>")
                for _ in range(rng.choice((0, 0, 0, 3))):
                    put("<i>"), put("</i>")
                text = " ".join(rng.choice(("a", "word", "&amp;", "sentences")) for _ in range(rng.choice((1, 2, 30, 60))))
                html.append(text)
                lines.append((text.replace("&amp;", "&"), state["tags"], path))
                state["tags"] = 0
                put("</p>")
        put("</div>")

    for _ in range(rng.randint(1, 4)):
        block(())
    return "".join(html), lines


def by_hand(lines: list, sigma: float = 1.0) -> str:
    ratio = [len(t) / max(1, n) for t, n, _ in lines]
    even = []
    for i in range(len(ratio)):
        weight = {j: math.exp(-0.5 * ((i - j) / sigma) ** 2) for j in range(len(ratio)) if abs(i - j) <= 3}
        even.append(sum(w * ratio[j] for j, w in weight.items()) / sum(weight.values()))
    mean = sum(even) / len(even)
    limit = min(40.0, 0.5 * math.sqrt(sum((x - mean) ** 2 for x in even) / len(even)))
    paths = [p for x, r, (_, _, p) in zip(even, ratio, lines, strict=True) if x >= limit - 1e-12 and r >= limit - 1e-12]
    region = paths[0]
    while not all(p[: len(region)] == region for p in paths):
        region = region[:-1]
    return "\n".join(t for t, _, p in lines if p[: len(region)] == region)


def test_equals_a_reading_by_hand():
    rng = random.Random(21)
    pages = [random_page(rng) for _ in range(400)]
    assert [main_text(html) for html, _ in pages] == [by_hand(lines) for _, lines in pages]
    assert sum(len(by_hand(lines).split("\n")) < len(lines) for _, lines in pages) > 40


def test_columns_whose_names_clash(spark):
    rows = [(1, "u", "<p>x</p>", "text", 5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert [tuple(r) for r in got.collect()] == [(1, "u", "x", 1)]
