"""Main text: path scores against a brute-force version, parts judged by their text, time that grows with the page only."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from timeweave.llm import html_main

SIX = "<p>A paragraph of history, long enough, with marks, and so on, it goes.</p>" * 6
PLAIN = html_main.main_text(f"<body><div>{SIX}</div></body>")


def random_tree(rng: random.Random, depth: int = 0) -> list:
    """Children: texts, or (name, children)."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 5 and rng.random() < 0.6:
            out.append((rng.choice(["div", "section", "b", "a", "span"]), random_tree(rng, depth + 1)))
        else:
            out.append(" ".join(rng.choice(["word", "so,", "end.", "(aside)", "long-ish"]) for _ in range(rng.randrange(1, 9))))
        out.append("<br>")
    return out


def markup(tree: list) -> str:
    return "".join(x if isinstance(x, str) else f"<{x[0]}>{markup(x[1])}</{x[0]}>" for x in tree)


def leaves(tree: list, path: tuple = ()):
    for x in tree:
        if isinstance(x, str):
            yield path, x.replace("<br>", "")
        else:
            yield from leaves(x[1], (*path, x[0]))


def brute_scores(tree: list, window: int) -> dict[tuple, float]:
    runs = defaultdict(list)
    for path, text in leaves(tree):
        if text:
            runs[path].append(text)
    plain = []
    for path, texts in runs.items():
        size = sum(len(t.replace(" ", "")) for t in texts)
        marks = sum(c in html_main.PUNCTUATION for t in texts for c in t)
        plain.append(0.0 if "a" in path else size * (1 + marks) / len(texts))
    out = {}
    for k, path in enumerate(runs):
        near = plain[max(0, k - window) : k + window + 1]
        out[path] = max(plain[k], (plain[k] + sum(near) / len(near)) / 2) if plain[k] else 0.0
    return out


def test_path_scores_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        tree = random_tree(rng)
        page = html_main.read(markup(tree))
        names = {}
        for n, name in enumerate(page.names):
            names[n] = (*names[page.parents[n]], name) if n else ()
        by_number = {page.paths[n]: path for n, path in names.items()}
        assert len(set(by_number.values())) == len(by_number)
        got = {by_number[p]: s for p, s in html_main.path_scores(page, html_main.Ratios()).items()}
        assert got == pytest.approx(brute_scores(tree, 2))


def test_comments_are_known_by_their_names_and_by_their_form():
    items = '<div class="c"><span>Ann Lee</span><p>I like this, a lot, really, and there is more to say.</p></div>' * 5
    for part in (f'<div class="user-posts">{items}</div>', f'<div id="commentsArea">{items}</div>', f"<section>{items}</section>"):
        assert html_main.main_text(f"<body><div>{SIX}</div>{part}</body>") == PLAIN
        assert html_main.main_text(f"<body><article>{SIX}{part}</article></body>") == PLAIN
    faq = '<div class="c"><p>Is it so?</p><p>I like this, a lot, really, and there is more to say.</p></div>' * 5
    sections = "<section><h2>Part</h2><p>I like this, a lot, really, and there is more to say.</p></section>" * 3
    assert html_main.main_text(f"<body><div>{SIX}{faq}{sections}</div></body>").count("I like this") == 8
    assert html_main.main_text(f"<body><div>{items}</div></body>").count("Ann Lee") == 5  # all there is


def test_named_parts_that_read_like_the_article_stay():
    assert html_main.main_text(f'<body><div>{SIX}<section class="social history">{SIX}</section></div></body>') == f"{PLAIN} {PLAIN}"
    assert html_main.main_text(f'<body><article>{SIX}<section class="social history">{SIX}</section></article></body>') == f"{PLAIN} {PLAIN}"
    for part in ('<div class="promo box"><p>Buy, now, and, here, or never, do.</p></div>', '<div class="related"><p>One, more.</p><p>Two, more.</p><p>Three.</p></div>'):
        assert html_main.main_text(f"<body><article>{SIX}{part}</article></body>") == PLAIN
        assert html_main.main_text(f"<body><div>{SIX}{part}</div></body>") == PLAIN


def test_tables_of_contents_go_and_other_lists_stay():
    listed = "<ul><li><a href='{0}a'>One</a><li><a href='{0}b'>Two</a><li><a href='{0}c'>Three</a></ul>"
    assert html_main.main_text(f"<body><article>{listed.format('#')}{SIX}</article></body>") == PLAIN
    assert html_main.main_text(f"<body><article>{SIX}{listed.format('/')}</article></body>") == f"{PLAIN} One Two Three"


@pytest.mark.parametrize("piece", ["<b>word ", "<div>word, ", "<form>w ", "<p><b>x", '<div class="ad">t, ', "<li>a<ul>", "</i><b>w "])
def test_time_grows_with_the_page_not_with_its_depth(piece):
    began = time.monotonic()
    html_main.main_text(piece * 40_000)
    assert time.monotonic() - began < 5
