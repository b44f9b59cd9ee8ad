"""Pages as generators make them: ids made of words, formulas, and a large host of which half has no article element."""

import collections
import random

import numpy as np
import pytest

from gaugeflow.llm import html_text


def text_of(page):
    blocks = html_text.blocks_of(page)
    words = [html_text.words_in(z, t, 8) for z, t in blocks]
    return html_text._keep(blocks, words, np.zeros(sum(map(len, words)), bool))[0]


WORDS = "login comments menu ads notice share footer sidebar search related newsletter cookie banner alert nav".split()


@pytest.mark.parametrize("word", WORDS)
def test_ids_of_running_text_say_nothing(word):
    title = word.capitalize()
    page = f"<article><h2 id='{word}'>{title} of C</h2><p id={word}>about {word}</p><ul><li id='{word}'>item {word}</li></ul><dl><dt id={word}>term</dt><dd id={word}>said</dd></dl><table><tr><td id={word}>cell</td></tr></table><blockquote id={word}>quoted</blockquote><pre id={word}>code</pre><h3><a id={word}></a>{title}</h3></article>"
    assert text_of(page).split("\n") == [f"{title} of C", f"about {word}", f"item {word}", "term", "said", "cell", "quoted", "code", title]
    assert text_of(f"<h2 id='{word}'>{title}</h2><p>open page</p>") == f"{title}\nopen page"


def test_what_a_class_or_a_container_says_still_counts():
    page = "<article><h2 id=comments>Comments in C</h2><p class=ad>buy</p><p class='notice'>old</p><li class='comment-item'>troll</li><div id=comments><p>reader</p></div><section id=menu>soup</section><ul id=login><li>x</ul><p class=menu>soup of the day</p></article>"
    assert text_of(page) == "Comments in C\nsoup of the day"


def test_formulas_are_text_and_drawings_are_not():
    page = "<article><p>x &lt; y <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>E=mc^2</annotation></semantics></math> holds <svg><text>drawn</text></svg>here</p></article>"
    assert text_of(page) == "x < y E=mc2 holds here"
    assert text_of("<article><p>x &lt; y <math>E = mc2</math> holds</p></article>") == "x < y E = mc2 holds"


def brute_text(rows, depth):
    """(text, words taken by runs) of each page: a run counts if another page of the host has it too."""
    parsed = {k: html_text.blocks_of(p) for k, _, p in rows}
    stream = {k: [w for z, t in b for w in html_text.words_in(z, t, depth)] for k, b in parsed.items()}
    holders = collections.Counter()
    for k, host, _ in rows:
        holders.update({(host, tuple(stream[k][i : i + depth])) for i in range(len(stream[k]) - depth + 1)})
    out = {}
    for k, host, _ in rows:
        w = stream[k]
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - depth + 1):
            if holders[host, tuple(w[i : i + depth])] > 1:
                gone[i : i + depth] = True
        out[k] = html_text._keep(parsed[k], [html_text.words_in(z, t, depth) for z, t in parsed[k]], gone)
    return out


def test_a_large_host_of_which_half_has_no_article(spark):
    rnd = random.Random(21)
    notes = [" ".join(f"note{k}w{i}" for i in range(rnd.randint(3, 20))) for k in range(60)]
    rows = []
    for k in range(3000):
        own = " ".join(rnd.choice(["alpha", "beta", "gamma", f"w{k}", f"x{rnd.randrange(500)}"]) for _ in range(rnd.randint(5, 60)))
        top, foot = rnd.choice(notes), rnd.choice(notes)
        title = f"<h1 id='{rnd.choice(WORDS)}'>Title {k}</h1>"
        body = f"{title}<p>{own}</p>"
        page = f"<div>{top}</div>{body}<div>{foot}</div>" if k % 2 else f"<nav>{top}</nav><article>{body}<div class=share-bar>{foot}</div><p>{top}</p></article>"
        rows.append((k, "big.org", page))
    expected = brute_text(rows, html_text.PASSAGE)
    pages = spark.createDataFrame([(k, f"http://{h}/{k}", p) for k, h, p in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.run_words) for r in html_text.extract_text(pages, group_pages=700).collect()}
    assert got == expected
    taken = [n for _, n in expected.values()]
    assert sum(n > 0 for n in taken) > 2000 and sum(taken) > 30_000
    # In pages without an article a run may take the word before a number that is theirs alone.
    assert all(f"Title {k}" in expected[k][0] for k in range(0, 3000, 2)) and all(str(k) in expected[k][0] for k in range(3000))
