"""URL filter, HTML extraction, license scan, nearest neighbours and the pipeline."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import ann, graph, html_text, license_scan, oracles, queries, url_filter
from gaugeflow.llm.common import cut
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_license_scan", "op10_substring_dedup"])
def test_query_equals_sql(spark, name):
    ours, theirs = same_as_sql(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://z.example.org/es/q">'),
    (2, "https://b.net/", "<meta http-equiv=refresh content='0; url=http://a.net/x#t'>"),
    (3, "http://c.net/", '<LINK href="/k" rel=canonical>'),
    (4, None, None),
    (5, "http://q.org/1", '<link rel=canonical href="//z.de.com/de/1">'),
    (6, "http://z.de.com/de/9", '<link rel=canonical href="1">'),
    (7, "http://w.net", "<link rel='canonical' href='https://q.org/1'>"),
    (8, "no scheme", ""), (9, "http://NOTorg/", ""), (10, "x://Org?q://y", ""), (10, "x://Org?q://y", ""), (None, "http://x.ORG/p?a#b", ""),
]


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, rule string")
    got = [tuple(r) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()]
    by_id = {r[0]: r[1:5] for r in got}
    assert len(got) == len(PAGES)
    assert by_id[1] == ("a.net", "/x", None, "block") and by_id[2][3] == "block"
    assert by_id[3] == ("c.net", "/", None, "allow") and by_id[4] == ("", "", None, "allow") and by_id[8] == ("", "", None, "allow")
    assert by_id[5] == ("q.org", "/1", "org/", "allow") and by_id[6] == ("z.de.com", "/de/9", "com/de/", "block")
    assert by_id[7] == ("w.net", "", None, "allow"), "an explicitly allowed alias goes before a blocked one"
    assert by_id[9] == ("notorg", "/", None, "allow") and by_id[10] == ("org", "", None, "allow") and by_id[None] == ("x.org", "/p", "org/", "allow")
    more = spark.createDataFrame([("http://c.net/", "http://a.net/x"), (None, "http://a.net/x")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, queries.URL_RULES, more).collect()}[3] == "block"
    assert url_filter.judge_urls(pages.where("false"), queries.URL_RULES).collect() == []
    with pytest.raises(ValueError):
        url_filter.rule_for(F.lit("a"), F.lit("/"), [("maybe", "x/")])
    oracle = oracles.url_filter(queries.URL_RULES)
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(db.execute(oracle).fetchall(), key=key) == sorted(got, key=key)


def test_long_rule_lists_are_joined(spark, monkeypatch):
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "", "com"]
    paths = ["", "/", "/x", "/x/y", "/xyz", "/x/y/z.html"]
    rules = [(("allow", "block")[(len(h) + len(p)) % 2], h + p) for h in ("a.com", "b.a.com", "com", "org", "zz.com") for p in ("/", "/x", "/x/y/", "/x/y")]
    rules += [("block", "a.com/x"), ("allow", "a.com/x"), *(("block", f"h{k}.net/") for k in range(300))]
    urls = spark.createDataFrame([(h, p, k) for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)] * 2 + [("h7.net", "/q", 99)], "host string, path string, k int")
    by_join = sorted(map(tuple, url_filter.with_rules(urls, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "RULES_IN_PLAN", 1_000)
    assert by_join == sorted(map(tuple, url_filter.with_rules(urls, rules).collect()), key=str)
    assert ("h7.net", "/q", 99, "h7.net/", "block") in by_join


def test_links_are_decoded_and_resolved(spark):
    tags = {"/b?x=1&amp;y=2": "http://h.net/b?x=1&y=2", "c&#47;d&#x2f;&#200;": "http://h.net/p/c/d/&#200;", "../up/./q": "http://h.net/up/q", "./": "http://h.net/p/", "../../..": "http://h.net/", "a/../b/..?q": "http://h.net/p/?q", "//o.net/a/../b#f": "http://o.net/b#f", "x.y/..z": "http://h.net/p/x.y/..z"}
    pages = spark.createDataFrame([("http://h.net/p/page", f'<link rel="canonical" href="{t}">') for t in tags], "url string, html string")
    assert sorted(r.target for r in url_filter.alias_links(pages).collect()) == sorted(tags.values())


def test_components_of_chains_and_hubs(spark):
    rnd = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(1, 700)] + [(1000, k) for k in range(1001, 1400)] + rnd.integers(2000, 2300, (200, 2)).tolist()
    own = {}

    def root(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        own[hi] = lo
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*map(tuple, edges), (None, 3), (7, 7)], "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b or x in got}


def test_main_text_of_given_pages(spark):
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, f"{DATA}/sf0.001").collect()}
    for p in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<(?:/?p|/?h1)>", inner))
        text = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == text and got[p.page_id].n_chars == len(text)


CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a &lt; b&nbsp;&amp; c", "a < b & c"), ("<p>x<p>y", "x\ny"),
    ("<nav>menu</nav><article><h1>T</h1>body<div class='ad'>buy</div><form>f</form><p>end</article><footer>f</footer>", "T\nbody\nend"),
    ("<script>var a='<p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
    ("<main><p>in</p><section id=comments><p>troll</p></section></main><aside>side</aside>", "in"),
    ("<nav><ul><li>never closed<article><p>in</p></article>", "in"),
    ("<article><p>a<br>b</p><div role=navigation>n</div></article>outside", "a b"),
    ("<title>t</title><p hidden>h</p><p data-hidden-x>v", "v"), ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<html class='no-sidebar menu'><body class='has-sidebar nav'><article class=share><p>in</article>", "in"), ("<body id=menu><p>x", "x"),
    ("<div class='layout with-nav'><p>x<div class=nav>n</div></div>", "x"), ("<main class='main comments'><p>in</main>", "in"),
    ("<div class='sidebar page'><p>out</p><div><article><p>in<div class=related><article>other</article></div></article></div><p>out</p></div>", "in\nother"),
    ("<div class=related><article>other</article></div><article><p>in</article>", "in"),
    ("<div id=widget><article>a</article></div><div id=widget><article>b</article></div>", "a\nb"),
    ("<article><p title='the hidden truth'>a</p><p><a href='/x?id=login'>b</a> <a href=/x?class=ad>c</a></p><p data-x=\"role='menu'\">d</p><p HIDDEN>e</p><p x=1 Class = ad>f</p></article>", "a\nb c\nd"),
    ("<article><p class=share-price>a</p><p id='related-work'>b</p><div class='menu-planning'>c</div><p class=search-results>d</p></article>", "a\nb\nc\nd"),
    ("<article><p>a</p><ul class='comment-list'><li>x</ul><div class=ad-box>x</div><div class='cookie-notice'>x</div><form>x</form><div id=sidebar>x</div><p class=notice>x</p>b</article>", "a\nb"),
    ("<article><p>a <span class=ad>x</span> b <i class=share-price>c</i> d <span class=ad>x<p>y</span>z</article>", "a b c d\nz"),
    ("<p>a <span class=sponsor>x</span>b", "a b"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_blocks(page, text):
    blocks = html_text.blocks_of(page)
    words = [html_text.words_in(z, t, 8) for z, t in blocks]
    assert html_text._keep(blocks, words, np.zeros(sum(map(len, words)), bool)) == (text, 0)


def test_long_and_broken_pages_are_parsed_in_little_time():
    start = time.time()
    assert html_text.blocks_of("<svg>" * 20_000 + "<p>x") == [(html_text.OPEN, "x")]
    assert html_text.blocks_of("<nav>" * 50_000 + "a") == [(html_text.BOILER, "a")]
    long = "<p>" + "word " * 400_000
    assert len(html_text.blocks_of(long)[0][1]) == 5 * 400_000 - 1
    assert len(html_text.blocks_of("<p>a" * 100_000)) == 100_000
    assert time.time() - start < 20


def brute_text(pages, depth):
    """(text, words taken by runs) of each page by sets of runs of each page."""
    parsed = {k: html_text.blocks_of(p) for k, _, p in pages}
    stream = {k: [w for z, t in b for w in html_text.words_in(z, t, depth)] for k, b in parsed.items()}
    runs = {k: {tuple(w[i : i + depth]) for i in range(len(w) - depth + 1)} for k, w in stream.items()}
    host = {k: h for k, h, _ in pages}
    out = {}
    for k, w in stream.items():
        gone = np.zeros(len(w), bool)
        others = set().union(*(runs[j] for j in runs if j != k and host[j] == host[k]))
        for i in range(len(w) - depth + 1):
            if tuple(w[i : i + depth]) in others:
                gone[i : i + depth] = True
        out[k] = html_text._keep(parsed[k], [html_text.words_in(z, t, depth) for z, t in parsed[k]], gone)
    return out


def test_mixed_hosts_are_the_same_at_any_group_size(spark):
    """Open pages, article pages and articles with open elements, whose tags and names say nothing of what repeats."""
    rnd = random.Random(11)
    notes = [" ".join(f"note{k}w{i}" for i in range(rnd.randint(2, 12))) for k in range(12)]
    rows = []
    for k in range(150):
        own = " ".join(f"p{k}w{i}" for i in range(rnd.randint(3, 30)))
        a, b = rnd.choice(notes), rnd.choice(notes)
        kind = k % 3
        page = f"<div>{a}</div><p>{own}</p><div>{b}</div>" if kind == 0 else f"<article><p>{own}</p><p>{a}</p></article>" if kind == 1 else f"<article><p>{own}</p><div class=share-bar>{a}</div><div class='related-note'>only here {k}</div></article>"
        rows.append((k, f"http://h{k % 2}.com/{k}", page))
    expected = brute_text([(k, u.split("/")[2], p) for k, u, p in rows], html_text.PASSAGE)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (1, 4, 2000):
        got = {r.page_id: (r.text, r.run_words) for r in html_text.extract_text(pages, group_pages=group).collect()}
        assert got == expected
    assert sum(n > 0 for _, n in expected.values()) > 60
    assert all(f"only here {k}" in expected[k][0] for k in range(2, 150, 3))

def test_repeated_against_all_substrings():
    rnd = random.Random(7)
    for _ in range(60):
        page = np.sort(np.array([rnd.randrange(4) for _ in range(60)]))
        tokens = np.array([rnd.randrange(3) for _ in range(60)], dtype=np.uint64)
        depth = rnd.randint(1, 6)
        expected = np.zeros(60, bool)
        runs = {}
        for i in range(60 - depth + 1):
            if page[i] == page[i + depth - 1]:
                runs.setdefault(tuple(tokens[i : i + depth].tolist()), []).append(i)
        for at in runs.values():
            if len({page[i] for i in at}) > 1:
                for i in at:
                    expected[i : i + depth] = True
        assert (html_text.repeated(tokens, page, depth) == expected).all()
        order, rank = html_text.suffix_array(tokens, depth)
        keys = [tuple(tokens[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys)


def test_suffix_array_of_alphabets_of_any_size():
    rnd = random.Random(12)
    for letters in (1, 2, 90, 10_000, 1 << 62):
        for n in (0, 1, 5, 700):
            tokens = np.array([rnd.randrange(letters) if rnd.random() < 0.3 else 0 for _ in range(n)], dtype=np.uint64)
            for depth in (1, 2, 7, 16, 25):
                keys = [tuple(tokens[i : i + depth].tolist()) for i in range(n)]
                order, rank = html_text.suffix_array(tokens, depth)
                assert order.tolist() == sorted(range(n), key=keys.__getitem__)
                number = {key: k for k, key in enumerate(sorted(set(keys)))}
                assert rank.tolist() == [number[key] for key in keys]


@pytest.mark.parametrize("group", [2000, 4])
def test_host_boilerplate(spark, group):
    boiler = "Welcome to our great site read more news every single day here"
    rows = [(k, f"http://h.com/{k}", f"<body><div>{boiler}</div><div>only page {k} says {k * 7} things like {k * 3}</div>") for k in range(30)]
    rows += [(100, "http://other.com/", f"<div>{boiler}</div>"), (None, None, None), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = html_text.extract_text(pages, group_pages=group).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "3 says 21 things like 9" or text[3] == "only page 3 says 21 things like 9"
    assert text[100] == boiler and text[None] == ""
    assert html_text.extract_text(pages.where("false")).collect() == []


def test_host_boilerplate_of_article_pages(spark):
    shared = [f"the passage of article number {k} stands on one more page" for k in range(12)]
    rows = [(k, f"http://h.com/{k}", f"<article><p>{shared[k]}</article>") for k in range(12)]
    rows += [(100 + k, f"http://h.com/{100 + k}", f"<p>own{k}</p><p>{shared[k]}") for k in range(12)]
    rows += [(200, "http://other.com/", f"<p>{shared[0]}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [{r.page_id: r.text for r in html_text.extract_text(pages, group_pages=g).collect()} for g in (2000, 4)]
    assert texts[0] == texts[1]
    assert all(texts[0][k] == shared[k] and texts[0][100 + k] == f"own{k}" for k in range(12)) and texts[0][200] == shared[0]


def test_license_places_and_partial_matches(spark):
    texts = [
        (1, "Under the MIT license; again: mit-LICENSE. Apache  license\nGNU General Public License"), (2, None), (3, ""), (4, "CC BY-NC 4.0. Licensed under CC BY-NC"), (None, "mit license"),
        (5, "permission is hereby granted, free of charge, to any other person obtaining a copy of this software"), (5, "permission is hereby granted, free of charge, to any other person obtaining a copy of this software"),
        (6, "mit ليسانس license"), (7, "gnu general public license version 2"), (8, "x " * 50000 + "mit license"),
    ]
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in texts], "doc_id long, text string, n_words int, template string")
    got = {}
    rows = license_scan.scan_licenses(docs).collect()
    for r in rows:
        got[r.doc_id] = r
    assert len(rows) == len(texts)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 2, 9, "apache,gpl,mit")
    assert got[2].n_words == 0 and got[2].score == 0.0 and got[2].first_word is None and got[3].labels == ""
    assert got[4].labels == "cc-by,cc-by-nc" and got[4].n_base == 2 and got[None].base_labels == "mit"
    assert got[5].labels == "mit-grant" and 0.8 < got[5].score <= 1 and got[5].n_base == 0
    assert got[6].n_base == 0 and got[7].labels == "gpl,gpl-2.0" and got[8].first_word == 50000
    assert license_scan.scan_licenses(docs.where("false")).collect() == []


def test_whole_license_texts(spark):
    text = dict((label, t) for t, label in license_scan.TEXTS)
    mit = text["mit"].split()
    rnd = np.random.default_rng(5)
    edited = [w for k, w in enumerate(mit) if k not in (20, 90)]
    edited[50] = "otherwise"
    scattered = [x for k in range(0, len(mit) - 3, 3) for x in (*mit[k : k + 3], *["filler"] * 9)]
    shuffled = [x for k in rnd.permutation(len(mit) // 3) for x in mit[3 * k : 3 * k + 3]]
    rows = [*((k, "Copyright (c) someone. " + t) for k, t in enumerate(text.values())), (100, " ".join(edited)), (101, " ".join(scattered)), (102, " ".join(shuffled)), (103, " ".join(mit[:40])), (104, "Copyright. " * 4000 + text["isc"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for k, label in enumerate(text):
        assert label in got[k].labels.split(",") and got[k].score == 1.0
    assert "mit" in got[100].labels.split(",") and "mit" not in got[103].labels.split(",")
    assert all(got[k].labels == "" and got[k].score < 0.5 for k in (101, 102))
    assert got[103].labels == "mit-grant" and "isc" in got[104].labels.split(",")
    assert "bsd-2-clause" not in got[list(text).index("bsd-3-clause")].labels
    # Each score again, by counting in plain Python.
    phrases = [license_scan.template_words(t) for t, _ in [*license_scan.BASE, *license_scan.FURTHER]]
    for k, t in rows:
        w = license_scan.template_words(t)
        best = 0.0
        for p in phrases:
            g = min(3, len(p))
            at = {}
            for i in range(len(p) - g + 1):
                at.setdefault(tuple(p[i : i + g]), []).append(i)
            hits = [(j - i, i) for j in range(len(w) - g + 1) for i in at.get(tuple(w[j : j + g]), ())]
            bands = [(sum(d <= e <= d + len(p) // 16 for e, _ in hits), -d) for d in {d for d, _ in hits}]
            if bands:
                d = -max(bands)[1]
                best = max(best, len({i + x for e, i in hits if d <= e <= d + len(p) // 16 for x in range(g)}) / len(p))
        assert abs(best - got[k].score) < 1e-12


def test_recall_against_all_products(spark):
    df = queries.op2_cross_polytope_ann(spark, f"{DATA}/sf0.001")
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    e = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hit = total = 0
    for i in range(len(ids)):
        if ids[i] % 20:
            continue
        score = x @ x[i]
        best = [ids[k] for k in np.lexsort((ids, -score)) if k != i][:20]
        mine = sorted(got[ids[i]])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert all(abs(s - score[list(ids).index(v)]) < 1e-12 for _, v, s in mine)
        hit += len(set(best) & {v for _, v, _ in mine})
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("lengths", ["one long", "spread"])
def test_recall_of_unequal_lengths(spark, lengths):
    e = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    scale = np.random.default_rng(1).lognormal(0, 0.3, len(x)) if lengths == "spread" else np.where(np.arange(len(x)) == 5, 3.0, 1.0)
    x *= scale[:, None]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    found = ann.nearest(df, F.col("vec_id") % 20 == 0)
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    best = ([ids[k] for k in np.lexsort((ids, -s)) if k != i][:20] for i, s in zip(asked, x[asked] @ x.T))
    recall = [len(got[ids[i]] & set(b)) / 20 for i, b in zip(asked, best)]
    print(lengths, np.mean(recall), min(recall))
    assert np.mean(recall) >= 0.93 and min(recall) >= 0.6


@pytest.mark.parametrize(("kind", "most"), [("given", 0.4), ("clustered", 0.1)])
def test_share_of_vectors_compared(spark, kind, most):
    """Recall and the share of all vectors that a query meets, with the tuned number of axes and probes.

    The given vectors have no structure: a query's 20th neighbour has a cosine of 0.28.
    """
    rnd = np.random.default_rng(3)
    x = np.stack(spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas().embedding).astype(float)
    if kind == "clustered":
        x = rnd.normal(size=(50, 64))[rnd.integers(0, 50, 2000)] + 0.5 * rnd.normal(size=(2000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "rep long, v array<double>")
    axes, probes = ann.tune(index, index.where("rep % 20 = 0"), 64, len(x), 20, ann.TABLES, ann.RECALL)
    turn, asked = ann.Rotations(64, ann.TABLES, axes), np.arange(10, len(x), 20)
    met = np.zeros((len(asked), len(x)), bool)
    rows = turn.directions(x)
    for t in range(ann.TABLES):
        met |= (turn.probes(rows[asked], t, probes)[:, :, None] == turn.bucket(rows, t)[None, None, :]).any(axis=1)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -9
    recall = np.take_along_axis(met, np.argsort(-score, axis=1)[:, :20], axis=1).mean()
    print(kind, axes, probes, recall, met.mean())
    assert recall >= 0.9 and met.mean() <= most


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (40, [1.0, 2.0, 3.0]), (7, [-1.0, 0.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0])]
    rows += [(100 + k, [5.0, 5.0]) for k in range(60)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert [r[2] for r in got if r[0] == 0] == [100, 101, 102, 103, 104]
    assert [r[2] for r in got if r[0] == 100] == [101, 102, 103, 104, 105]
    few = sorted(tuple(r) for r in ann.nearest(df.where("vec_id < 100"), F.col("vec_id") % 20 == 0, k=20).collect())
    assert [(r[2], r[3]) for r in few if r[0] == 20] == [(1, 2.0), (2, 2.0), (0, 0.0), (7, 0.0)]
    # Each size of vectors is searched by itself.
    sizes = spark.createDataFrame([(20 * k, [1.0, float(k), 2.0][: 2 + k % 2]) for k in range(7)], "vec_id long, embedding array<double>")
    mixed = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(sizes, F.col("vec_id") % 20 == 0, k=5).collect())
    assert [r for r in mixed if r[0] == 60] == [(60, 1, 100, 20.0), (60, 2, 20, 8.0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_in_blocks(spark, monkeypatch):
    """Hot cells, dealt over many blocks of vectors and queries, find what one block finds."""
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    whole = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k=5).collect())
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "ASKING", 3)
    assert sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k=5).collect()) == whole


def test_pipeline_stages(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "packing"]
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = seen[name] = cut(stage(spark, before, sf), name)
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    clean, junk = (labels.where(f"quality = {q}").select("doc_id").distinct() for q in (1, 0))
    assert seen["quality"].join(clean, "doc_id").count() >= 0.99 * docs.join(clean, "doc_id").count()
    assert seen["quality"].join(junk, "doc_id").count() <= 0.1 * docs.join(junk, "doc_id").count()
    texts = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    first = {}
    for r in sorted(seen["substring_dedup"].collect()):
        w, old = re.findall(r"[^\x20\x09-\x0d]+", r.text), re.findall(r"[^\x20\x09-\x0d]+", texts[r.doc_id])
        assert r.text == texts[r.doc_id] or len(w) < len(old)
        for k in range(len(old) - 49):
            first.setdefault(tuple(old[k : k + 50]), r.doc_id)
    for r in seen["substring_dedup"].collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text)
        if r.text == texts[r.doc_id]:
            assert all(first[tuple(w[k : k + 50])] == r.doc_id for k in range(len(w) - 49))
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == set(texts)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, an id with two texts, extra columns with clashing names, and an empty table."""
    given = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given.orderBy("doc_id").limit(40).collect()]
    long = " ".join(f"word{k}" for k in range(300))
    rows += [rows[0], rows[1], (None, None, None, None, None), (None, long, "en", "x", len(long)), (1000, None, "en", None, None), (1001, "", "en", "x", 0), (1002, "   ", "en", "x", 3)]
    rows += [(2000, long, "en", "x", len(long)), (2001, "before " + " ".join(f"other{k}" for k in range(900)) + " " + " ".join(long.split()[:120]), "en", "x", 1), (2001, rows[2][1], "en", "x", 1)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, found long, kept boolean, component_id string"
    docs = spark.createDataFrame([(*r, 0.5, "r", 1, False, None) for r in rows], shape)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, before, str(tmp_path)), name)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        assert after.where("doc_id is null").count() == before.where("doc_id is null").count() or name == "quality"
        before = after
    cut_rows = [r.text.split()[:2] for r in before.where("doc_id = 2001").collect() if r.text.startswith("before")]
    assert cut_rows in ([], [["before", "other0"]])
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert len({(r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed if r.start == 0}) >= before.select("doc_id", "text").distinct().count() - before.where("text = '' or text is null or trim(text) = ''").count()
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
