"""Main text of web pages, with host-wide removal of repeated boilerplate.

A page is parsed into blocks of text. Markup settles what it can: text in
menus, forms, adverts and the like is no main text, and text in an article
element is. Two kinds of blocks it leaves open: those of pages without an
article, and those inside an article whose class or id only holds a word such
as share or related. All pages of a host, in bounded groups, then put their
token streams one after another; a suffix array of the whole, sorted as deep
as the shortest passage of interest, brings repeated passages together, and
what stands in two pages is boilerplate among the open blocks. What remains
of them are their unique runs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut
from .url_filter import host_of

#: Tokens in the shortest passage that counts as repeated.
PASSAGE = 8
#: Pages of one host that share a suffix array, and their bytes; a task has as much.
GROUP_PAGES = 2000
GROUP_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>?", re.S)
#: One attribute with its value, so that nothing inside a value counts as an attribute.
ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_TEXT = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg object select annotation annotation-xml".split())
CHROME = frozenset("nav footer aside form header menu dialog head button canvas audio video".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that a class word never makes boilerplate.
WHOLE = frozenset(("html", "body", *ARTICLE))
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements of running text. Page generators give them ids made of their words, so an id says nothing of them, and of their class only a word of adverts, notices or comments.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr caption pre blockquote figure figcaption summary".split())
PROSE_CHROME = re.compile(r"(?:^|\s)(?:ads?|advert|advertisement|sponsored|promo|promotion|cookies?|consent|notice|comments?|disqus|respond)(?:[_-](?:banner|block|box|item|list|message|notice|slot|unit))*(?:$|\s)", re.I)
#: Elements of an article whose id counts, as a class does.
CONTAINER = frozenset("div section ul ol dl form aside table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark an element outside an article as boilerplate, also as a part of a name.
CHROME_WORD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|navbar|navigation|nav|breadcrumbs?|footer|masthead|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|disqus|respond|pagination|pager|widget|toolbar|skip-link)(?:$|[\s_-])", re.I)
#: Inside an article, words of adverts, comments, forms and notices do so only where they are the whole name or name a list, box and the like,
ARTICLE_CHROME = re.compile(r"(?:^|\s)(?:ads?|advert|advertisement|sponsored|promo|promotion|cookie|cookies|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|comments?|disqus|respond)(?:[_-](?:area|banner|bar|block|box|container|content|form|inner|item|list|message|notice|panel|section|slot|thread|unit|wrap|wrapper))*(?:$|\s)", re.I)
#: and words of menus and sidebars only where they are the whole name. Other names with such words leave the element open.
ARTICLE_FRAME = re.compile(r"(?:^|\s)(?:sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|pagination|pager|toolbar|skip-link)(?:$|\s)", re.I)
#: Names such as has-sidebar tell what stands beside or inside an element, not what it is.
LAYOUT_WORD = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|not|show|hide)[_-]\S*", re.I)
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())

#: MAYBE: in an article, for repeated runs to decide.
BOILER, OPEN, MAIN, MAYBE = 0, 1, 2, 3
#: Fills short open blocks of an article up to a run's length, so that they can be found again whole.
FILL = "\0"


def _chrome_of(name: str, attributes: str, inside_article: bool) -> str | None:
    """What marks an element as boilerplate: its tag, an attribute, or only a word of its class or id; "maybe" if runs decide; else None.

    In an article an id counts on containers only: one of a heading, a
    paragraph or a list item is made of its words, as a link's target is.
    """
    if name in CHROME and not (name == "header" and inside_article):
        return "tag"
    held: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in held:
        return "attribute"
    if held.get("role", "").lower() in CHROME_ROLE:
        return "attribute"
    if name in WHOLE:
        return None
    if name in PROSE and inside_article:
        return "word" if PROSE_CHROME.search(LAYOUT_WORD.sub(" ", held.get("class", ""))) else None
    told = ("class", "id") if name in CONTAINER or not (inside_article or name in PROSE) else ("class",)
    names = [LAYOUT_WORD.sub(" ", held.get(k, "")) for k in told]
    if inside_article and any(ARTICLE_CHROME.search(x) or ARTICLE_FRAME.search(x) for x in names):
        return "word"
    if any(CHROME_WORD.search(x) for x in names):
        return "maybe" if inside_article else "word"
    return None


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order; character references decoded, white space collapsed.

    An element that is boilerplate by a word only, and holds the page's only
    articles, is taken for the page's layout.
    """
    if not page:
        return []
    out, covered = _blocks(page, False)
    if covered and not any(zone == MAIN for zone, _ in out):
        out, _ = _blocks(page, True)
    return out


def _blocks(page: str, around: bool) -> tuple[list[tuple[int, str]], bool]:
    """The blocks, and whether an article lies in boilerplate by word; with ``around`` that is layout, not boilerplate.

    Inside a layout, other boilerplate by word stays what it is.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    open_chrome: list[list] = []  # [name, depth of the same name, mark, where it began in an unfinished block if it is inline]
    layout: list = []  # [name, depth of the same name]
    maybe: list = []  # [name, depth of the same name], of an element of the article that runs decide
    articles = 0
    covered = False
    unclosed: set[str] = set()
    at = 0

    def emit(text: str, zone: int) -> None:
        text = " ".join(html.unescape(text).split())
        if text:
            out.append((zone, text))

    def flush() -> None:
        if parts:
            own = OPEN if not articles else MAYBE if maybe else MAIN
            if open_chrome and open_chrome[-1][3] is not None:
                # An inline element of boilerplate: what stood before it in its block is not part of it.
                emit("".join(parts[: open_chrome[-1][3]]), own)
                emit("".join(parts[open_chrome[-1][3] :]), BOILER)
                open_chrome[-1][3] = 0
            else:
                emit("".join(parts), BOILER if open_chrome else own)
            parts.clear()

    while True:
        m = TOKEN.search(page, at)
        parts.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = m[1] == "/"
        if not closing and name in RAW_TEXT:
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if not end:
                # Nor will a later one be closed.
                unclosed.add(name)
            if name != "svg" or end:
                at = end.end() if end else len(page)
            if name == "title" or name in BLOCK:
                flush()
            continue
        if name in BLOCK or name in CHROME:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if maybe and name == maybe[0] and not open_chrome:
            if closing and maybe[1] == 1:
                flush()
            maybe[1] += -1 if closing else 1
            if maybe[1] == 0:
                maybe = []
        if layout and name == layout[0]:
            layout[1] += -1 if closing else 1
            if layout[1] == 0:
                layout = []
        if closing:
            if open_chrome and open_chrome[-1][0] == name:
                inline = open_chrome[-1][3]
                if inline is None:
                    flush()
                open_chrome[-1][1] -= 1
                if open_chrome[-1][1] == 0:
                    open_chrome.pop()
                    if inline is not None:
                        parts[inline:] = [" "]
            elif name in ARTICLE and not open_chrome:
                articles = max(0, articles - 1)
                if not articles:
                    maybe = []
        elif open_chrome:
            if name == open_chrome[-1][0]:
                open_chrome[-1][1] += 1
            elif name in ARTICLE and not articles and open_chrome[-1][0] in CHROME:
                # A menu or header that was never closed ends where the article begins.
                open_chrome.clear()
                articles = 1
            elif name in ARTICLE and not articles and open_chrome[-1][2] == "word":
                covered = True
                if around and not layout:
                    layout = open_chrome.pop()[:2]
                    articles = 1
        elif (mark := _chrome_of(name, m[3] or "", articles > 0)) == "maybe":
            # Only a block can be repeated whole.
            if not maybe and name in BLOCK:
                maybe = [name, 1]
        elif mark:
            inline = name not in BLOCK and name not in CHROME
            if not inline:
                flush()
            open_chrome.append([name, 1, mark, len(parts) if inline else None])
        elif name in ARTICLE:
            articles += 1
    flush()
    return out, covered


# ---------------------------------------------------------------- suffix array

def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first ``depth`` tokens or more, by prefix doubling.

    Suffixes with one rank agree on that prefix, so neighbours of one rank in
    the order have a common prefix of at least ``depth`` tokens. Prefixes are
    numbered anew only where two numbers don't fit one of 63 bits.
    """
    own, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    n, k, most = len(tokens), 1, len(own)
    while k < depth:
        step = min(k, depth - k)
        if most * (most + 1) >= 1 << 63:
            _, rank = np.unique(rank, return_inverse=True)
            most = int(rank.max()) + 1
        after = np.zeros(n, dtype=np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        rank = rank * np.int64(most + 1) + after
        most *= most + 1
        k += step
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    new = np.concatenate([[0], np.cumsum(rank[1:] != rank[:-1])])[:n]
    rank[order] = new
    return order, rank


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int) -> np.ndarray:
    """True for each token inside a run of ``depth`` or more that stands in two distinct pages.

    ``tokens`` of one page are together; runs across a page border do not count.
    """
    n = len(tokens)
    covered = np.zeros(n, dtype=bool)
    if n < depth:
        return covered
    order, rank = suffix_array(tokens, depth)
    whole = np.zeros(n, dtype=bool)
    whole[: n - depth + 1] = page[: n - depth + 1] == page[depth - 1 :]
    order = order[whole[order]]
    if not len(order):
        return covered
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    low, high = np.minimum.reduceat(page[order], first), np.maximum.reduceat(page[order], first)
    shared = np.repeat(low < high, np.diff(np.append(first, len(order))))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, order[shared], 1)
    np.add.at(edge, order[shared] + depth, -1)
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- Spark side

def _token_ids(words: Iterable[str], salt: int) -> np.ndarray:
    return pd.util.hash_array(np.array(list(words), dtype=object), categorize=False).astype(np.uint64) ^ np.uint64(salt)


def is_open(blocks: list[tuple[int, str]]) -> bool:
    """Whether repeated runs have anything to decide on a page."""
    return any(z == MAYBE for z, _ in blocks) or not any(z == MAIN for z, _ in blocks)


def words_in(zone: int, text: str, depth: int) -> list[str]:
    """The tokens of a block; a short one that runs decide is filled up, so that it makes a run of its own."""
    words = text.split(" ")
    return words + [FILL] * (depth - len(words)) if zone == MAYBE else words


def _grams(depth: int, settled: bool):
    """(host, gram, pid): distinct token runs of the pages that markup settles, or of those that it does not."""

    def work(batches):
        for frame in batches:
            rows = []
            for host, pid, page in zip(frame["host"], frame["pid"], frame["html"]):
                blocks = blocks_of(page)
                if is_open(blocks) == settled:
                    continue
                stream = _token_ids((w for z, t in blocks for w in words_in(z, t, depth)), 0)
                if len(stream) >= depth:
                    grams = np.unique(_roll(stream, depth))
                    rows.append(pd.DataFrame({"host": host, "gram": grams.view(np.int64), "pid": pid}))
            if rows:
                yield pd.concat(rows)

    return work


def _roll(stream: np.ndarray, depth: int) -> np.ndarray:
    from .common import ngrams

    return ngrams(stream, depth)


RESULT = "page_id long, url string, text string, n_chars long, run_words long"


def _extract(depth: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        page_id, url = table.column("page_id"), table.column("url")
        hosts, shards, pids, pages, known = (table.column(c).to_pylist() for c in ("host", "shard", "pid", "html", "known"))
        order = sorted(range(len(pids)), key=lambda k: (hosts[k], shards[k], pids[k]))
        parsed = {k: blocks_of(pages[k]) for k in order}
        pages.clear()
        words = {k: [words_in(z, t, depth) for z, t in parsed[k]] for k in order}
        sizes = {k: sum(map(len, words[k])) for k in order}
        groups = {g: i for i, g in enumerate(dict.fromkeys((hosts[k], shards[k]) for k in order))}
        distinct: dict[tuple, int] = {}
        number = {k: distinct.setdefault((hosts[k], pids[k]), len(distinct)) for k in order}
        flat = [w for k in order for b in words[k] for w in b]
        if flat:
            plain = _token_ids(flat, 0)
            own = np.repeat([groups[hosts[k], shards[k]] for k in order], [sizes[k] for k in order]).astype(np.uint64)
            owner = np.repeat([number[k] for k in order], [sizes[k] for k in order])
            covered = repeated(plain ^ (own * np.uint64(0x9E3779B97F4A7C15)), owner, depth)
        out = [None] * len(pids)
        at = 0
        for k in order:
            n = sizes[k]
            gone = covered[at : at + n] if n else np.zeros(0, bool)
            if known[k] and n >= depth:
                hit = np.flatnonzero(np.isin(_roll(plain[at : at + n], depth), np.array(known[k], dtype=np.int64).view(np.uint64)))
                gone = gone.copy()
                for h in hit:
                    gone[h : h + depth] = True
            out[k] = _keep(parsed[k], words[k], gone)
            at += n
        text = pa.array([x for x, _ in out], pa.string())
        return pa.table({"page_id": page_id, "url": url, "text": text, "n_chars": pa.array([len(x) for x, _ in out], pa.int64()), "run_words": pa.array([n for _, n in out], pa.int64())})

    return work


def _keep(blocks, words, gone) -> tuple[str, int]:
    """(text, words that repeated runs took from it).

    With an article: its blocks as they are, but for open ones that are
    repeated whole. Without: what is neither boilerplate by markup nor
    repeated.
    """
    article = any(z in (MAIN, MAYBE) for z, _ in blocks)
    lines, at, taken = [], 0, 0
    for (zone, text), own in zip(blocks, words):
        there = gone[at : at + len(own)]
        at += len(own)
        if zone == MAIN:
            lines.append(text)
        elif zone == MAYBE:
            if there.all():
                taken += len(text.split(" "))
            else:
                lines.append(text)
        elif zone == OPEN and not article:
            kept = [w for w, g in zip(own, there) if not g]
            taken += len(own) - len(kept)
            if kept:
                lines.append(" ".join(kept))
    return "\n".join(lines), taken


def extract_text(pages: DataFrame, depth: int = PASSAGE, group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars, run_words (how many words repeated runs took away).

    Blocks of the main text are joined by one newline in page order. With an
    article (or main) element the text is what that holds, without the menus,
    forms, adverts, notices and comments in it; passages that its host
    repeats stay, as they are the article's own, but for whole elements whose
    class or id holds a word such as share or related. Without one, it is all
    text that markup does not mark as boilerplate, without tokens in runs of
    ``depth`` that another page of the host also has.

    Hosts with more pages than ``group_pages``, or more than ``GROUP_BYTES``,
    are split by page; runs that repeat across the parts are found by
    grouping the distinct runs of the pages that markup leaves open, and those
    of the other pages that are among them, so the result is the same at any
    size of groups and no host is ever in one task. Null html is empty; null
    urls and urls without a host form one host of their own; a null page_id
    stands for the page's content. Repeated rows are one page, so they do not
    make each other's text boilerplate. An empty table gives an empty table.
    """
    url = F.col("url").cast("string")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    held = held.withColumn("pid", F.coalesce("page_id", F.xxhash64("url", "html")))
    counts = held.groupBy("host").agg(F.count("*").alias("cnt"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("size"))
    total, size = counts.agg(F.sum("cnt"), F.sum("size")).first()
    large = counts.where((F.col("cnt") > group_pages) | (F.col("size") > GROUP_BYTES)).select("host", F.ceil(F.greatest(F.col("cnt") / group_pages, F.col("size") / GROUP_BYTES)).alias("shards"))
    held = attach(held, large, ["host"])
    split = held.where("shards is not null").select("host", "pid", "html")
    open_grams = cut(split.mapInPandas(_grams(depth, False), "host string, gram long, pid long"), "grams")
    spread = open_grams.groupBy("host", "gram").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    across = spread
    if not open_grams.isEmpty():
        # Runs of pages with an article count only where an open page of the host has them.
        settled = split.join(open_grams.select("host").distinct(), "host", "left_semi").mapInPandas(_grams(depth, True), "host string, gram long, pid long")
        settled = settled.groupBy("host", "gram").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
        across = spread.unionByName(settled.join(spread.select("host", "gram"), ["host", "gram"], "left_semi"))
        across = across.groupBy("host", "gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    across = across.where("lo < hi")
    known = open_grams.join(across.select("host", "gram"), ["host", "gram"]).groupBy("host", "pid").agg(F.collect_set("gram").alias("known"))
    dealt = held.withColumn("shard", F.coalesce(F.pmod(F.xxhash64("pid"), F.col("shards")), F.lit(0)))
    dealt = attach(dealt, known, ["host", "pid"])
    buckets = max(1, -(-(total or 0) // max(1, group_pages // 2)), -(-(size or 0) // (GROUP_BYTES // 2)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("host", "shard"), F.lit(buckets)))
    return dealt.select("bucket", "page_id", "url", "host", "shard", "pid", "html", "known").groupBy("bucket").applyInArrow(_extract(depth), RESULT)
