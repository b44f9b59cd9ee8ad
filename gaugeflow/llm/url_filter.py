"""URL filtering with redirect equivalence.

Pages are judged by host and path rules. Redirects and canonical links make
addresses aliases of one another; a distributed connected-components pass
over those links carries decisions to aliases that no rule names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are part of the plan; a longer list is a table that hosts and path prefixes are joined with.
RULES_IN_PLAN = 200


#: Host, path, and query with its question mark, after the first ``://``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def alias_key(url: Column) -> Column:
    """The address without scheme and fragment; null where there is no host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.nullif(host_of(url), F.lit("")), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _checked(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(decision, rule, host, path), one for each rule; of equal rules allow wins."""
    kept: dict[str, str] = {}
    for decision, rule in rules:
        if decision not in ("allow", "block"):
            raise ValueError(f"unknown decision {decision!r}")
        if kept.get(rule) != "allow":
            kept[rule] = decision
    out = []
    for rule, decision in kept.items():
        own, slash, tail = rule.partition("/")
        out.append((decision, rule, own, slash + tail))
    return out


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    names, verdicts = [], []
    # The longest is tried first; of equally long ones allow wins.
    for decision, rule, own, start in sorted(_checked(rules), key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        names.append(F.when(fits, rule))
        verdicts.append(F.when(fits, decision))
    none = F.lit(None).cast("string")
    return F.coalesce(*names, none), F.coalesce(*verdicts, none)


def with_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls`` (host, path and other columns) with the rule and the decision of the longest rule that fits, or nulls.

    A short list is one expression. A long one is a table: each distinct
    address meets the rules of its host and of the domains above it by
    equality, for each path length that rules of that domain have, so neither
    the plan nor the candidates of an address grow with the list.
    """
    if len(rules) <= RULES_IN_PLAN:
        name, verdict = rule_for(F.col("host"), F.col("path"), rules)
        return urls.select("*", name.alias("rule"), verdict.alias("ruled"))
    table = urls.sparkSession.createDataFrame(_checked(rules), "ruled string, rule string, domain string, start string")
    sizes = table.groupBy("domain").agg(F.collect_set(F.length("start")).alias("sizes"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("domain", F.explode(above))
    cuts = each.join(sizes, "domain").select("host", "path", "domain", F.explode("sizes").alias("n")).where(F.length("path") >= F.col("n"))
    fits = cuts.withColumn("start", F.substring("path", F.lit(1), F.col("n"))).join(table, ["domain", "start"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("ruled") == "allow").alias("a"), F.col("rule").alias("rule"), F.col("ruled").alias("ruled"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], "best.rule", "best.ruled")


#: Character references of these code points and names are decoded in links; others do not stand for what an address may hold.
NAMED = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">"}


def decoded(text: Column) -> Column:
    """The text with references of ASCII characters decoded, numeric ones first and ``&amp;`` last."""
    def decoder(base: int, skip: int):
        def step(t: Column, ref: Column) -> Column:
            code = F.conv(F.substring(ref, F.lit(skip), F.length(ref) - skip), base, 10).cast("int")
            return F.when(code.between(33, 126), F.replace(t, ref, F.char(code))).otherwise(t)

        return step

    for pattern, base, skip in ((r"&#[0-9]{1,3};", 10, 3), (r"&#[xX][0-9A-Fa-f]{1,2};", 16, 4)):
        text = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, decoder(base, skip))
    for name in [x for x in NAMED if x != "&amp;"] + ["&amp;"]:
        text = F.replace(text, F.lit(name), F.lit(NAMED[name]))
    return text


def normal_path(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    # A path that ends in a dot segment names the folder.
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def alias_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses of the canonical links and meta refreshes in pages.

    Character references in targets are decoded and relative targets, with
    their dot segments, are resolved against the page's own address. Pages
    without html or host give no link.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b([^>]*)>"), F.lit(1))
    hinted = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"))
    each = hinted.select("url", F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    later = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    named = each.select(
        "url",
        decoded(F.trim(F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), href).when(F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), later))).alias("target"),
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0).alias("scheme"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    ).where("target <> ''")
    based = named.select("*", F.concat("scheme", F.lit("//"), "host").alias("base"), F.regexp_extract("path", r"^(.*/)?", 0).alias("folder"))
    target = F.col("target")
    full = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat("scheme", "target"))
        .when(target.startswith("/"), F.concat("base", "target"))
        .when(target.startswith("?") | target.startswith("#"), F.concat("base", "path", "target"))
        .otherwise(F.concat("base", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), "target"))
    )
    named = based.select(F.col("url").alias("source"), full.alias("full"))
    address = r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$"
    parts = [F.regexp_extract("full", address, k) for k in (1, 2, 3)]
    return named.select("source", F.when(F.col("full").rlike(r"/\.\.?(/|$|\?|#)"), F.concat(parts[0], normal_path(parts[1]), parts[2])).otherwise(F.col("full")).alias("target"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, alias_of.

    ``rules``: (allow or block, ``host/path``); a rule fits its host and all
    subdomains where the path starts with the rule's, and the longest wins.
    ``redirects`` (source, target) adds links to those found in the pages.
    Addresses that differ in scheme or fragment only are one address.

    A page with a rule has the rule's verdict. For any other, the rules of
    all addresses in its component decide: allow if one is explicitly
    allowed, else block if one is blocked, else ``default``; ``alias_of`` is
    the component's smallest address when the page has links. Null urls and
    urls without ``://`` have empty host and path, fit no rule and have no
    aliases. Repeated rows are judged each; an empty table gives an empty
    table.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = own.select("page_id", host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("key"))
    own = with_rules(own, rules)

    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    links = cut(links, "links")
    edges = links.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b"))
    nodes = connected_components(edges, "a", "b")
    placed = nodes.select("component", F.regexp_extract("node", "^[^/?#]*", 0).alias("host"), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1).alias("path"))
    judged = with_rules(placed, rules).select("component", F.col("ruled").alias("d"))
    whole = judged.groupBy("component").agg(F.max((F.col("d") == "allow").cast("int")).alias("allowed"), F.max((F.col("d") == "block").cast("int")).alias("blocked"))
    carried = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block")
    aliases = nodes.join(whole, "component").select(F.col("node").alias("key"), F.col("component").alias("alias_of"), carried.alias("carried"))
    out = own.join(aliases, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "carried", F.lit(default)).alias("verdict"), "alias_of")
