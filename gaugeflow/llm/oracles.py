"""DuckDB SQL of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from .license_scan import BASE, FURTHER

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_filter(rules: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{d}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for d, r in rules)
    host = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), " + AZ + ")"
    path = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rest = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    key = f"(nullif({host}, '') || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END)"
    fits = "(h = rhost OR ends_with(h, '.' || rhost)) AND starts_with(p, rpath)"
    return rf"""WITH RECURSIVE r(decision, rule, rhost, rpath) AS (VALUES {values}),
own AS (SELECT page_id, {host.format('url')} AS h, {path.format('url')} AS p, {key.format('url')} AS k FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b([^>]*)>', 1)) AS tag FROM pages WHERE html IS NOT NULL),
target AS (SELECT url, trim(CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END) AS t FROM tags),
based AS (SELECT url, t, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*:', 0) AS s, {host.format('url')} AS h, {path.format('url')} AS p FROM target WHERE t <> ''),
full_ AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN s || t WHEN starts_with(t, '/') THEN s || '//' || h || t
  WHEN starts_with(t, '?') OR starts_with(t, '#') THEN s || '//' || h || p || t ELSE s || '//' || h || CASE WHEN regexp_extract(p, '^(.*/)?', 0) = '' THEN '/' ELSE regexp_extract(p, '^(.*/)?', 0) END || t END AS t FROM based),
e AS (SELECT {key.format('url')} AS a, {key.format('t')} AS b FROM full_),
both_ AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON both_.a = reach.other),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
judged AS (SELECT c, (SELECT decision FROM (SELECT regexp_extract(node, '^[^/?#]*', 0) AS h, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS p) x, r WHERE {fits} ORDER BY length(rule) DESC LIMIT 1) AS d FROM comp),
whole AS (SELECT c, CASE WHEN bool_or(coalesce(d = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(d = 'block', false)) THEN 'block' END AS v FROM judged GROUP BY c),
m AS (SELECT page_id, h, p, k, (SELECT rule FROM r WHERE {fits} ORDER BY length(rule) DESC LIMIT 1) AS rule FROM own)
SELECT page_id, h AS host, p AS path, m.rule AS rule, coalesce((SELECT decision FROM r WHERE r.rule = m.rule), v, 'allow') AS verdict, comp.c AS alias_of
FROM m LEFT JOIN comp ON comp.node = m.k LEFT JOIN whole ON whole.c = comp.c"""


def license_scan() -> str:
    """Places and covered parts by joining the words themselves; each diagonal's band is summed by a self-join."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({t}, {quoted(label)}, {quoted(text)})" for t, (text, label) in enumerate([*BASE, *FURTHER]))
    words = rf"regexp_extract_all(translate(coalesce({{0}}, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH t0(template, label, text) AS (VALUES {values}), t AS (SELECT template, label, {words.format('text')} AS ws FROM t0),
t2 AS (SELECT template, label, template < {len(BASE)} AS base, ws, len(ws) AS n, least(len(ws), 3) AS g FROM t),
tg AS (SELECT template, g, i - 1 AS tpos, ws[i : i + g - 1] AS gram FROM t2, unnest(range(1, n - g + 2)) u(i)),
d AS (SELECT row_number() OVER () AS id, doc_id, {words.format('text')} AS ws FROM documents),
dg AS (SELECT id, g, i - 1 AS pos, ws[i : i + g - 1] AS gram FROM d, (VALUES (2), (3)) w(g), unnest(range(1, len(ws) - g + 2)) u(i)),
h AS (SELECT id, template, tpos, pos - tpos AS diag FROM dg JOIN tg USING (g, gram)),
v AS (SELECT id, template, diag, count(*) AS votes FROM h GROUP BY ALL),
x AS (SELECT id, diag, label FROM v JOIN t2 USING (template) WHERE base AND votes = n - g + 1),
b AS (SELECT a.id, a.template, a.diag, sum(o.votes) AS votes FROM v a JOIN t2 USING (template) JOIN v o ON o.id = a.id AND o.template = a.template AND o.diag BETWEEN a.diag AND a.diag + t2.n // 16 GROUP BY ALL),
m AS (SELECT id, template, diag FROM b QUALIFY row_number() OVER (PARTITION BY id, template ORDER BY votes DESC, diag) = 1),
c0 AS (SELECT m.id, template, label, base, n, count(DISTINCT tpos + k) AS met FROM m JOIN t2 USING (template) JOIN h USING (id, template), unnest(range(0, g)) r(k) WHERE h.diag BETWEEN m.diag AND m.diag + n // 16 GROUP BY ALL),
c AS (SELECT *, met / n AS part FROM c0),
o AS (SELECT id, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM x GROUP BY id),
l AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM x UNION SELECT id, label FROM c WHERE NOT base AND part >= 0.85) GROUP BY id),
s AS (SELECT id, max(part) AS score FROM c GROUP BY id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN o USING (id) LEFT JOIN l USING (id) LEFT JOIN s USING (id)"""


def near_duplicates(n: int, percent: int) -> str:
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {n - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) u(i) WHERE len(ws) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM f UNION SELECT reach.node, f.b FROM reach JOIN f ON f.a = reach.other),
c AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


def substring_dedup(width: int) -> str:
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + {width - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - {width - 2}, 1))) u(i)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS pos FROM w JOIN f USING (g) WHERE m < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN h USING (doc_id, pos) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""


def secret_scan(rules, n_base: int) -> str:
    """Every rule on every text: positions are sums over the pieces between matches and the matches before."""
    either_case = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    quoted = lambda r: "'" + r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", either_case[1:-1]).replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT id, {no} AS no, '{r.kind}' AS kind, {r.least} AS least, unnest(regexp_extract_all(t, {quoted(r)})) AS w, unnest(regexp_extract_all(t, {quoted(r)}, {r.group})) AS v, unnest(string_split_regex(t, {quoted(r)})[:-2]) AS gap, unnest(range(len(regexp_extract_all(t, {quoted(r)})))) AS i FROM d"
        for no, r in enumerate(rules))
    text = "string_agg(kind || ':' || (stop - length(w)) || ':' || stop, ',' ORDER BY stop - length(w), no)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
p AS (SELECT *, (sum(length(gap) + length(w)) OVER (PARTITION BY id, no ORDER BY i))::BIGINT AS stop FROM m),
k AS (SELECT * FROM p WHERE length(v) >= least),
g AS (SELECT id, {', '.join(f"count(*) FILTER (no = {no}) AS n{no}" for no in range(n_base))}, {text} FILTER (no < {n_base}) AS base, {text} AS spans FROM k GROUP BY id)
SELECT doc_id, {', '.join(f"coalesce(n{no}, 0)::BIGINT AS n_{rules[no].kind}" for no in range(n_base))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)"""


def vector_codes(parts: int, entries: int, rounds: int) -> str:
    """Lloyd's method written out: every part of every vector with every entry, round after round."""
    sound = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT id, p, entry, sum((x - c) * (x - c))::BIGINT AS far FROM part JOIN c{r} USING (p, i) GROUP BY ALL), a{r} AS (SELECT id, p, entry, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY far, entry) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM part JOIN a{r} USING (id, p) GROUP BY ALL), c{r + 1} AS (SELECT p, entry, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN s{r} USING (p, entry, i))")
    last = f"a{rounds}"
    return rf"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w, len(embedding) // {parts} AS k FROM embeddings WHERE embedding IS NOT NULL AND coalesce({sound}, true)),
part AS (SELECT id, (j - 1) // k AS p, (j - 1) % k AS i, w[j] AS x FROM v, unnest(range(1, len(w) + 1)) u(j)),
c0 AS (SELECT p, id - 1 AS entry, i, x AS c FROM part WHERE id <= {entries}),
{', '.join(steps)},
e AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM {last} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, entry, i)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN e USING (id)"""


def conversation_repair() -> str:
    """Best endings of a conversation (cost, letters, lines) for each grammar state, from its last row to its first."""
    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def way(cost: str, letter: str, line: str | None, state: str) -> str:
        lines = f"list_concat([{line}], {state}.t)" if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'p': '{letter}' || {state}.p, 't': {lines}}}"

    added = {"u": "'user:'", "a": "'assistant:'"}
    closed = lambda rows: f"SELECT g, k, {best('o', way('2', 'I', added['u'], 'u2'))} AS o, {best('s', way('2', 'I', added['u'], 'u2'))} AS s, u2 AS u, {best('a', way('2', 'I', added['u'], 'u2'))} AS a FROM (SELECT *, {best('u', way('2', 'I', added['a'], 'a'))} AS u2 FROM ({rows}))"
    none = "{'c': 1000000000, 'p': '', 't': []::VARCHAR[]}"
    end = "{'c': 0, 'p': '', 't': []::VARCHAR[]}"

    def consumed(state: str, kept: dict[str, str], to: str) -> str:
        keep = " ".join(f"WHEN initial = '{i}' THEN {way('more', 'K', line, q)}" for i, q in kept.items() for line in ["role || ':' || text"])
        role = {"u": "user", "a": "assistant"}[to]
        renamed = f"""CASE WHEN NOT doomed THEN {way('2 + more', 'R', f"'{role}:' || text", to)} END"""
        return f"{best(way('3', 'D', None, state), f'CASE WHEN doomed THEN NULL {keep} END', renamed)} AS {state}"

    step = f"SELECT e.g, e.k - 1 AS k, {consumed('o', {'s': 's', 'u': 'u'}, 'u')}, {consumed('s', {'u': 'u'}, 'u')}, {consumed('u', {'a': 'a'}, 'a')}, {consumed('a', {'u': 'u'}, 'u')} FROM b e JOIN r ON r.g = e.g AND r.n = e.k"
    return rf"""WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tbl FROM bits WHERE k = 8),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
w AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
h AS (SELECT w.*, xor(list_reduce(bytes, lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS m FROM w, crc),
f AS (SELECT g, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, role[1] AS initial FROM f),
q AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN again THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY g ORDER BY n) AS before FROM o),
r AS (SELECT g, n, role, text, initial, fault IN (1, 2) AS doomed, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS more FROM q),
b AS (SELECT * FROM ({closed(f"SELECT g, count(*) AS k, {end} AS o, {none} AS s, {none} AS u, {end} AS a FROM r GROUP BY g")}) UNION ALL SELECT * FROM ({closed(step)})),
z AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY g)
SELECT conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(o.c, 0)::BIGINT AS cost, coalesce(o.p, '') AS audit, sha256(coalesce(array_to_string(o.t, chr(10)), '')) AS repaired_sha256 FROM ids LEFT JOIN z USING (g) LEFT JOIN (SELECT g, o FROM b WHERE k = 0) x USING (g)"""
