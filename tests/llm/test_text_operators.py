"""Near-duplicates, substring removal, packing, coding, quality and fingerprints against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import fingerprint, near_dup, packing, quality, queries, sentencepiece_codec, substring_dedup
from gaugeflow.llm.common import Words, chunks, cut, ngrams, text_buffers
from gaugeflow.llm.graph import connected_components
from tests.conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, score double, bucket int, component_id long"


def words(text, lower=False):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER) if lower else text or "") if w]


@pytest.fixture(scope="module")
def corpus():
    """Prose with exact and near copies, a long text, shared passages, odd white space, nulls and clashing columns."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, shared = prose(120), prose(60)
    texts = [base, base, base.upper(), prose(5), "", None, " \t\n ", "one", "One", "two words", shared, f"{prose(30)} {shared}\n{prose(20)}"]
    for k in range(40):
        w = base.split()
        for _ in range(k % 7):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append("  ".join(w))
    texts += [prose(rnd.randint(1, 80)) for _ in range(60)] + [prose(9000), "x " * 300, "x " * 200]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "r", 1.0, 2, 3) for k, t in rows], SCHEMA).repartition(3)


def components(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = words(t, True)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = sorted(sets)
    group = {k: k for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k]) for k in ids}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, corpus, n, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, corpus), n, percent).collect()}
    assert found == components(corpus, n, percent)


def test_near_duplicates_without_a_hub(spark):
    """A drifting chain, whose ends are unlike, and a crowd of half-alike texts in shared buckets."""
    rnd = random.Random(8)
    chain = [[f"w{k}" for k in range(100)]]
    for _ in range(25):
        w = list(chain[-1])
        w[rnd.randrange(100)] = f"n{rnd.random()}"
        chain.append(w)
    core = [f"c{k}" for k in range(80)]
    crowd = [core + [f"t{j}-{k}" for k in range(22)] for j in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(chain + crowd)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert found == components(rows, 3, 85)


def test_second_look_loses_no_pair():
    """Every pair of random sets at or over the threshold shares an element of both prefixes."""
    rnd = np.random.default_rng(4)
    for _ in range(3000):
        n, percent = int(rnd.integers(1, 60)), int(rnd.integers(50, 100))
        pool = rnd.permutation(200)
        a, b = set(pool[:n].tolist()), set(pool[int(rnd.integers(0, 1 + n // 3)) :][: int(rnd.integers(1, n + 3))].tolist())
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = (set(sorted(s)[: int(near_dup.prefix_size(np.array(len(s)), percent))]) for s in (a, b))
            assert x & y


def test_second_look_in_one_block():
    texts = [" ".join(f"w{i}" for i in range(a, a + 40)) for a in (0, 4, 1000)]
    keys = [near_dup.set_key(near_dup._set_of(t, 3)) for t in texts]
    rows = pd.DataFrame({"rep": [1, 2, 3, 2, 3], "text": [*texts, *texts[1:]], "set_key": [*keys, *keys[1:]], "bands": [np.array([7, k]) for k in (1, 2, 3, 2, 3)], "n": 38, "component": [1, 2, 3, 2, 3], "minor": [False, True, True, True, True], "asks": [False, False, False, True, True]})
    assert near_dup._rest(3, 80)((7, 0, 0), rows).values.tolist() == [[2, 1]]
    assert near_dup._rest(3, 82)((7, 0, 0), rows).empty
    assert near_dup._rest(3, 80)((7, 0, 0), rows[rows["rep"] != 1]).empty


def test_near_duplicates_in_small_blocks(spark, monkeypatch, corpus):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(near_dup, "GROUP", 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, corpus), 3, 60).collect()}
    assert found == components(corpus, 3, 60)


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "other words only"), (4, "")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_near_duplicates_edges(spark, corpus):
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []
    odd = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(frame(spark, odd)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = near_dup.deduplicate(frame(spark, odd))
    assert kept.columns == frame(spark, odd).columns and kept.count() == 4
    bands, rows = near_dup.bands_for(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-6


def removed(rows, width, history=()):
    first, owned = {}, {}
    for k, t in sorted((k, t) for k, t in rows if k is not None):
        w = owned[k] = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), k)
    out = {}
    for k, w in owned.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        out[k] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


@pytest.mark.parametrize("width", [13, 4, 1])
def test_substring_dedup_against_windows(spark, corpus, width):
    got = substring_dedup.remove_repeats(frame(spark, corpus), width, with_text=True, parts=5).collect()
    expected = removed(corpus, width)
    assert len(got) == len(corpus)
    for r in got:
        n, gone, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept if gone else None)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.row.score == 1.0


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (1, text), (1, text), (2, "a " + text), (3, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30), (3, 0)]
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_substring_dedup_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 30), ("b", 40)))
    rows = [(1, a), (1, b), (2, a + " " + b), (3, a), (3, "own words"), (3, b)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 30, 0), (1, 40, 0), (2, 70, 70), (3, 2, 0), (3, 30, 30), (3, 40, 40)]


def test_substring_dedup_of_a_source_that_many_runs_name(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ASKED", 3)
    source = [f"s{k}" for k in range(200)]
    rows = [(1, " ".join(source)), *((k, f"x{k} " + " ".join(source[k : k + 13 + k % 5]) + " y") for k in range(2, 60)), (60, "s1 s2 s3")]
    expected = removed(rows, 13)
    for r in substring_dedup.remove_repeats(frame(spark, rows), 13).collect():
        assert (r.n_words, r.n_removed) == expected[r.doc_id][:2]


def test_log_takes_batches_compacts_and_is_opened_again(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/log"
    log = substring_dedup.FingerprintLog.create(spark, path, 5, 7)
    expected = removed(corpus, 5)
    ordered = sorted(corpus, key=lambda x: x[0])
    step = -(-len(ordered) // 4)
    for k in range(0, len(ordered), step):
        if k:
            log = substring_dedup.FingerprintLog.open(spark, path)
        out = substring_dedup.remove_repeats(frame(spark, ordered[k : k + step]), 5, log=log, earlier=frame(spark, ordered[:k]))
        for r in out.collect():
            assert (r.n_words, r.n_removed) == expected[r.doc_id][:2]
    sizes = [n for _, n in log.runs]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 4
    log.compact(all_runs=True)
    rows = spark.read.parquet(f"{path}/{log.runs[0][0]}").collect()
    distinct = {tuple(w[i : i + 5]) for w in (words(t) for _, t in ordered) for i in range(len(w) - 4)}
    assert len(log.runs) == 1 and sum(r.n for r in rows) == log.runs[0][1] == len(distinct)
    for r in rows:
        keys = substring_dedup.from_sorted(r.prints, r.n)
        assert (keys[1:] > keys[:-1]).all()
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(frame(spark, ordered), 6, log=log)


def test_numbers_as_bytes():
    for values in ([], [0, 0], [5, 1 << 63, 7], [(1 << 64) - 1], list(range(1000))):
        flat = np.array(values, dtype=np.uint64)
        assert (substring_dedup.from_bytes(substring_dedup.to_bytes(flat), len(flat)) == flat).all()
        assert (substring_dedup.from_sorted(substring_dedup.sorted_bytes(np.sort(flat)), len(flat)) == np.sort(flat)).all()


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*corpus, (None, "no id"), (4, "again <|endoftext|> it's MIXED,case... “q” ＡＢ１２ x'll")]
    got = packing.pack_documents(frame(spark, rows), path, room=64).collect()
    expected = collections.Counter((k, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in rows)
    by_doc = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.tokens, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_doc[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
    found = collections.Counter()
    for (k, n), pieces in by_doc.items():
        whole = [p for _, p in sorted(pieces)]
        flat = tuple(x for p in whole for x in p)
        assert len(flat) % n == 0
        found[k, flat[:n]] += len(flat) // n
    assert sum(found.values()) == sum(expected.values()) and set(found) == set(expected)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
        short += at < 64
    assert short <= 1
    assert packing.pack_documents(frame(spark, []), path).collect() == []


def test_tournament_is_first_fit():
    rnd = random.Random(4)
    sizes = sorted((rnd.randint(1, 100) for _ in range(300)), reverse=True)
    tree, free = packing.Tournament(len(sizes), 100), []
    for n in sizes:
        at = next((k for k, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= n
        assert tree.place(n) == at


def test_sentencepiece_equals_library(spark, corpus):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(6)
    rows = [*corpus, *((1000 + k, "".join(rnd.choice("  aetho.,éß漢\n\t1▁") for _ in range(rnd.randint(0, 50)))) for k in range(300)), (None, "the end")]
    encoded = cut(sentencepiece_codec.encode(frame(spark, rows), path))
    texts = collections.Counter((k, t or "") for k, t in rows)
    got = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect())
    assert got == collections.Counter((k, tuple(library.encode(t))) for k, t in texts.elements())
    back = collections.Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(encoded, path).collect())
    assert back == collections.Counter((k, t.replace("▁", " ")) for k, t in texts.elements())
    assert sentencepiece_codec.encode(frame(spark, []), path).collect() == []
    same = sentencepiece_codec.round_trip(frame(spark, rows), path)
    assert same.where("not same").count() == sum("▁" in (t or "") for _, t in rows)


def test_sentencepiece_cuts_between_characters_of_any_script():
    """Words that end with a letter outside ASCII are segments of their own, learned once, and ids stay the library's."""
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model, library = sentencepiece_codec.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [t.encode() for t in ("allé où ça " * 500, "où allé. ça é é " * 500)]
    border = np.cumsum([0, *map(len, raw)])
    found, at = sentencepiece_codec.encode_texts(model, np.frombuffer(b"".join(raw), dtype=np.uint8), border)
    assert len(model.encoded) <= 8 and max(map(len, model.encoded)) <= 6
    assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t.decode()) for t in raw]
    rnd = random.Random(8)
    for some in ("çñéèêüöäßí ,. ", "漢字你好世界のカタ。、 ", "😀👩\u200dé \x00\x7f\x80▁", [*model.score], sorted({c for p in model.score for c in p})):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
        raw = [t.encode() for t in texts]
        found, at = sentencepiece_codec.encode_texts(model, np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(texts)


def test_sentencepiece_occurrences_and_pairs_in_plain_python():
    rnd = random.Random(9)
    for size in (2, 5, 300, 50_000):
        letters = [rnd.randrange(1, 0x10000) for _ in range(size)]
        text = np.array([rnd.choice([*letters[:4], rnd.choice(letters), -1]) for _ in range(400)])
        pieces = {tuple(int(c) for c in text[i : i + n]) for i in range(0, 300, 7) for n in (1, 2, 3, 9)} | {(letters[0], 0x20000), (0x20000,)}
        pieces = sorted(p for p in pieces if -1 not in p)
        lengths = np.array([len(p) for p in pieces])
        codes = np.array([[*p, *[0] * (9 - len(p))] for p in pieces])
        found = sorted(zip(*(x.tolist() for x in sentencepiece_codec.occurrences(text, codes, lengths))))
        assert found == [(k, i) for k, p in enumerate(pieces) for i in range(400) if tuple(text[i : i + len(p)].tolist()) == p]
    model = sentencepiece_codec.Model(queries.tokenizer_file("piece_bpe_32k.model"))
    model.pairs = np.full(4, -1, dtype=np.int64)  # grows from next to nothing, with collisions
    for _ in range(4):
        before, symbol = np.array([rnd.randrange(-1, 60) for _ in range(900)]), np.array([rnd.randrange(60) for _ in range(900)])
        expected = [a < 0 or model.merge(model.symbols[a] + model.symbols[b]) == [model.symbols[a], model.symbols[b]] for a, b in zip(before.tolist(), symbol.tolist())]
        assert model.follows(before, symbol).tolist() == expected
    assert (model.pairs >= 0).sum() == model.asked


def test_fingerprints_against_sets(spark, corpus):
    rows = [(k, t) for k, t in corpus]
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(frame(spark, rows)).collect()}
    text = {k: t or "" for k, t in rows}
    order = sorted(text)

    def shingles(t):
        w = words(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, after in zip(order, order[1:] + order[:1]):
        t, nxt, r = text[k], text[after], got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r.edited, r.n_chars, r.next_id) == (edited, len(t), after)
        assert r.near_edited == pytest.approx(alike(shingles(t), shingles(edited)), abs=0.15)
        assert r.near_next == pytest.approx(alike(shingles(t), shingles(nxt)), abs=0.15)
        assert len(r.sketch) == min(256, len(shingles(t)))
    assert fingerprint.compare_with_edits(frame(spark, [])).collect() == []
    lone = fingerprint.compare_with_edits(frame(spark, [(None, "ab cd ef gh"), (7, "x")])).collect()
    assert {(r.doc_id, r.edited) for r in lone} == {(None, "ab cd "), (7, "x")}


def test_fingerprint_over_many_ranges(spark):
    """Next documents across the borders of ranges, with repeated ids and one id alone in its range."""
    rows = [(k // 2 if k < 20 else k, " ".join(f"w{k}-{i}" for i in range(k % 7 + 1))) for k in range(60)]
    order = sorted(rows)
    got = sorted((r.doc_id, r.edited) for r in fingerprint.compare_with_edits(frame(spark, rows)).collect())
    expected = []
    for (k, t), (_, u) in zip(order, order[1:] + order[:1]):
        expected.append((k, t[: len(t) - len(t) // 2] + u[: len(t) // 2]))
    assert got == sorted(expected)


def test_fingerprint_text_round_trip(spark):
    df = spark.createDataFrame([([-(1 << 63), -5, 0, 1, (1 << 63) - 1],), ([],)], "s array<long>")
    for r in df.select("s", fingerprint.from_text(fingerprint.to_text(F.col("s"))).alias("t"), fingerprint.to_text(F.col("s")).alias("x")).collect():
        assert r.s == r.t and len(r.x) == 16 * len(r.s)


def test_packing_groups_of_many_short_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    path = queries.tokenizer_file("word_bpe_49k.json")
    out = packing.pack_documents(frame(spark, [(1, None)] * 300 + [(2, "same words")] * 300), path, room=64).collect()
    assert len(out) == 600 + sum(r.start > 0 for r in out) and len({r.sequence_id >> 32 for r in out}) > 6
    assert max(collections.Counter(r.sequence_id >> 32 for r in out).values()) < 150


def test_fingerprint_merge_and_estimates(spark):
    rnd = random.Random(3)
    whole = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    parts = [(1, " ".join(whole[:2500])), (2, " ".join(whole[2496:]))]
    sketches = fingerprint.with_sketch(spark.createDataFrame(parts, "doc_id long, text string")).withColumn("g", F.lit(1))
    merged = fingerprint.merge_groups(sketches, ["g"]).first().sketch
    direct = fingerprint.with_sketch(spark.createDataFrame([(1, " ".join(whole))], "doc_id long, text string")).first().sketch
    assert merged == direct
    a, b = (s.sketch for s in sketches.orderBy("doc_id").collect())
    df = spark.createDataFrame([(direct, a, b)], "w array<long>, a array<long>, b array<long>")
    r = df.select(fingerprint.distinct_count(F.col("w")).alias("n"), fingerprint.containment(F.col("a"), F.col("w")).alias("c"), fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.resemblance(F.col("a"), F.col("w")).alias("r")).first()
    assert r.m == direct and r.n == pytest.approx(3996, rel=0.25) and r.c > 0.8 and r.r == pytest.approx(2496 / 3996, abs=0.12)


def test_quality_on_held_out_rows(spark):
    df = queries.op9_quality_classifier(spark, f"{DATA}/sf0.01")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    held = df.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert (held.predicted == held.quality).mean() >= 0.95
    assert df.count() == 1000 and df.where("score < 0 or score > 1 or score is null").count() == 0
    low, high = held[held.quality == 0].score.to_numpy(), held[held.quality == 1].score.to_numpy()
    assert (high[:, None] > low[None, :]).mean() > 0.98


def test_quality_votes_against_brute_force():
    rnd = np.random.default_rng(2)
    rows = rnd.random((60, quality.WIDTH)).astype(np.float32)
    y = rnd.integers(0, 2, 60)
    v = quality.fit(rows, y, rank=8, neighbours=5)
    asked = v.place(rnd.random((30, quality.WIDTH)).astype(np.float32))
    for q, got in zip(asked, v.vote(asked, block=7)):
        near = sorted(range(60), key=lambda k: -float(q @ v.vectors[k]))[:5]
        w = [max(0.0, float(q @ v.vectors[k])) ** 4 for k in near]
        assert got == pytest.approx(sum(a * y[k] for a, k in zip(w, near)) / sum(w), abs=1e-4)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, label int")
    docs = frame(spark, [(1, "fine prose"), (2, "###"), (3, None), (4, ""), (None, "x"), (1, "fine prose")])
    out = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert out.count() == 6 and set(out.columns) == set(docs.columns)
    none = quality.fit_quality(docs, labels.where("label = 5"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(frame(spark, []), none).collect() == []


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(None, 1), (5, 5)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(60)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            group[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {k: find(k) for k in group}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_words_and_chunks():
    texts = ["a b", "", " c  d\n", "é", "x" * 5000]
    data, offsets = text_buffers(pa.array([*texts, None]))
    w = Words(data, offsets)
    found = [[data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert found == [words(t) for t in texts] + [[]]
    h = w.hashes()
    assert len(set(h.tolist())) == len(h) and len(ngrams(h, 99)) == 0
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    assert [(a, b) for a, b, *_ in chunks(batch, "text", limit=4)] == [(0, 2), (2, 3), (3, 4), (4, 5)]


LONG_TEXTS = ["a" * 40_000, "ab" * 15_000, "supercalifragilistic" * 1_500, "你好世界" * 4_000, "x1y2" * 8_000, "word " * 30_000]


@pytest.mark.parametrize("k", range(len(LONG_TEXTS)))
def test_very_long_texts_without_a_place_to_cut(k):
    """Ids of one very long word, or of very many, equal those of the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    text = LONG_TEXTS[k]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    border = np.array([0, len(raw)])
    path = queries.tokenizer_file("word_bpe_49k.json")
    found, at = packing.WordEncoder.of(path).encode(raw, border)
    assert at.tolist() == [0, len(found)] and found.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece_codec.Model.of(path)
    found, at = sentencepiece_codec.encode_texts(model, raw, border)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert found.tolist() == library.encode(text) and sentencepiece_codec.decode_ids(model, found).decode() == library.decode(library.encode(text))
