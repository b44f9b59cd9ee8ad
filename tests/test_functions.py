import itertools
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import assignment, columns, scalars


def distance(a, b):
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return table[len(a), len(b)]


def test_edit_distance_against_table():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abç") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        assert scalars.edit_distance(a, b) == distance(a, b)


NUMERIC = [
    ("$123", "123", {}, 1.0), ("123,456", "123456", {}, 1.0), ("(123)", "-123", {}, 1.0), ("abc", "1", {}, 0.0), ("", "1", {}, 0.0),
    ("100", "109", {"relative_tolerance": 0.1}, 1.0), ("100", "111", {"relative_tolerance": 0.1}, 0.0), ("0", "0.05", {"relative_tolerance": 0.1}, 1.0),
    ("100", "104", {"absolute_tolerance": 5}, 1.0), ("100", "106", {"absolute_tolerance": 5}, 0.0), (None, None, {}, 1.0), (None, "1", {}, 0.0), ("1.2.3", "1", {}, 0.0), ("--5", "5", {}, 0.0),
]


@pytest.mark.parametrize("a,b,config,score", NUMERIC)
def test_numeric(spark, a, b, config, score):
    assert scalars.Numeric(**config).compare(a, b) == score
    df = spark.createDataFrame([(a, b)], "a string, b string")
    native = columns.numeric(F.col("a"), F.col("b"), config.get("relative_tolerance", 0.0), config.get("absolute_tolerance", 0.0))
    assert df.select(native).first()[0] == score


EXACT = [("hello, world", "Hello world", 1.0), ("hello-world", "hello world", 1.0), ("a", "b", 0.0), (None, None, 1.0), (None, "", 0.0), ("-100.0", "1000", 1.0)]
LEV = [("  Hello   World ", "hello world", 1.0), (None, "", 1.0), ("", "abc", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("größe", "grosse", 1 - 3 / 6), ("a b", "a b", 1.0)]


def test_text_comparators_agree(spark):
    for kind, native, cases in ((scalars.Exact(), columns.exact, EXACT), (scalars.Levenshtein(), columns.levenshtein, LEV)):
        df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
        found = {r[0]: r[1] for r in df.select("k", native(F.col("a"), F.col("b"))).collect()}
        for k, (a, b, score) in enumerate(cases):
            assert kind.compare(a, b) == pytest.approx(score)
            assert found[k] == pytest.approx(score)


def test_float_text_is_pythons(spark):
    values = [0.0, -0.0, 1.0, 1e7, 123456.789, 1e-4, 1e-5, 2.5e-7, 1e16, 1.5e300, -3.25, 1e15, 0.1, float("nan"), float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for r in df.select("k", columns.py_str(F.col("v"), "double").alias("t")).collect():
        assert r.t == str(values[r.k])


def test_fuzzy():
    assert scalars.indel_ratio("abcd", "abce") == pytest.approx(0.75)
    assert scalars.Fuzzy().compare("", "") == 1.0
    assert scalars.Fuzzy(method="partial_ratio").compare("york", "new york city") == 1.0
    assert scalars.Fuzzy(method="token_sort_ratio").compare("a b c", "c b a") == 1.0
    assert scalars.Fuzzy(method="token_set_ratio").compare("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert scalars.Fuzzy(method="unknown").compare("ab", "ab") == 1.0


def test_pluggable_comparators():
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    semantic = scalars.Semantic(embedding_function=vectors.__getitem__)
    assert semantic.compare("a", "b") == 0.0 and semantic.compare("a", "c") == pytest.approx(0.5**0.5)
    assert semantic.compare(None, None) == 0.0 and semantic.compare("x", "x") == 1.0
    judge = scalars.Judged(judge=lambda p: "TRUE" if p.count("cat") == 2 else "false")
    assert judge.compare("cat", "cat") == 1.0 and judge.compare("cat", "dog") == 0.0 and judge.compare(None, None) == 1.0
    with pytest.raises(ZeroDivisionError):
        scalars.Judged(judge=lambda p: 1 / 0).compare("a", "b")
    with pytest.raises(ValueError):
        scalars.Numeric(tolerance=1, absolute_tolerance=1)
    with pytest.raises(TypeError):
        scalars.Levenshtein().compare({}, "a")


def test_registry():
    class Always(scalars.Comparator):
        name = "Always"

        def compare(self, a, b):
            return 1.0

    scalars.register("Always", Always)
    assert scalars.create("Always").compare(1, 2) == 1.0
    with pytest.raises(KeyError):
        scalars.create("Nothing")
    with pytest.raises(TypeError):
        scalars.register("x", int)


def test_assignment_against_all_permutations():
    rnd = random.Random(2)
    for _ in range(200):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        s = [[rnd.choice([0, 0.25, 0.5, 1, rnd.random()]) for _ in range(m)] for _ in range(n)]
        pairs = assignment.assign(s)
        if n <= m:
            best = max(sum(s[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(s[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert len(pairs) == min(n, m)
        assert sum(s[i][j] for i, j in pairs) == pytest.approx(best)


def test_list_metrics():
    same = lambda a, b: float(a == b)
    m = assignment.list_metrics(["apple", "banana", "cherry"], ["banana", "cherry", "date"], same)
    assert (m["tp"], m["fp"], m["fn"]) == (2, 1, 1) and m["f1"] == pytest.approx(2 / 3)
    m = assignment.list_metrics(list("abcd"), list("abc"), same)
    assert (m["precision"], m["recall"]) == (1.0, 0.75)
    assert assignment.list_metrics([], [], same)["f1"] == 1.0
    m = assignment.list_metrics(["a"], ["b"], same)
    assert (m["tp"], m["fp"], m["fn"]) == (0, 1, 1)
    assert assignment.list_metrics(["a"], ["b"], lambda a, b: 0.1)["tp"] == 1


def test_cosine_and_null_predicates(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], None, []), ([0.0], [1.0], "  ", None)], "a array<double>, b array<double>, s string, l array<string>")
    got = df.select(columns.cosine(F.col("a"), F.col("b")), columns.is_empty_value(F.col("s")), columns.is_blank(F.col("s")), columns.is_empty_list(F.col("l"))).collect()
    assert got[0][0] == pytest.approx(0.5**0.5) and got[1][0] == 0.0
    assert [tuple(r[1:]) for r in got] == [(True, True, True), (False, True, True)]
