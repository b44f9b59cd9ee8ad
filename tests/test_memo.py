from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Judged, Scored
from gaugeflow.operators import compare, memo
from gaugeflow.plans.spec import FieldSpec, ModelSpec


def share(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


ROWS = [(k, a, b) for k, (a, b) in enumerate([("ab", "abc"), ("ab", "abc"), ("abc", "ab"), ("x", "x"), (None, None), (None, "x"), ("x", None), ("a", "bc"), ("ab", "c"), ("", "x")] * 6)]


def counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(pairs):
        calls.add(len(pairs))
        return [share(a, b) if a and b else 0.0 for a, b in pairs]

    return calls, ask


def test_each_distinct_pair_is_asked_about_once(spark, tmp_path):
    calls, ask = counted(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, a string, b string").repartition(4)
    held = memo.Memo(spark, str(tmp_path / "m"))
    want = {k: 1.0 if a == b else 0.0 if a is None or b is None or not a or not b else share(a, b) for k, a, b in ROWS}
    got = memo.score(df, held, ask, "a", "b", batch=2).collect()
    assert {r.doc_id: r.score for r in got} == want and len(got) == len(ROWS)
    assert calls.value == len({(a, b) for _, a, b in ROWS if a is not None and b is not None and a != b}) == 5
    # Another session's table, with one pair that is new.
    more = spark.createDataFrame([*ROWS, (99, "abc", "abd"), (99, "abc", "abd")], "doc_id long, a string, b string")
    again = memo.score(more, memo.Memo(spark, str(tmp_path / "m")), ask, "a", "b")
    assert calls.value == 6 and again.count() == len(ROWS) + 2 and calls.value == 6
    assert [r.score for r in again.where("doc_id = 99").collect()] == [0.5, 0.5]
    # Other settings are other questions.
    memo.score(df, held, ask, "a", "b", settings={"threshold": 1}).count()
    assert calls.value == 11
    none = memo.score(df.limit(0), held, ask, "a", "b")
    assert none.count() == 0 and calls.value == 11


def test_what_fails_is_null_and_asked_again(spark, tmp_path):
    tries = spark.sparkContext.accumulator(0)

    def broken(pairs):
        tries.add(1)
        raise ConnectionError("gone")

    df = spark.createDataFrame(ROWS[:10], "doc_id long, a string, b string").coalesce(1)
    held = memo.Memo(spark, str(tmp_path / "m"))
    got = {r.doc_id: r.score for r in memo.score(df, held, broken, "a", "b", attempts=3, wait=0.0).collect()}
    assert got[0] is None and got[3] == 1.0 and got[5] == 0.0 and tries.value % 3 == 0
    assert {r.error for r in held.failures().collect()} == {"ConnectionError: gone"} and held.failures().count() == 5
    calls, ask = counted(spark)
    assert {r.doc_id: r.score for r in memo.score(df, held, ask, "a", "b").collect()}[0] == share("ab", "abc")
    assert calls.value == 5 and held.failures().count() == 0
    assert memo.with_retries(lambda p: [1.0], [("a", "b"), ("c", "d")], 1, 0.0) == ([None, None], "ValueError: 1 scores for 2 pairs")


def test_records_with_a_judge_equal_the_row_evaluator(spark, tmp_path):
    judge = Judged(judge=lambda prompt: "TRUE" if "red" in prompt.split("First")[1].split("Second")[1] else "no")
    inner = ModelSpec("Inner", [FieldSpec("c", "str", judge, 1.0, optional=True)])
    model = ModelSpec("Doc", [FieldSpec("a", "str", Scored(function=share), 0.6, optional=True), FieldSpec("k", "str", Exact(), 1.0), FieldSpec("in", "struct", model=inner, threshold=0.7, optional=True)])
    side = "struct<a: string, k: string, in: struct<c: string>>"
    values = [("abc", "x", ("red",)), ("abd", "x", ("blue",)), ("", "y", None), (None, "y", ("red",)), ("xyz", "x", (None,))]
    pairs = spark.createDataFrame([(f"{i}-{j}", a, b) for i, a in enumerate(values) for j, b in enumerate(values)], f"doc_id string, expected {side}, predicted {side}")
    key = lambda df: sorted((r.doc_id, r.path, r.tp, r.fa, r.fd, r.tn, r.fn, round(r.raw, 9), round(r.applied, 9)) for r in df.collect())
    held = memo.Memo(spark, str(tmp_path / "m"))
    # The row evaluator asks the judge about equal values too, the memo takes them as equal.
    different = pairs.where(~F.coalesce(F.col("expected.in.c") == F.col("predicted.in.c"), F.lit(False)))
    found = memo.compare_records(different, model, held)
    assert held.failures().collect() == []
    assert key(found) == key(compare.compare_documents(different, model))
    assert [".".join(n) for n, _ in memo.asked_fields(model)] == ["a", "in.c"]
