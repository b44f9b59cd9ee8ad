import random

from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Numeric
from gaugeflow.operators import flat, metrics
from gaugeflow.plans.spec import FieldSpec, ModelSpec
from gaugeflow.streaming import documents

INNER = ModelSpec("Inner", [FieldSpec("y", "str", Exact(), 1.0, optional=True)])
MODEL = ModelSpec("Sent", [FieldSpec("kind", "str", Exact(), 1.0), FieldSpec("amount", "float", Numeric(), 1.0), FieldSpec("in", "struct", model=INNER, threshold=0.7, optional=True)])
SIDE = "struct<kind: string, amount: double, in: struct<y: string>>"
SCHEMA = f"doc_id string, v long, expected {SIDE}, predicted {SIDE}"


def side(rnd):
    return (rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, None]), rnd.choice([None, ("p",), ("q",)]))


def sent(rnd, documents_, versions):
    """Every version of every document, some twice."""
    rows = [(f"d{k}" if k else None, v if v else None, side(rnd), side(rnd)) for k in range(documents_) for v in range(rnd.randint(1, versions))]
    rows += rnd.sample(rows, len(rows) // 2)
    rnd.shuffle(rows)
    return rows


def batch_totals(df):
    """The totals of each document's newest arrival, without a stream."""
    rows = documents.arrivals(df, MODEL, "v")
    best = rows.groupBy("doc_id").agg(F.max(F.struct("version", "content")).alias("m"))
    held = rows.alias("r").join(best.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.struct("version", "content") == F.col("m"))).select("r.*").distinct()
    return sorted((r.path, *[r[c] for c in metrics.COUNTS]) for r in metrics.bulk(held).collect())


def totals(spark, folder):
    return sorted((r.path, *[r[c] for c in metrics.COUNTS]) for r in documents.saved(spark, folder).collect())


def run(spark, tmp_path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    documents.start(documents.arrivals(stream, MODEL, "v"), str(tmp_path / name), str(tmp_path / f"cp_{name}")).awaitTermination()


def test_restarted_stream_with_repeats_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = sent(rnd, 40, 4)
    cut = len(rows) * 2 // 3
    write = lambda part, n: spark.createDataFrame(part, SCHEMA).repartition(n).write.mode("append").parquet(str(tmp_path / "in"))
    write(rows[:cut], 3)
    run(spark, tmp_path, "t")
    first = spark.createDataFrame(rows[:cut], SCHEMA)
    assert totals(spark, str(tmp_path / "t")) == batch_totals(first)
    # More arrives, all of the old among it: the same query goes on where it was.
    write(rows, 2)
    run(spark, tmp_path, "t")
    want = batch_totals(spark.createDataFrame(rows, SCHEMA))
    assert totals(spark, str(tmp_path / "t")) == want
    # Nothing new: nothing changes.
    run(spark, tmp_path, "t")
    assert totals(spark, str(tmp_path / "t")) == want
    top = documents.saved(spark, str(tmp_path / "t")).where("path = ''").first()
    assert top.documents == 40
    assert {r.path for r in documents.saved(spark, str(tmp_path / "t")).collect()} <= {"", *MODEL.paths()}


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    """What a failure after writing does: the last batch's commit is lost, so it runs again."""
    rows = sent(random.Random(6), 12, 3)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path, "t")
    before = totals(spark, str(tmp_path / "t"))
    commits = sorted((tmp_path / "cp_t" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path, "t")
    assert totals(spark, str(tmp_path / "t")) == before == batch_totals(spark.createDataFrame(rows, SCHEMA))


def test_no_arrivals(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path, "t")
    (tmp_path / "t").mkdir(exist_ok=True)
    assert documents.saved(spark, str(tmp_path / "t")).count() == 0


def test_one_version_with_two_contents_is_settled_alike():
    import pandas as pd

    columns = ["version", "content", "path", *metrics.COUNTS]
    a = [(1, 5, "", 1, 0, 0, 0, 0, 0), (1, 5, "kind", 1, 0, 0, 0, 0, 0)]
    b = [(1, 9, "", 0, 0, 1, 1, 0, 0)]
    both = [documents.newest([pd.DataFrame(x + y, columns=columns)]) for x, y in ((a, b), (b, a), (a + b, a))]
    assert both == [((1, 9), {"": [0, 0, 1, 1, 0, 0]})] * 3
    assert flat.supports(MODEL)
