import json

from pyspark.sql import functions as F

from gaugeflow.operators import metrics
from gaugeflow.report import page, tables
from gaugeflow.streaming import bulk as streams

ROWS = [("", 6, 1, 2, 3, 1, 1), ("name", 4, 0, 1, 1, 0, 1), ("items.sku", 2, 1, 1, 2, 1, 0)]


def totals(spark):
    return spark.createDataFrame(ROWS, "path string, tp long, fa long, fd long, fp long, tn long, fn long")


def test_reports(spark, tmp_path):
    errors = spark.createDataFrame([("ValueError", 2)], "error_type string, n long")
    bad = spark.createDataFrame([("1", "name", "false_alarm", None, "<b>", "unmatched prediction")], "doc_id string, field_path string, type string, gt string, pred string, reason string")
    r = tables.collect(totals(spark), 7, errors, non_matches=bad)
    assert r.metrics["precision"] == 6 / 9 and r.errors == {"ValueError": 2}
    assert "| name |" in r.to_markdown() and "sku" in tables.text_report(r, sort_by="f1") and "sku" not in tables.text_report(r, only="^name")
    r.save(str(tmp_path / "m.json"))
    assert json.load(open(tmp_path / "m.json"))["document_count"] == 7
    page.write(r, str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in text and "Confusion matrix" in text and "<b>" not in text
    assert page.colour(0.9) != page.colour(0.1)
    a = tables.arguments(["--input_csv", "x.csv", "--truncate", "5"])
    assert (a.input_csv, a.truncate, a.true_column) == ("x.csv", 5, "expected")


def test_derived_definitions(spark):
    plain = {r.path: r for r in metrics.derived(totals(spark)).collect()}
    strict = {r.path: r for r in metrics.derived(totals(spark), recall_with_fd=True).collect()}
    assert plain[""].recall == 6 / 7 and strict[""].recall == 6 / 9 and plain[""].accuracy == 7 / 11
    none = metrics.derived(totals(spark).select("path", *[F.lit(0).cast("long").alias(c) for c in metrics.COUNTS])).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("path"), *[(F.col("id") % (k + 2)).alias(c) for k, c in enumerate(metrics.COUNTS)], F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int),0)").alias("ts"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = streams.start(streams.running_totals(source), "totals_test", str(tmp_path / "cp"))
    query.awaitTermination()
    key = lambda d: sorted(tuple(r) for r in d.select("path", *metrics.COUNTS).collect())
    assert key(spark.table("totals_test")) == key(metrics.bulk(df))
    seen = []
    streams.each_batch(streams.running_totals(source), lambda d, k: seen.append(d.count()), str(tmp_path / "cp2")).awaitTermination()
    assert seen and max(seen) == 3
    wide = streams.windowed_totals(df, "ts")
    assert wide.agg(F.sum("tp")).first()[0] == df.agg(F.sum("tp")).first()[0]
