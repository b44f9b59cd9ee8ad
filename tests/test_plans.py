"""What plans must not do at size: make rows twice, or write an expression out over and over."""

import __spark_entry__ as driver

from .conftest import DATA


def optimized(spark, name, sf="sf0.001"):
    return driver.queries()[name](spark, f"{DATA}/{sf}")._jdf.queryExecution().optimizedPlan().toString().splitlines()


def filters_of_rows(plan):
    """Filters that make the rows of documents to see that there are some."""
    return [x for x in plan if x.strip(" +-:").startswith("Filter") and "size(" in x]


def test_documents_rows_are_not_made_in_a_filter_of_the_scan(spark):
    assert filters_of_rows(optimized(spark, "compare_documents_native")) == []


def test_undeclared_keys_are_not_counted_in_a_filter_of_the_scan(spark):
    assert filters_of_rows(optimized(spark, "undeclared_keys")) == []


def test_evaluator_rows_compare_once(spark):
    plan = optimized(spark, "evaluator_documents")
    assert filters_of_rows(plan) == [] and sum("Relation [" in x for x in plan) == 1


def test_documents_that_come_again_are_settled_without_python(spark, tmp_path):
    from gaugeflow.functions.scalars import Exact
    from gaugeflow.plans.spec import FieldSpec, ModelSpec
    from gaugeflow.streaming import documents

    side = "struct<kind: string>"
    # The newest of d is right, a null id and a null version are arrivals like others.
    sent = [("d", 1, ("a",), ("b",)), ("d", 2, ("a",), ("a",)), ("d", 1, ("a",), ("c",)), (None, None, ("a",), ("b",)), ("e", None, ("a",), None)]
    spark.createDataFrame(sent, f"doc_id string, v long, expected {side}, predicted {side}").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"doc_id string, v long, expected {side}, predicted {side}").parquet(str(tmp_path / "in"))
    query = documents.start(documents.arrivals(stream, ModelSpec("Kind", [FieldSpec("kind", "str", Exact(), 1.0)]), "v"), str(tmp_path / "t"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert {o.operatorName for o in query.lastProgress.stateOperators} == {"stateStoreSave"}
    got = {r.path: (r.documents, r.tp, r.fd, r.fn) for r in documents.saved(spark, str(tmp_path / "t")).select("path", "documents", "tp", "fd", "fn").collect()}
    assert got == {"": (3, 1, 1, 1), "kind": (3, 1, 1, 1)}


def test_model_comparator_makes_no_rows_in_a_filter(spark):
    assert filters_of_rows(optimized(spark, "model_comparator")) == []


def test_lists_are_not_prepared_to_see_that_they_are_not_empty(spark):
    from pyspark.sql import functions as F

    from gaugeflow.operators import nested
    from gaugeflow.plans.catalogue import BUYER, PURCHASE

    for model, path, pairs in ((BUYER, "orders", lambda d: nested._met(d, "orders", ["~row"], "i", "j")), (PURCHASE, "items", lambda d: nested._cell_pairs(d, PURCHASE.fields[1], "items", ["~row"]))):
        row = spark.createDataFrame([], f"`~row` long, a {model.schema().simpleString()}, b {model.schema().simpleString()}")
        ready = row.select("`~row`", *[nested.ready(model, F.col(c)).alias(n) for c, n in (("a", "x"), ("b", "y"))])
        plan = pairs(ready)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [x for x in plan if x.strip(" +-:").startswith("Filter")]
        assert filters and not any("transform(" in x for x in filters), path
