import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers are started by the JVM, which takes this environment over.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.gaugeflow.release", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def duck(sf: str):
    """DuckDB with the tables of a size as views."""
    import duckdb

    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    return db


def rows_of(columns, rows):
    def plain(v):
        return round(float(v), 5) if isinstance(v, float) or hasattr(v, "quantize") else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([columns[k] for k in order], *[tuple(plain(r[k]) for k in order) for r in rows])[1:], key=repr)


def same_as_sql(spark, query, sql, sf="sf0.001"):
    """The query's rows and DuckDB's, in one order."""
    df = query(spark, f"{DATA}/{sf}")
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck(sf).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    return ours, rows_of(names, result.fetchall())
