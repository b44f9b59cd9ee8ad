import collections
import itertools
import json
import random

import pytest

import __spark_entry__ as driver
from gaugeflow.operators import compare, metrics
from gaugeflow.plans import catalogue

from .conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    ours, theirs = same_as_sql(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert ours == theirs


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def _best(matrix):
    """Total and pairs of the best assignment, by trying all."""
    n, m = len(matrix), len(matrix[0])
    if n > m:
        total, pairs = _best([list(r) for r in zip(*matrix)])
        return total, [(i, j) for j, i in pairs]
    return max((sum(matrix[i][j] for i, j in enumerate(p)), list(enumerate(p))) for p in itertools.permutations(range(m), n))


def test_lists_in_lists_against_all_pairings(spark):
    """Customers with few orders of few items: counts of every path again, by trying every pairing at both levels."""
    d = f"{DATA}/sf0.001"
    rnd = random.Random(3)
    item = catalogue.ITEM

    def items():
        return [{"flag": rnd.choice("AB"), "quantity": float(rnd.randint(1, 3)), "name": f"part {rnd.randint(1, 40)}"} for _ in range(rnd.randint(1, 3))]

    def changed(orders):
        out = [{"key": o["key"], "items": [dict(x, flag=rnd.choice("AB")) for x in o["items"] if rnd.random() < 0.9] or o["items"]} for o in orders if rnd.random() < 0.8]
        rnd.shuffle(out)
        return out

    docs = []
    for k in range(40):
        orders = [{"key": 100 * k + j, "items": items()} for j in range(rnd.randint(1, 3))]
        docs.append((k, {"segment": "S", "orders": orders}, {"segment": rnd.choice("ST"), "orders": changed(orders)}))
    pairs = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in docs], "doc_id long, expected string, predicted string")
    got = {r["path"]: (r.tp, r.fd, r.fa, r.fn) for r in metrics.bulk(compare.compare_documents(pairs, catalogue.BUYER)).collect()}

    def leaf(f, x, y):
        return f.comparator.compare(x[f.name], y[f.name])

    def alike_items(x, y):
        return sum(f.weight * leaf(f, x, y) for f in item.fields) / 4

    def gated(f, x, y):
        s = leaf(f, x, y)
        return s if s >= f.threshold else 0.0

    def list_score(a, b, used):
        pairs = _best([[alike_items(x, y) for y in b] for x in a])[1]
        good = [s for s in (used(a[i], b[j]) for i, j in pairs) if s >= 0.01]
        return pairs, sum(good) / max(len(a), len(b))

    applied = lambda x, y: sum(f.weight * gated(f, x, y) for f in item.fields) / 4
    want = collections.Counter()
    for _, a, b in docs:
        want["segment", 0 if a["segment"] == b["segment"] else 1] += 1
        x, y = a["orders"], b["orders"]
        if not y:
            want["orders", 3] += len(x)
            continue
        matrix = [[(float(o["key"] == p["key"]) + 2 * list_score(o["items"], p["items"], applied)[1]) / 3 for p in y] for o in x]
        found = [(i, j) for i, j in _best(matrix)[1] if len(x) > 1 or len(y) > 1 or matrix[i][j] > 0]
        good = [(i, j) for i, j in found if matrix[i][j] >= 0.7]
        want["orders", 0] += len(good)
        want["orders", 1] += len(found) - len(good)
        want["orders", 2] += len(y) - len(found)
        want["orders", 3] += len(x) - len(found)
        for i, j in good:
            pairs, _ = list_score(x[i]["items"], y[j]["items"], applied)
            inner = [(p, q) for p, q in pairs if alike_items(x[i]["items"][p], y[j]["items"][q]) >= 0.8]
            want["orders.items", 0] += len(inner)
            want["orders.items", 1] += len(pairs) - len(inner)
    for path in ("segment", "orders", "orders.items"):
        assert got[path][:2] == (want[path, 0], want[path, 1]), path
    assert got["orders"][2:] == (want["orders", 2], want["orders", 3])
    assert catalogue.queries()["nested_list_depth3"](spark, d).count() > 5


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 3 and set(driver.oracle_sql()) <= set(driver.queries())
