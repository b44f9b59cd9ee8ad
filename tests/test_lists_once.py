"""Lists are matched once, with what concerns one element made once for it."""

import numpy as np

from gaugeflow.functions import assignment
from gaugeflow.functions import columns as C
from gaugeflow.operators import lists

from .test_plans import optimized

FIELDS = [("flag", C.exact, 1.0), ("name", C.levenshtein, 1.0)]
ROWS = "array<struct<flag: string, name: string>>"


def test_field_counts_of_lists_match_once(spark):
    assert sum("Relation [" in x for x in optimized(spark, "list_field_confusion")) == 1


def test_field_counts_of_blank_and_unmatched_elements(spark):
    gt, pred = [("a", " "), ("b", "zz"), ("c", None)], [("a", "x"), ("b", "zz")]
    df = spark.createDataFrame([(1, gt, pred), (1, gt, pred), (2, None, pred), (3, [], None)], f"doc_id long, gt {ROWS}, pred {ROWS}")
    _, fields = lists.list_confusion(df, "gt", "pred", FIELDS, 0.5)
    got = sorted((r.doc_id, r.field, r.tp, r.fa, r.fd, r.tn, r.fn, r.fp) for r in fields.collect())
    # Each row is a document, also where ids repeat.
    one = [(1, "flag", 2, 0, 0, 0, 1, 0), (1, "name", 1, 1, 0, 0, 0, 1)]
    assert got == sorted([*one, *one, (2, "flag", 0, 2, 0, 0, 0, 2), (2, "name", 0, 2, 0, 0, 0, 2), *[(3, f, 0, 0, 0, 0, 0, 0) for f in ("flag", "name")]])


def test_own_best_partners_are_what_all_assignments_give():
    rnd = np.random.default_rng(1)
    settled = 0
    for t in range(400):
        n, m = rnd.integers(1, 6, 2)
        stack = rnd.integers(0, k := rnd.integers(2, 60), (8, n, m)) / k
        # Cells that are equal to within what counts as equal.
        stack = stack + rnd.integers(0, 4, stack.shape) * 5e-10 if t % 3 == 0 else stack
        assert (assignment.solve_stack(stack) == assignment._solve_open(stack)).all()
        settled += assignment._own_best(stack)[0].sum()
    assert settled > 500
