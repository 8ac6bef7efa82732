"""Dominance by a merge tree: equal to all pairs, with about n log n rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import checks


def plain(rows):
    seen = [r for r in sorted(rows) if None not in r and not any(v != v for v in r)]
    return sum(any(a > x and b > y for _, a, b in seen[:i]) for i, (_, x, y) in enumerate(seen))


KINDS = {
    "random": lambda i, r: (r.random(), r.random()),
    "ties": lambda i, r: (float(r.randint(0, 3)), float(r.randint(0, 3))),
    "falling": lambda i, r: (-float(i), -float(i)),
    "rising": lambda i, r: (float(i), float(i)),
    "stairs": lambda i, r: (float(i), -float(i)),
    "one": lambda i, r: (1.0, 1.0),
    "odd": lambda i, r: (r.choice([None, float("nan"), float("inf"), 1.0, 2.0]), r.choice([None, 1.0, 2.0, -float("inf")])),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("bits", [2, 16])
def test_violations_equal_all_pairs(spark, monkeypatch, kind, bits):
    monkeypatch.setattr(checks, "LABEL_BLOCK", 16)
    monkeypatch.setattr(checks, "RUN_BITS", bits)
    rng = random.Random(1)
    rows = [(7 * i, *KINDS[kind](i, rng)) for i in range(150)]
    df = spark.createDataFrame(rows, "l long, a double, b double").repartition(3)
    assert checks.dominance_violations(df, "l", "a", "b").first()["n"] == plain(rows)


def test_violations_of_few_rows(spark):
    for rows in ([], [(1, 2.0, 3.0)], [(1, 2.0, 3.0), (2, 1.0, 1.0)]):
        assert checks.dominance_violations(spark.createDataFrame(rows, "l long, a double, b double"), "l", "a", "b").first()["n"] == plain(rows)


def test_halves_equal_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 31, 64, 200):
        for x, y in ((rng.random(n), rng.random(n)), (rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float))):
            want = np.array([((x[:i] > x[i]) & (y[:i] > y[i])).any() for i in range(n)])
            assert (checks.dominated_later(x, y) == want).all()
            steps = checks.staircase(x, y)
            assert len({(x[i], y[i]) for i in steps}) == len(steps)
            for i in range(n):
                assert i in steps or ((x >= x[i]) & (y >= y[i]) & (np.arange(n) != i)).any()


def test_rows_grow_as_n_log_n(spark):
    """Stairs are the worst case: every point is a step of its block."""
    def rows(blocks):
        df = spark.range(blocks * 8).select(F.floor(F.col("id") / 8).alias("block"), F.col("id").alias("nth"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"), F.lit(True).alias("step"))
        return checks.merge_rows(df).count()

    assert [rows(b) for b in (2, 4, 8, 64)] == [b * 8 * bits for b, bits in ((2, 1), (4, 2), (8, 3), (64, 6))]


def test_only_open_points_meet_other_blocks(spark, monkeypatch):
    """Of a falling sequence each block settles all points but its first."""
    met = []
    inner = checks.merge_rows
    monkeypatch.setattr(checks, "LABEL_BLOCK", 16)
    monkeypatch.setattr(checks, "merge_rows", lambda df: met.append(df.count()) or inner(df))
    rows = [(i, -float(i), -float(i)) for i in range(160)]
    assert checks.dominance_violations(spark.createDataFrame(rows, "l long, a double, b double"), "l", "a", "b").first()["n"] == 159
    assert met == [10]


def test_tasks_of_the_check_follow_the_rows(spark, monkeypatch):
    """Of stairs every point stays open; each shuffle deals them to as many tasks as they need."""
    made = {}
    in_order, saved = checks.in_order, checks.saved
    monkeypatch.setattr(checks, "in_order", lambda *a: made.setdefault("order", in_order(*a)))
    monkeypatch.setattr(checks, "saved", lambda *a: made.setdefault("blocks", saved(*a)))
    monkeypatch.setattr(checks, "LABEL_BLOCK", 4)
    monkeypatch.setattr(checks, "RUN_BITS", 2)
    monkeypatch.setattr("latticework.operators.ranks.TASK_ROWS", 64)
    rows = [(i, float(i), -float(i)) for i in range(640)]
    got = checks.dominance_violations(spark.createDataFrame(rows, "l long, a double, b double"), "l", "a", "b")
    assert got.first()["n"] == 0
    assert made["blocks"].groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0] <= 192
    assert made["order"].groupBy(F.shiftright("__at", 33)).count().agg(F.max("count")).first()[0] <= 192
    dealt = re.findall(r"hashpartitioning\(level#\d+, group#\d+L?, run#\d+L?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())
    assert dealt and set(dealt) == {str(640 * 8 // 64)}
