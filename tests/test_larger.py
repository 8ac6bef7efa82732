"""Queries on segments against their SQL where an index has more segments than the SQL looks at: 132 on 15,000 orders instead of 180 on 9,000,000."""

import os
import random

import duckdb
import pytest
from test_oracles import plain

import __spark_entry__ as entry
from latticework import queries
from latticework.operators import index, mutate
from latticework.plans import spec

ORDERS = "/root/testdata/sf0.01/orders.parquet"
ROWS = 113


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """A folder of its own, so that no other test meets the index that is built for it."""
    folder = str(tmp_path_factory.mktemp("larger"))
    os.symlink(ORDERS, f"{folder}/orders.parquet")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spec, "SEGMENT_ROWS", ROWS)
        assert queries.orders_index(spark, folder).models.count() > queries.CUTS + 1
    return folder


@pytest.mark.parametrize("name", ["delete_pages", "index_segments", "index_totals", "insert_pages", "model_checks", "segment_sizes"])
def test_query_equals_sql_on_many_segments(spark, larger, name):
    got = entry.queries()[name](spark, larger)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{ORDERS}'")
    want = duck.sql(entry.oracle_sql()[name].replace("// 50000", f"// {ROWS}"))
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_new_points_are_placed_over_runs(spark, monkeypatch):
    """One large segment with frequent mappings, one without new points, one without pages; runs of four rows."""
    monkeypatch.setattr(index, "RUN_BITS", 2)
    rng = random.Random(5)
    lows = {0: sorted(float(rng.randint(10, 90)) for _ in range(60)), 1: [3.0, 4.0]}
    rows = [(i, 0, float(rng.choice([50, rng.randint(0, 99)]))) for i in range(400)] + [(400 + i, 2, float(i)) for i in range(9)]
    pages = spark.createDataFrame([(s, p, m) for s, ms in lows.items() for p, m in enumerate(ms, 7)], "segment long, page long, low_m double")
    got = mutate.placed(pages, spark.createDataFrame(rows, "id long, segment long, m double")).collect()
    below = lambda s, m: max([p for p, x in enumerate(lows.get(s, []), 7) if x <= m], default=7 if s in lows else 0)
    assert sorted((r["id"], r["segment"], r["m"], r["page"]) for r in got) == [(i, s, m, below(s, m)) for i, s, m in rows]
