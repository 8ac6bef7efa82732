"""Stored indexes: tied to their input, resumed where they stopped, and changed by inserts and deletes."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import plain

import __spark_entry__ as entry
from latticework.operators import grid, index, layout, mutate, search
from latticework.sources import files, store, versions

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def points(spark, rows):
    return spark.createDataFrame([(i, x if x is None else float(x), y if y is None else float(y)) for i, x, y in rows], "id long, x double, y double")


def equal_to_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    return sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_queries_follow_a_table_that_is_replaced(spark, tmp_path):
    orders, folder = spark.read.parquet(ORDERS), str(tmp_path)
    states = [orders.filter("o_orderkey % 3 = 0"), orders, orders.withColumn("o_totalprice", F.col("o_totalprice") + 7)]
    for state in states:
        state.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
        for name in ("index_totals", "range_count_2d", "index_range_query", "index_after_insert", "index_after_delete", "page_occupancy"):
            assert equal_to_sql(spark, folder, name), name


def test_a_stopped_build_goes_on(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    p = points(spark, [(i, *rng.uniform(0, 9, 2)) for i in range(900)])
    path, sizes = f"{tmp_path}/index", {"parts": 4, "page_size": 20, "segments": 5}

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(layout, "with_shard", stop)
        with pytest.raises(KeyboardInterrupt):
            store.build_index(p, ("x", "y"), "id", path, **sizes)
    assert store.open_index(spark, path) is None
    with monkeypatch.context() as m:
        for owner, name in ((layout, "train_models"), (layout, "segment_bounds"), (grid, "with_mapping"), (grid, "build_grid")):
            m.setattr(owner, name, stop)
        assert store.build_index(p, ("x", "y"), "id", path, **sizes).points.count() == 900
        monkeypatch.setattr(layout, "with_shard", stop)
        again = store.build_index(p, ("x", "y"), "id", path, **sizes)
    assert again.points.count() == 900 and again.version == 0


def test_a_changed_size_redoes_what_depends_on_it(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = points(spark, [(i, *rng.uniform(0, 9, 2)) for i in range(500)])
    path = f"{tmp_path}/index"
    made = lambda: Counter(n.partition("-")[0] for n in os.listdir(path))
    store.build_index(p, ("x", "y"), "id", path, parts=4, page_size=20, segments=5)
    store.build_index(p, ("x", "y"), "id", path, parts=4, page_size=20, segments=5, knots=3)
    assert [made()[s] for s in ("bounds", "mapped", "segmented", "models", "points")] == [1, 1, 1, 2, 2]
    store.build_index(p.filter("id <> 7"), ("x", "y"), "id", path, parts=4, page_size=20, segments=5, knots=3)
    assert [made()[s] for s in ("bounds", "mapped", "segmented", "models", "points")] == [2, 2, 2, 3, 3]
    assert store.open_index(spark, path).points.count() == 499
    assert len(versions.vacuum(spark, path)) > 5 and store.open_index(spark, path).points.count() == 499


def test_tokens(spark, tmp_path):
    p = points(spark, [(1, 1, 2), (2, None, 3), (2, None, 3)])
    assert store.source_token(p) == store.source_token(p.orderBy(F.desc("id")).repartition(3)) != store.source_token(p.distinct())
    p.write.parquet(f"{tmp_path}/a b%20c")
    read = lambda: spark.read.parquet(f"{tmp_path}/a b%20c").filter("id > 0")
    first = store.source_token(read())
    assert first == store.source_token(read())
    p.write.mode("append").parquet(f"{tmp_path}/a b%20c")
    assert first != store.source_token(read())


def check(spark, path, want, page_size, fits=True):
    """The newest version against a bag of (id, x, y): rows, directory, look-ups, and queries through it."""
    ix = store.open_index(spark, path)
    rows = ix.points.collect()
    assert Counter((r["id"], r["x"], r["y"]) for r in rows) == Counter(want)
    listed = {r["page"]: (r["n"], r["low_m"], r["high_m"], r["segment"], r["shard"], r["block"]) for r in ix.pages.collect()}
    own = {}
    for r in rows:
        own.setdefault(r["page"], []).append(r)
    assert listed == {p: (len(o), min(r["m"] for r in o), max(r["m"] for r in o), o[0]["segment"], o[0]["shard"], o[0]["block"]) for p, o in own.items()}
    assert all(len({(r["segment"], r["shard"], r["block"]) for r in o}) == 1 for o in own.values()) and max(map(len, own.values()), default=0) <= page_size
    spans = sorted((l[1], l[2], p) for p, l in listed.items())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    rng = random.Random(len(want))
    boxes = [(q, sorted(rng.uniform(-5, 105) for _ in range(2)), sorted(rng.uniform(-5, 105) for _ in range(2))) for q in range(25)] + [(25, [50, 50], [50, 50]), (26, [-1e9, 1e9], [-1e9, 1e9]), (27, [250, 400], [-90, -3]), (28, [-50, 400], [-90, -20]), (29, [300, 300], [-20, -20])]
    frame = spark.createDataFrame([(q, [float(x[0]), float(y[0])], [float(x[1]), float(y[1])]) for q, x, y in boxes], "qid int, lo array<double>, hi array<double>")
    got = {r["qid"]: r["n"] for r in search.range_count(ix, frame, ix.grid).collect()}
    inside = lambda x, y: sum(1 for _, a, b in want if a is not None and b is not None and x[0] <= a <= x[1] and y[0] <= b <= y[1])
    assert got == {q: inside(x, y) for q, x, y in boxes}
    centres = [(0, 290.0, -30.0), (1, 50.0, 50.0), (2, -500.0, 3.0)]
    near = search.knn_pages(ix, spark.createDataFrame(centres, "qid int, c0 double, c1 double"), 3, "id").collect()
    apart = {q: sorted(((x - a) ** 2 + (y - b) ** 2, i) for i, x, y in want if x is not None and y is not None)[:3] for q, a, b in centres}
    assert sorted((r["qid"], round(r["dist"], 6)) for r in near) == sorted((q, round(d**0.5, 6)) for q, found in apart.items() for d, _ in found)
    return ix


def test_inserts_and_deletes_are_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_FOLDERS", 3)
    rng = random.Random(5)
    path = f"{tmp_path}/index"
    draw = lambda: rng.choice([(50, 50), (round(rng.uniform(0, 100), 2), round(rng.uniform(0, 100), 2)), (rng.randint(0, 9), rng.randint(0, 9)), (None, rng.randint(0, 3))])
    rows = [(i, *draw()) for i in range(700)]
    store.build_index(points(spark, rows), ("x", "y"), "id", path, parts=4, page_size=12, segments=6)
    check(spark, path, rows, 12)
    first = store.open_index(spark, path)
    following = 1000
    seen = [Counter(rows)]
    for step in range(3):
        if step % 2 == 0:
            new = [(following + i, *draw()) for i in range(150)] + [(following, 300.0, -20.0), (following, 50.0, 50.0)]
            following += 200
            new.append((1, 2.0, None))
            versions.insert(spark, path, points(spark, new).withColumn("more", F.lit(1)))
            rows = rows + new
        else:
            gone = [r[1:] for r in rng.sample(rows, 200)] + [(50, 50)] * 30 + [(1234.5, 1.0)]
            versions.delete(spark, path, points(spark, [(0, *g) for g in gone]).select("y", "x"))
            for g in gone:
                same = sorted(r for r in rows if r[1:] == g)
                if same:
                    rows.remove(same[0])
        seen.append(Counter(rows))
        check(spark, path, rows, 12)
    bag = lambda df: Counter((r["id"], r["x"], r["y"]) for r in df.collect())
    assert bag(first.points) == seen[0] and bag(store.open_index(spark, path, 0).points) == seen[0]
    held = store.manifest(spark, path)
    assert len(held["points"]) <= 3
    versions.compact(spark, path)
    check(spark, path, rows, 12)
    held = store.manifest(spark, path)
    assert held["retired"] == [] and len(held["points"]) == 2
    # everything away, and back
    versions.delete(spark, path, points(spark, rows))
    check(spark, path, [], 12)
    versions.insert(spark, path, points(spark, rows[:90]))
    check(spark, path, rows[:90], 12)
    versions.vacuum(spark, path)
    check(spark, path, rows[:90], 12)


def test_neighbours_merge_from_left_to_right(spark, tmp_path):
    path = f"{tmp_path}/index"
    store.build_index(points(spark, [(i, i % 10, i // 10) for i in range(600)]), ("x", "y"), "id", path, parts=2, page_size=10, segments=3)
    ix = versions.delete(spark, path, points(spark, [(0, i % 10, i // 10) for i in range(600) if i % 4 and i < 400]))
    by_shard = {}
    for r in ix.pages.orderBy("low_m", "page").collect():
        by_shard.setdefault(r["shard"], []).append(r["n"])
    touched = {r["shard"] for r in ix.points.filter("id < 400").select("shard").distinct().collect()}
    assert touched and all(a + b > 10 for s in touched for a, b in zip(by_shard[s], by_shard[s][1:]))


def test_only_touched_pages_are_written(spark, tmp_path):
    path = f"{tmp_path}/index"
    rng = np.random.default_rng(3)
    store.build_index(points(spark, [(i, *rng.uniform(0, 9, 2)) for i in range(3000)]), ("x", "y"), "id", path, parts=4, page_size=20, segments=8)
    versions.insert(spark, path, points(spark, [(9000 + i, 4.5, 4.5) for i in range(3)]))
    versions.delete(spark, path, points(spark, [(0, 4.5, 4.5)]))
    held = store.manifest(spark, path)
    written = [spark.read.parquet(f"{path}/{e['folder']}").count() for e in held["points"]]
    assert written[0] == 3000 and written[1] <= 60 and written[2] <= 100 and held["version"] == 2


def test_one_of_two_writers_fails(spark, tmp_path):
    path = f"{tmp_path}/index"
    store.build_index(points(spark, [(i, i, i) for i in range(100)]), ("x", "y"), "id", path, parts=2, page_size=20, segments=2)
    held = store.manifest(spark, path)
    store.put_manifest(spark, path, held | {"version": 1})
    with pytest.raises(Exception, match="[Ee]xist"):
        store.put_manifest(spark, path, held | {"version": 1, "next_page": 99})
    assert store.manifest(spark, path)["next_page"] == held["next_page"]
    with pytest.raises(ValueError):
        versions.insert(spark, f"{tmp_path}/none", points(spark, [(1, 1, 1)]))


def test_filters_reach_the_scan_of_every_folder(spark, tmp_path):
    path = f"{tmp_path}/index"
    rng = np.random.default_rng(4)
    store.build_index(points(spark, [(i, *rng.uniform(0, 9, 2)) for i in range(2000)]), ("x", "y"), "id", path, parts=4, page_size=20, segments=8)
    ix = versions.insert(spark, path, points(spark, [(9000, 1.0, 1.0)]))
    hits = ix.pages.limit(3).select("block", F.col("low_m").alias("from_m"), F.col("high_m").alias("to_m"))
    plan = index.in_reach(ix, hits)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "block" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(block" in s or "block#" in s.partition("PartitionFilters: [")[2].partition("]")[0] for s in scans) and all("GreaterThanOrEqual(m" in s for s in scans)


def test_stages_name_what_they_are_made_from(spark, tmp_path):
    files.stage(spark, f"{tmp_path}/a-1", lambda: spark.range(3)).count()
    assert files.stage(spark, f"{tmp_path}/a-1", lambda: spark.range(9)).count() == 3
    assert mutate.WALK > 0
