"""The point engine: exactness on random and degenerate inputs, invariants of the layout, laws of mutations, files and streams."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework import queries
from latticework.functions import text
from latticework.operators import checks, grid, lattice, layout, model, mutate, search
from latticework.operators.ranks import saved
from latticework.plans.spec import Grid, IndexSpec
from latticework.sources import files, generate, store
from latticework.streaming import updates


def points(spark, rows, dims):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"x{i} double" for i in range(dims)))


def names(dims):
    return tuple(f"x{i}" for i in range(dims))


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_ranges_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = np.vstack([rng.uniform(-50, 100, (300, dims)), rng.integers(0, 6, (150, dims)), np.full((20, dims), 3.0)])
    p = points(spark, rows.tolist(), dims)
    spec = grid.spec_for(p, names(dims), parts=4)
    g = grid.build_grid(p, spec)
    boxes = []
    for q in range(200):
        lo = rng.uniform(-80, 110, dims) if q % 3 else rows[rng.integers(len(rows))].astype(float)
        boxes.append((q, [float(v) for v in lo], [float(v) for v in lo + (0 if q % 5 == 0 else rng.uniform(-5, 80, dims))]))
    for level in g.bounds:
        boxes.append((len(boxes), [float(level[0][0])] * dims, [float(level[0][min(1, level.shape[1] - 1)])] * dims))
    got = {r["qid"]: r["n"] for r in search.range_count(p, spark.createDataFrame(boxes, "qid int, lo array<double>, hi array<double>"), g).collect()}
    assert got == {q: int(((rows >= lo) & (rows <= hi)).all(axis=1).sum()) for q, lo, hi in boxes}
    inside = grid.with_mapping(p, g).join(grid.cell_intervals(spark.createDataFrame([(0, list(spec.low), list(spec.high))], "qid int, lo array<double>, hi array<double>"), g), "cell")
    assert inside.filter("m < low_m - 1e-9 OR m > high_m + 1e-9").count() == 0 and inside.count() == len(rows)


def test_mapping_rises_within_cells(spark):
    rng = np.random.default_rng(3)
    p = points(spark, rng.uniform(0, 10, (400, 2)).tolist(), 2)
    g = grid.build_grid(p, grid.spec_for(p, names(2), parts=5))
    rows = grid.with_mapping(p, g).collect()
    assert all(r["cell"] * 5 <= r["m"] < (r["cell"] + 1) * 5 for r in rows)
    for a in rows:
        for b in rows[:50]:
            if a["cell"] == b["cell"] and a["x0"] <= b["x0"] and a["x1"] <= b["x1"]:
                assert a["m"] <= b["m"] + 1e-12
    assert Counter(Counter(r["cell"] for r in rows).values()) == {80: 5}


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(2, 2)] * 30, [(i % 3, 0) for i in range(40)]])
def test_degenerate_points(spark, rows):
    p = points(spark, rows, 2)
    g = grid.build_grid(p, grid.spec_for(p, names(2), parts=4, page_size=3, segments=3))
    box = spark.createDataFrame([(0, [0.0, 0.0], [2.0, 2.0]), (1, [2.0, 2.0], [1.0, 1.0])], "qid int, lo array<double>, hi array<double>")
    assert {r["qid"]: r["n"] for r in search.range_count(p, box, g).collect()} == {0: len(rows), 1: 0}
    c = spark.createDataFrame([(0, 2.0, 2.0), (1, 500.0, -3.0)], "qid int, c0 double, c1 double")
    near = search.knn(p, c, g, 5, "id", F.lit(0.5)).collect()
    assert Counter(r["qid"] for r in near) == Counter({q: min(5, len(rows)) for q in (0, 1) if rows})
    indexed, models = layout.build_index(p, g, "id")
    assert indexed.count() == len(rows) and models.count() == indexed.select("segment").distinct().count()
    assert all(r["count"] <= 3 for r in indexed.groupBy("page").count().collect())


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = np.round(rng.uniform(0, 30, (400, 3)))
    p = points(spark, rows.tolist(), 3)
    g = grid.build_grid(p, grid.spec_for(p, names(3), parts=3))
    c = rng.uniform(-10, 40, (20, 3))
    centres = spark.createDataFrame([(q, *map(float, x)) for q, x in enumerate(c)], "qid int, c0 double, c1 double, c2 double")
    got = {(r["qid"], r["rank"]): r["id"] for r in search.knn(p, centres, g, 4, "id", F.lit(1.0)).collect()}
    for q, x in enumerate(c):
        d = np.sqrt(((rows - x) ** 2).sum(axis=1))
        assert [got[q, k + 1] for k in range(4)] == np.lexsort((np.arange(400), np.round(d, 9)))[:4].tolist()


def test_layout_invariants(spark, tmp_path):
    rng = np.random.default_rng(9)
    p = points(spark, np.vstack([rng.normal(50, 9, (1500, 2)), np.full((100, 2), 50.0)]).tolist(), 2)
    g = grid.build_grid(p, grid.spec_for(p, names(2), parts=6, page_size=20, segments=5, knots=8))
    indexed, models = layout.build_index(p, g, "id")
    indexed, models = saved(indexed, "t"), saved(models, "t")
    rows = sorted(indexed.collect(), key=lambda r: (r["m"], r["id"]))
    assert len(rows) == 1600 and [r["shard"] for r in rows] == sorted(r["shard"] for r in rows) and [r["page"] for r in rows] == sorted(r["page"] for r in rows)
    assert max(Counter(r["page"] for r in rows).values()) <= 20
    for r in models.collect():
        assert model.valid(np.array(r["alphas"]), np.array(r["betas"]))
    box = spark.createDataFrame([(0, list(g.spec.low), list(g.spec.high)), (1, [49.0, 49.0], [51.0, 51.0])], "qid int, lo array<double>, hi array<double>")
    touched = {r["qid"]: r["n_pages"] for r in layout.pages_per_query(layout.page_table(indexed), box, g).collect()}
    inside = {r["page"] for r in rows if 49 <= r["x0"] <= 51 and 49 <= r["x1"] <= 51}
    assert touched[0] == len({r["page"] for r in rows}) and len(inside) <= touched[1] < touched[0]
    shards = indexed.select("page", "shard").distinct()
    splits = layout.split_mappings(layout.page_table(indexed), shards).collect()
    assert all(s["next_low"] is None or s["next_low"] >= s["low_m"] for s in splits)
    again = mutate.repage(indexed, indexed.filter("shard < 2"), g.spec, "id")
    assert {r["shard"] for r in again.collect()} == {0, 1} and mutate.misplaced(indexed, layout.page_table(indexed)).count() == 0
    store.save_index(indexed, models, g, f"{tmp_path}/index")
    back, _, g2 = store.load_index(spark, f"{tmp_path}/index")
    assert back.count() == 1600 and g2.spec == g.spec and (g2.bounds[0] == g.bounds[0]).all()
    assert store.load_index(spark, f"{tmp_path}/other") is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 1000, allow_nan=False), min_size=1, max_size=200), st.integers(1, 12))
def test_models_rise(values, knots):
    m = np.sort(np.array(values))
    alphas, betas, loss = model.train_segment(m, knots)
    assert model.valid(alphas, betas) and np.isfinite(loss)
    predicted = model.predict(alphas, betas, m - m[0], len(m))
    assert (np.diff(predicted) >= -1e-6).all()


def test_model_beats_interpolation():
    m = np.sort(np.random.default_rng(2).exponential(1, 500))
    alphas, betas, loss = model.train_segment(m, 6)
    first = (m - m[0])[np.linspace(0, 499, 6, endpoint=False).astype(int)]
    assert loss < model.loss(model.interpolation(m - m[0], first), first, m - m[0])


def test_mutation_laws(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(80)]
    p, x = points(spark, rows, 2), points(spark, rows[:30] + [(9, 9)], 2)
    coords = ["x0", "x1"]
    bag = lambda df: Counter(tuple(r) for r in df.select(*coords).collect())
    assert bag(mutate.delete_bag(mutate.insert_bag(p, x), x, coords)) == bag(p)
    assert bag(mutate.delete_bag(p, points(spark, [(77, 1)], 2), coords)) == bag(p)
    assert bag(mutate.delete_rows(p, x, coords, "id")) == bag(mutate.delete_bag(p, x, coords)) == bag(p) - bag(x)


def test_split_page(spark):
    df = spark.createDataFrame([(i, 0, float(-i)) for i in range(5)], "id long, page int, m double")
    assert sorted((r["half"], r["id"]) for r in mutate.split_page(df, "id").collect()) == [(0, 2), (0, 3), (0, 4), (1, 0), (1, 1)]


def test_lattice(spark):
    spec = IndexSpec(("x0", "x1"), (0.0, 0.0), (10.0, 10.0), lattice_intervals=5)
    rng = np.random.default_rng(5)
    p = points(spark, rng.uniform(-1, 11, (300, 2)).tolist(), 2)
    w = lattice.corner_weights(p, spec, "id")
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == 4 for r in w.groupBy("id").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect())
    assert w.agg(F.min("node_id"), F.max("node_id")).first()[:] == (0, 35)
    targets = p.select("id", F.array(F.lit(2.0), F.lit(7.0)).alias("radii"))
    told = lattice.estimated_radii(p, spec, lattice.solve(spark, spec, w, targets, "id"), "id").collect()
    assert all(r["radii"] == pytest.approx([2.0, 7.0], abs=1e-6) for r in told)
    e = lattice.laplacian(spark, spec).groupBy("row").agg(F.sum("val").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-12 for r in e)
    a = np.diag([2.0, 3.0, 4.0])
    row, col = np.nonzero(a)
    assert lattice.conjugate_gradients(row, col, a[row, col], np.ones((3, 1)))[:, 0] == pytest.approx([1 / 2, 1 / 3, 1 / 4])


def test_lattice_is_trained_on_40_points_a_node(spark, monkeypatch):
    seen = []
    knn = search.knn_pages
    monkeypatch.setattr(search, "knn_pages", lambda p, c, k, i: seen.append((c.count(), k)) or knn(p, c, k, i))
    nodes = queries.lattice_coeffs(spark, "/root/testdata/sf0.001").collect()
    assert seen == [(40 * 81, 10)]
    assert len(nodes) == 81 and all(len(r["radii"]) == 10 for r in nodes)


def test_checks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 2.0, 2.0, 5.0])], "pos long, v double")
    assert checks.inversions(df, "pos", "v").first()["n"] == 1 and checks.inversions(df, "pos", "v", True).first()["n"] == 2
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0, 1.0],), ([3.0],), ([],)], "a array<double>")
    assert [r[0] for r in rows.select(checks.rising("a")).collect()] == [True, False, True, True]
    merged = grid.merged_intervals(spark.createDataFrame([(0, 0.0, 1.0), (0, 1.000001, 2.0), (0, 3.0, 4.0)], "qid int, low_m double, high_m double"))
    assert sorted((r["low_m"], r["high_m"]) for r in merged.collect()) == [(0.0, 2.0), (3.0, 4.0)]
    flat = checks.scaled(points(spark, [(1, 5), (3, 5)], 2), ["x0", "x1"], 0.0, 10.0).orderBy("id").collect()
    assert [(r["x0"], r["x1"]) for r in flat] == [(0.0, 0.0), (10.0, 0.0)]


def test_files(spark, tmp_path):
    np.save(f"{tmp_path}/a.npy", np.arange(12.0).reshape(6, 2))
    p = files.read_npy(spark, f"{tmp_path}/a.npy", 2)
    assert [tuple(r) for r in p.orderBy("row").collect()] == [(i, 2.0 * i, 2.0 * i + 1) for i in range(6)]
    files.write_text_rows(p, f"{tmp_path}/rows", ["x0", "x1"])
    assert files.read_boxes(spark, f"{tmp_path}/rows", 1).count() == 6
    (tmp_path / "map.tsv").write_text("1\ta\n2\tb\n1\tc\nx\td\n")
    assert {r["key"]: r["value"] for r in files.read_map(spark, f"{tmp_path}/map.tsv", "int", "str").collect()} == {1: "c", 2: "b", None: "d"}
    assert {r["key"]: r["value"] for r in files.read_map(spark, f"{tmp_path}/map.tsv", "str", "int", reverse=True).collect()} == {"a": 1, "b": 2, "c": 1, "d": None}
    files.write_map(files.read_map(spark, f"{tmp_path}/map.tsv"), f"{tmp_path}/out")
    assert files.read_list(spark, f"{tmp_path}/out").count() == 3
    assert [r["path"].rpartition("/")[2] for r in files.list_files(spark, str(tmp_path), ".npy").collect()] == ["a.npy"]
    files.make_folder(spark, f"{tmp_path}/new")
    assert files.remove_folder(spark, f"{tmp_path}/new", only_empty=True) and not files.remove_folder(spark, f"{tmp_path}/new")


def test_generators(spark):
    u = generate.uniform_points(spark, 500, 2, 0.5, 9.5)
    assert u.filter("x0 < 0.5 OR x0 > 9.5").count() == 0 and u.count() == 500
    z = generate.zipf_points(spark, 500, 1, 2.0, 100.0)
    assert z.filter("x0 < 1 OR x0 > 100").count() == 0 and z.filter("x0 = 1").count() > 150
    b = generate.boxes(spark, 50, 3, (0.0, 5.0), (1.0, 2.0), 6.0)
    assert b.filter("exists(zip_with(lo, hi, (a, z) -> z < a OR z > 6), x -> x)").count() == 0
    first, second, gone = generate.splits(u, "id")
    assert (first.count(), second.count(), gone.count()) == (250, 250, 250) and first.join(second, "id").count() == 0 and 0 < first.join(gone, "id").count() < 250
    assert generate.product([spark.range(2).toDF("a"), spark.range(3).toDF("b")]).count() == 6


def test_text(spark):
    df = spark.createDataFrame([("...…",), ("a.",), ("",), ("#x",)], "s string")
    rows = df.select(text.is_punctuation("s"), text.without_pound("s"), text.matches_at_start("s", "[#a]"), text.converted("s", "int")).collect()
    assert [tuple(r) for r in rows] == [(True, "...…", False, None), (False, "a.", True, None), (False, "", False, None), (False, "x", True, None)]
    arr = spark.createDataFrame([([None, 1, None, 2],), ([],), ([3],)], "a array<int>").select(text.joined(F.col("a"))).collect()
    assert [r[0] for r in arr] == ["None 1 2", None, "3"]


def test_plans(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    g = grid.build_grid(p, grid.spec_for(p, ("x", "y"), parts=8))
    boxes = spark.createDataFrame([(0, [0.0, 0.0], [9e4, 50.0])], "qid int, lo array<double>, hi array<double>")
    plan = search.range_count(p, boxes, g)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_streams(spark, tmp_path):
    table = lambda n: spark.read.parquet(f"{tmp_path}/v{n}")
    points(spark, [(1, 1), (1, 1), (2, 2)], 2).select("x0", "x1").write.parquet(f"{tmp_path}/v0")
    spark.createDataFrame([(1.0, 1.0, "delete"), (3.0, 3.0, "insert"), (9.0, 9.0, "delete")], "x0 double, x1 double, op string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x0 double, x1 double, op string").parquet(f"{tmp_path}/in")
    updates.run_updates(stream, table, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/v{n}"), ["x0", "x1"], f"{tmp_path}/c").awaitTermination(120)
    assert Counter(tuple(r) for r in table(1).collect()) == {(1.0, 1.0): 1, (2.0, 2.0): 1, (3.0, 3.0): 1}
    p = points(spark, [(i, i) for i in range(20)], 2)
    g = grid.build_grid(p, grid.spec_for(p, names(2), parts=4))
    timed = p.select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("x0"))).alias("t"), "x0", "x1")
    timed.write.parquet(f"{tmp_path}/timed")
    counts = updates.cell_counts(spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/timed"), g, "t", "10 seconds", "1 second")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 20


def test_cuts_are_exact(spark):
    p = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    for n in (0, 1, 2, 499, 999, 1000, 2000):
        taken, rest = generate.cut(p, n, ["id"], 3)
        assert taken.count() == min(n, 1000) and taken.unionByName(rest).distinct().count() == 1000
    assert sorted(r["id"] for r in generate.cut(p, 300, ["id"])[0].collect()) == sorted(r["id"] for r in generate.cut(p.repartition(5), 300, ["id"])[0].collect())
    # seven different keys, 1,000 rows
    taken, rest = generate.cut(p, 600, ["k"])
    assert taken.count() == 600 and taken.join(rest, "id").count() == 0
    u = generate.distinct_uniform(spark, 900, 1, 0.0, 1.0, digits=3)
    assert u.count() == u.distinct().count() == 900
    with pytest.raises(ValueError):
        generate.distinct_uniform(spark, 900, 1, 0.0, 1.0, digits=1)
    with pytest.raises(ValueError):
        generate.distinct_zipf(spark, 50, 1, 2.0, 10.0)


def test_predictions_are_made_once(spark, monkeypatch):
    """What is ranked into shards reads stored predictions, as ranges are sampled first and so everything before them runs twice."""
    rows = [(i, float(i % 97), float(i % 89)) for i in range(3000)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    g = grid.build_grid(p, grid.spec_for(p, ("x", "y"), parts=4, page_size=20, segments=5))
    plans, own = [], layout.ranked
    monkeypatch.setattr(layout, "ranked", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or own(df, *a))
    points, _ = layout.build_index(p, g, "id")
    assert points.count() == 3000 and plans and "zip_with" not in plans[-1]


def test_small_grids_place_points_without_python(spark, monkeypatch):
    """Four dimensions of four parts: no worker a dimension in each task, and the parts that numpy finds, on splits and for odd values too."""
    rng = np.random.default_rng(5)
    spec = IndexSpec(("a", "b", "c", "d"), (0.0,) * 4, (1.0,) * 4, parts=4)
    bounds = tuple(np.hstack([np.sort(rng.random((4**i, 3)).round(1), axis=1), np.ones((4**i, 1))]) for i in range(3))
    g = Grid(spec, bounds)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 1.0]
    rows = [(i, *[odd[int(k)] if p < 0.1 else float(v) for k, p, v in zip(rng.integers(0, 7, 4), rng.random(4), rng.random(4).round(1))]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    placed = grid.with_cell(df, g)
    assert "Python" not in placed._jdf.queryExecution().executedPlan().toString()
    got = [r["cell"] for r in placed.orderBy("id").collect()]
    want = np.zeros(len(rows), np.int64)
    for dim in range(3):
        want = want * 4 + g.place(dim, want, np.array([r[dim + 1] for r in rows], float))
    assert got == want.tolist()
    monkeypatch.setattr(grid, "TREE_BOUNDS", 0)
    assert [r["cell"] for r in grid.with_cell(df, g).orderBy("id").collect()] == got
