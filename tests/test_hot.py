"""Half of all rows on one point, one page, one coordinate: results are right, and no group of a task grows with the run."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import grid, index, layout, model, mutate
from latticework.operators.ranks import saved
from latticework.plans.spec import IndexSpec

SIZE = 20


@pytest.fixture(scope="module")
def crowded(spark):
    """6,000 points, half of them on one place, in segments of 150 rows but for the crowded one."""
    rng = np.random.default_rng(1)
    rows = [(i, 50.0, 50.0) if i % 2 else (i, *map(float, rng.uniform(0, 100, 2))) for i in range(6000)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    g = grid.build_grid(p, IndexSpec(("x", "y"), (0.0, 0.0), (100.0, 100.0), parts=4, page_size=SIZE, segments=40, knots=8))
    mapped = saved(grid.with_mapping(p, g), "mapped")
    segmented = saved(layout.with_segment(mapped, layout.segment_bounds(mapped, g.spec)), "segmented")
    models = saved(layout.train_models(segmented, g.spec), "models")
    return g, segmented, models, saved(layout.with_shard(segmented, models, g.spec, "id"), "indexed")


def test_a_run_of_equal_mappings_is_one_row_of_its_model(spark, crowded):
    _, segmented, models, _ = crowded
    sizes = [r["n"] for r in models.collect()]
    distinct = segmented.groupBy("segment").agg(F.countDistinct("m").alias("d")).agg(F.max("d")).first()[0]
    assert sum(sizes) == 6000 and max(sizes) >= 3000 and distinct <= 2 * 150 + 1


def test_pages_of_a_run_are_full_and_in_order(crowded):
    _, _, _, indexed = crowded
    rows = sorted(indexed.collect(), key=lambda r: (r["m"], r["id"]))
    assert len(rows) == 6000 and [r["page"] for r in rows] == sorted(r["page"] for r in rows) and [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert max(Counter(r["page"] for r in rows).values()) == SIZE
    assert len({r["page"] for r in rows if r["x"] == r["y"] == 50.0}) <= 3000 // SIZE + 2
    assert sorted({r["page"] for r in rows}) == list(range(len({r["page"] for r in rows})))


def test_no_window_sees_a_shard(crowded):
    g, segmented, models, _ = crowded
    indexed = layout.with_shard(segmented, models, g.spec, "id")
    plan = indexed._jdf.queryExecution().optimizedPlan().toString()
    assert "shard#" not in "".join(line for line in plan.splitlines() if "Window" in line)


@pytest.mark.parametrize("bits", [2, 16])
def test_look_ups_in_one_segment_are_spread(spark, crowded, monkeypatch, bits):
    monkeypatch.setattr(index, "RUN_BITS", bits)
    g, _, models, indexed = crowded
    models = saved(index.with_first(models), "first")
    pages = saved(index.directory(indexed.withColumn("block", F.lit(0)), models, g.spec.coords), "pages")
    starts = [r["min_m"] for r in models.orderBy("segment").collect()][1:]
    told = index.predicted_shards(index.Index(indexed, models, pages, g, starts), indexed.select("id", "m", F.col("shard").alias("stored")), "m")
    assert told.filter("shard = stored").count() == 6000 and told.columns == ["id", "m", "stored", "shard"]


def test_training_on_runs_equals_training_on_rows():
    rng = np.random.default_rng(7)
    m = np.sort(np.concatenate([rng.uniform(0, 9, 300), np.full(500, 4.0), rng.integers(0, 9, 200)]))
    own, often = np.unique(m, return_counts=True)
    alphas, betas, loss = model.train_runs(own, often, 7)
    a, b, rows = model.train_segment(m, 7)
    assert (alphas == a).all() and (betas == b).all() and loss == rows
    assert model.loss(alphas, betas, m - m[0]) == pytest.approx(loss) and loss <= model.loss(model.interpolation(m - m[0], betas), betas, m - m[0])


def test_pooling_is_the_nearest_rising_sequence():
    rng = random.Random(2)
    for _ in range(200):
        v = np.array([rng.randint(-5, 5) for _ in range(rng.randint(1, 9))], float)
        w = np.array([rng.randint(1, 4) for _ in v], float)
        got = model.pooled(v, w)
        assert (np.diff(got) >= 0).all()
        # by its characterisation: level = max over starts of min over ends of the weighted mean
        mean = lambda a, z: (v[a : z + 1] * w[a : z + 1]).sum() / w[a : z + 1].sum()
        want = [max(min(mean(a, z) for z in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
        assert got == pytest.approx(want)


def test_all_inserts_on_one_page(spark):
    paged = spark.createDataFrame([(i, 0, i // 10, float(i // 10)) for i in range(40)], "id long, segment long, page long, m double")
    new = spark.createDataFrame([(100 + i, 0, 2.5) for i in range(500)], "id long, segment long, m double")
    rows = mutate.inserted(paged, new, IndexSpec(("x",), (0.0,), (1.0,), page_size=16), "id").collect()
    assert Counter(r["page"] for r in rows) == {0: 10, 1: 10, 2: 510, 3: 10}
    pieces = Counter(r["piece"] for r in rows if r["page"] == 2)
    assert len(pieces) == 32 and max(pieces.values()) <= 16 and max(pieces.values()) - min(pieces.values()) <= 1


def test_deletes_of_a_hot_coordinate(spark):
    rows = [(i, 1.0, None) for i in range(300)] + [(300 + i, 2.0, float(i)) for i in range(5)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    gone = spark.createDataFrame([(1.0, None)] * 120 + [(2.0, 3.0)] * 4 + [(9.0, 9.0)], "x double, y double")
    assert sorted(r["id"] for r in mutate.delete_rows(p, gone, ["x", "y"], "id").collect()) == [*range(120, 300), 300, 301, 302, 304]


@pytest.mark.parametrize("walk", [3, 1 << 12])
def test_chains_of_small_pages_merge(spark, monkeypatch, walk):
    monkeypatch.setattr(mutate, "WALK", walk)
    rng = random.Random(3)
    rows = [(s, p, rng.choice([1, 2, 3, 7, 10])) for s, k in ((0, 60), (1, 1), (4, 25)) for p in range(0, 2 * k, 2)]
    got = mutate.chained(spark.createDataFrame(rows, "shard long, page long, n long"), "shard", "page", 10).collect()
    want, held, chain, last = {}, 0, 0, None
    for nth, (s, p, n) in enumerate(rows):
        if s != last or held + n > 10:
            held, chain = 0, chain + 1
        held, last, want[s, p] = held + n, s, chain
    assert len(got) == len(rows)
    groups = lambda d: sorted(map(sorted, {c: [k for k in d if d[k] == c] for c in d.values()}.values()))
    assert groups({(r["shard"], r["page"]): (r["shard"], r["chain"]) for r in got}) == groups(want)


@pytest.mark.parametrize("walk", [50, 1 << 12])
def test_small_groups_share_a_call(spark, monkeypatch, walk):
    """As many groups as an index has shards, of a page or a few, and a large one over several runs."""
    monkeypatch.setattr(mutate, "WALK", walk)
    calls, kind = spark.sparkContext.accumulator(0), type(spark.range(1).groupBy())
    apply = kind.applyInPandas

    def counted(self, func, schema):
        def told(key, pdf):
            calls.add(1)
            return func(key, pdf)

        return apply(self, told, schema)

    monkeypatch.setattr(kind, "applyInPandas", counted)
    rng = random.Random(8)
    rows = [(s, p, rng.randint(1, 10)) for s in range(2000) for p in range(400 if s == 900 else 1 + s % 3)]
    got = {(r["shard"], r["page"]): r["chain"] for r in mutate.chained(spark.createDataFrame(rows, "shard long, page long, n long"), "shard", "page", 10).collect()}
    held, last, before = 0, None, None
    assert len(got) == len(rows)
    for s, p, n in rows:
        opens = s != last or held + n > 10
        assert opens == (s != last or got[s, p] != before)
        held, last, before = n if opens else held + n, s, got[s, p]
    assert len(set(got.values())) > 2000
    # functions, starts and walks: a call or two for each run, and none for each group
    assert calls.value <= 12 * (len(rows) // walk + 8)
