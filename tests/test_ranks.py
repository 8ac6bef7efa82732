"""Values at exact ranks against a sort."""

import numpy as np
import pytest

from latticework.operators import grid, layout, ranks
from latticework.operators.ranks import saved
from latticework.plans.spec import IndexSpec


def frame(spark, rows):
    return spark.createDataFrame([(int(g), float(x)) for g, x in rows], "g long, x double").repartition(3)


@pytest.mark.parametrize("buckets", [16, 1 << 16])
def test_selected_values_equal_a_sort(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    own = {
        0: rng.normal(size=900),
        -3: np.concatenate([np.full(500, 2.0), rng.normal(size=80)]),
        5: np.array([7.0]),
        6: np.array([0.0, -0.0, 0.0, -1.0]),
        8: rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300),
        9: np.array([-np.inf, np.inf, 1.0, 5e-324, -5e-324, np.inf]),
        11: np.full(50, -3.5),
    }
    df = frame(spark, [(g, x) for g, xs in own.items() for x in xs])
    wanted = {g: sorted({0, len(xs) - 1, *rng.integers(0, len(xs), 12).tolist()}) for g, xs in own.items()}
    wanted[11], wanted[99] = [], [0]
    got = ranks.selected(df, "g", "x", wanted)
    assert got == {(g, r): np.sort(own[g])[r] for g, rs in wanted.items() if g in own for r in rs}
    assert ranks.selected(df.filter("g > 1000"), "g", "x", {1: [0]}) == {}


def test_order_of_bits():
    x = np.array([-np.inf, -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf])
    bits = ranks.ordered_bits(x)
    assert (np.diff(bits) > 0).all() and [ranks.from_bits(int(b)) for b in bits] == x.tolist() and ranks.ordered_bits(np.array([-0.0]))[0] == 0


def test_bounds_take_no_range_shuffle(spark, monkeypatch):
    plans = []
    real = ranks.in_order
    monkeypatch.setattr(ranks, "in_order", lambda *a: plans.append(1) or real(*a))
    rng = np.random.default_rng(2)
    xs = np.vstack([rng.uniform(0, 9, (1500, 3)), np.full((900, 3), 4.0)])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], "id long, x double, y double, z double")
    g = grid.build_grid(p, IndexSpec(("x", "y", "z"), (0.0,) * 3, (9.0,) * 3, parts=5, page_size=10, segments=64))
    mapped = saved(grid.with_mapping(p, g), "mapped")
    bounds = layout.segment_bounds(mapped, g.spec)
    m = np.sort([r["m"] for r in mapped.collect()])
    cuts = [i * len(m) // 64 for i in range(1, 64)]
    assert bounds == sorted({m[c] for c in cuts if m[c] > m[c - 1]}) and not plans
    monkeypatch.setattr(layout, "COUNTED_CUTS", 3)
    assert layout.segment_bounds(mapped, g.spec) == bounds
    x = np.sort(xs[:, 0])
    assert g.bounds[0][0].tolist() == [*(x[k] for k in grid.cut_ranks(len(x), 5)), 9.0]
