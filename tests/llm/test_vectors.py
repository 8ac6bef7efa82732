"""Vector codes and whitening against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from latticework.llm import vector_codes, vectors, whitening

DATA = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def whole(v, dim):
    out = []
    for x in v:
        f = math.floor(x * 256) if abs(x) < 2.0**53 else int(x) * 256
        out.append(max(-(1 << 53), min(1 << 53, f)))
    return out + [0] * (dim - len(out))


def kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts, entries, rounds):
    rows = kept(rows)
    dim = -(-max([1, *(len(r[1]) for r in rows)]) // parts) * parts
    w = dim // parts
    x = [whole(r[1], dim) for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[x[i][p * w : p * w + w] for i in first] for p in range(parts)]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))

    def nearest(v, p):
        return min((apart(v, b), e) for e, b in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [nearest(v[p * w : p * w + w], p)[1] for v in x]
            new.append([[sum(x[i][p * w + k] for i in range(len(x)) if own[i] == e) // own.count(e) for k in range(w)] if e in own else b for e, b in enumerate(books[p])])
        books = new
    out = []
    for r, v in zip(rows, x):
        best = [nearest(v[p * w : p * w + w], p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in best), min((1 << 63) - 1, sum(d for d, _ in best))))
    return out, ",".join(str(c) for b in books for e in b for c in e)


def ordered(rows):
    return sorted(rows, key=str)


ODD = [
    (4, [0.5, -0.25, 1.0], 1),
    (4, [0.5, -0.25, 1.0], 1),
    (1, [0.1, 0.2, 0.3, 0.4, 0.5], None),
    (None, [-0.0, 0.0, 3.0], 2),
    (2, None, 1),
    (3, [1.0, None], 1),
    (5, [NAN, 1.0], 1),
    (6, [1.0, -INF], 1),
    (7, [], 3),
    (8, [1e300, -1e300, 1.0], 3),
    (9, [123456.789, 1e9, -7e8, 0.0001], None),
    (-2, [0.0, -1e-9], 2),
]


@pytest.mark.parametrize("parts, entries, block", [(2, 3, 4), (1, 4, 100), (3, 64, 2)])
def test_codes_of_odd_rows(spark, parts, entries, block):
    df = spark.createDataFrame(ODD, KIND).selectExpr("*", "'x' AS code", "1 AS error", "2 AS places", "3 AS points")
    found, books = vector_codes.coded(df, parts, entries, 2, block=block)
    want, text = plain_codes(ODD, parts, entries, 2)
    assert ordered((r["vec_id"], r["label"], r["code"], r["error"]) for r in found.collect()) == ordered(want)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("scale, copies", [(1.0, 1), (0.01, 3)])
def test_codes_of_many_rows(spark, scale, copies):
    """Small integers make ties between entries; copies fill subtrees."""
    rng = np.random.default_rng(6)
    rows = [(int(i), (np.round(rng.normal(size=8) * 3) * scale).tolist(), int(i % 4)) for i in range(400)] * copies
    found, books = vector_codes.coded(spark.createDataFrame(rows, KIND).repartition(3), 4, 16, 2, block=150)
    want, text = plain_codes(rows, 4, 16, 2)
    assert ordered((r["vec_id"], r["label"], r["code"], r["error"]) for r in found.collect()) == ordered(want)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("wide", [False, True])
def test_filtering_equals_all_distances(wide):
    rng = np.random.default_rng(2)
    for n in (1, 8, 9, 100, 700):
        x = rng.integers(-6, 7, (n, 3))
        x = x[vector_codes.tree_order(x)]
        book = rng.integers(-6, 7, (12, 3))
        own, sums, counts = vector_codes.filtered(*((x.astype(object), book.astype(object)) if wide else (x, book)))
        want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (own == want).all() and (counts == np.bincount(want, minlength=12)).all()
        assert (np.array([x[want == e].sum(axis=0) for e in range(12)]) == sums).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    found, books = vector_codes.coded(none)
    assert found.collect() == [] and found.columns == ["vec_id", "label", "code", "error"] and books.shape[1] == 0
    assert whitening.whitened(none).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [NAN], 1), (3, [], 1)], KIND)).collect() == []


def test_query_of_codes(spark):
    got = vector_codes.query(spark, DATA).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, text = plain_codes(rows, 16, 64, 2)
    errors = {label: sum(w[3] for w in want if w[1] == label) for label in {w[1] for w in want}}
    assert ordered((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == ordered((w[0], w[2], w[3], errors[w[1]]) for w in want)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


# whitening


def plain_whitening(rows, components=4):
    rows = kept(rows)
    dim = max(len(r[1]) for r in rows)
    x = [whole(r[1], dim) for r in rows]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    y = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > dim * np.finfo(float).eps * values.sum()).sum())
    own = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    white = own @ axes[:, :k] / np.sqrt(values[:k])
    deviation = [min((1 << 63) - 1, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for v in x]
    return rows, n, deviation, white, values[:k] / values.sum()


def compare(got, rows, components=4):
    kept_rows, n, deviation, white, explained = plain_whitening(rows, components)
    k = len(explained)
    assert len(got) == len(kept_rows) * k and {r["n"] for r in got} == {n}
    assert ordered((r["vec_id"], r["deviation"]) for r in got) == ordered((r[0], d) for r, d in zip(kept_rows, deviation) for _ in range(k))
    for c in range(k):
        own = sorted(((str(r["vec_id"]), r["whitened"]) for r in got if r["component"] == c + 1))
        ids = [str(r[0]) for r in kept_rows]
        # either sign, but the same one for all rows
        want = [sorted(zip(ids, s * white[:, c])) for s in (1, -1)]
        assert any(all(a == b and abs(u - v) < 1e-7 for (a, u), (b, v) in zip(own, w)) for w in want)
        assert {round(r["explained"] / explained[c], 6) for r in got if r["component"] == c + 1} == {1.0}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def test_whitening_equals_a_plain_version(spark):
    got = whitening.query(spark, DATA).collect()
    compare(got, [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [r for r in ODD if r[0] not in (8, 9)] + [(int(i), rng.normal(size=6).tolist(), 1) for i in range(20, 40)] + [(77, [2.0] * 6, 1)] * 30
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    compare(whitening.whitened(df).collect(), rows)
    compare(whitening.whitened(df, 2).collect(), rows, 2)


def test_whitening_counts_each_vector_once_and_keeps_rank(spark):
    """Two dimensions of three vary; large components make deviations beyond 64 bits."""
    rows = [(i, [float(i % 5), 2.0 * (i % 3), 7.0], 0) for i in range(60)]
    got = whitening.whitened(spark.createDataFrame(rows, KIND)).collect()
    compare(got, rows)
    assert {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {15}
    far = [(0, [1e9, 1.0], 0), (1, [-1e9, 2.0], 0), (2, [1e6, -4.0], 0), (3, [0.0, 1e6], 0)]
    told = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(far, KIND)).collect()}
    _, _, deviation, _, _ = plain_whitening(far)
    assert told == dict(enumerate(deviation)) and vectors.LONG in deviation and min(deviation) < vectors.LONG
    assert whitening.whitened(spark.createDataFrame([(1, [3.0, 4.0], 0)] * 9, KIND)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65])
def test_jacobi(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, 3 * n)) * np.logspace(0, -5, n)[:, None]
    v = m @ m.T
    values, axes = whitening.jacobi(v)
    assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12) and (np.diff(values) <= 0).all()
    # graded matrices: small eigenvalues are accurate beside themselves
    assert np.allclose(axes @ np.diag(values) @ axes.T, v, atol=1e-13 * np.abs(v).max()) and np.allclose(values, (np.linalg.svd(m)[1] ** 2), rtol=1e-9)
