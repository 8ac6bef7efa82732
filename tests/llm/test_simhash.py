"""SimHash near-duplicates against a plain version, and the index against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from latticework.llm import simhash

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, near):
    root = {i: i for i in items}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(items):
        for b in items[:i]:
            if near(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in items}


def wanted(rows):
    """(doc_id, fingerprint, component_id) by all pairs."""
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    found = classes(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    ids = {}
    for d, f in prints:
        if d is not None:
            ids[found[f]] = min(d, ids.get(found[f], d))
    return sorted((d is None, d or 0, f"{f:016x}", ids.get(found[f])) for d, f in prints)


def told(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in df.collect())


def test_query_equals_all_pairs(spark):
    got = simhash.query(spark, DATA)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert told(got) == wanted([(r["doc_id"], r["text"]) for r in rows])


def test_odd_rows_equal_all_pairs(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    base = [f"x{i}" for i in range(400)]
    near = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 400, 9)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two three", "One two  three\n", "École ÉCOLE école", long_, long_ + " end", long_.replace(" ", "\n"), "  nbsp word  ", *near]
    rows = [*((i, t) for i, t in enumerate(texts, 5)), (None, "one"), (None, "alone and null"), (6, ""), (6, ""), (-3, "one two three"), (7, "one two three")]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "doc_id AS fp", "text AS fingerprint", "1 AS root", "2 AS component_id", "3 AS head")
    assert told(simhash.near_duplicates(df)) == wanted(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_texts_in_windows_have_the_same_fingerprint(monkeypatch):
    texts = ["a", "", "a b", "a  b\tc", " lead and trail ", "x" * 50, "one " * 40 + "y" * 60, " ".join(map(str, range(90)))]
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "WINDOW", size)
        monkeypatch.setattr(simhash, "SLICE", 5)
        assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("long_list", [1, 3, 1024])
def test_links_connect_what_all_pairs_connect(spark, long_list):
    """Flips of 1 to 4 bits, also across bytes, of a few fingerprints; a crowd that shares six bytes; extremes."""
    rng = random.Random(4)
    some = {0, (1 << 64) - 1, 1 << 63, 3}
    for _ in range(25):
        f = rng.getrandbits(64)
        some.add(f)
        for n in (1, 2, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            some.add(g)
    some |= {0xABCDEF0123450000 + v for v in rng.sample(range(65536), 120)}
    some = sorted(np.array(sorted(some), np.uint64).view(np.int64).tolist())
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in some], "fp long"), long_list).collect()]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(bits(a, b) <= 2 for a, b in links)
    pairs = set(links) | {(b, a) for a, b in links}
    assert classes(some, lambda a, b: (a, b) in pairs) == classes(some, lambda a, b: bits(a, b) <= 2)


def test_a_group_of_copies_makes_no_pairs(spark):
    rows = [(i, f"the same text for all {i % 2}") for i in range(3000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 3000 and {r["component_id"] for r in got} <= {0, 1}
