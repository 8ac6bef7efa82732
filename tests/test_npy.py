"""Ranges of rows of .npy files."""

import os

import numpy as np
import pytest

from latticework.sources import npy


@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2", "|u1", "|b1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_rows_come_in_ranges(spark, tmp_path, kind, order):
    x = (np.arange(3000).reshape(1000, 3) % 100).astype(kind)
    np.save(f"{tmp_path}/a.npy", np.asarray(x, order=order))
    df = npy.read_npy_ranges(spark, f"{tmp_path}/a.npy", 100 * 3 * x.itemsize)
    assert df.rdd.getNumPartitions() == 10
    rows = df.orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(1000)) and np.array_equal([[r["x0"], r["x1"], r["x2"]] for r in rows], x.astype(float))


def test_batches_of_a_range(tmp_path, monkeypatch):
    x = np.arange(50.0).reshape(25, 2)
    for order in "CF":
        np.save(f"{tmp_path}/{order}.npy", np.asarray(x, order=order))
        h = npy.header_of(f"{tmp_path}/{order}.npy")
        found = list(npy.batches(npy.Rows(f"{tmp_path}/{order}.npy", h, 5, 17), 4))
        assert [b.num_rows for b in found] == [4, 4, 4, 4, 1]
        assert np.array_equal(np.concatenate([b.column("x1").to_numpy() for b in found]), x[5:22, 1])


def test_folders_vectors_and_empty_matrices(spark, tmp_path):
    np.save(f"{tmp_path}/a.npy", np.arange(4.0))
    np.save(f"{tmp_path}/b.npy", np.zeros((0, 1)))
    (tmp_path / "note.txt").write_text("x")
    assert sorted(tuple(r) for r in npy.read_npy_ranges(spark, f"file://{tmp_path}").collect()) == [(i, float(i)) for i in range(4)]
    os.remove(f"{tmp_path}/a.npy")
    assert npy.read_npy_ranges(spark, str(tmp_path)).collect() == []


def test_odd_files_are_refused(tmp_path):
    np.save(f"{tmp_path}/text.npy", np.array(["a"]))
    np.save(f"{tmp_path}/deep.npy", np.zeros((2, 2, 2)))
    np.save(f"{tmp_path}/cut.npy", np.zeros((9, 2)))
    os.truncate(f"{tmp_path}/cut.npy", 200)
    for name in ("text", "deep", "cut"):
        with pytest.raises(ValueError):
            npy.header_of(f"{tmp_path}/{name}.npy")
    with pytest.raises(FileNotFoundError):
        npy.files_at(f"{tmp_path}/none")
