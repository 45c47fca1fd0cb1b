"""Files that many tasks read at once: array files by row ranges, records across file splits."""

import random

import numpy as np
import pytest
from marlstone.sources import tables
from marlstone.sources.arrays import array_rows


def rows_of(df):
    return {(r.file, r.row): r["values"] for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    arrays = {
        "a.npy": rng.normal(size=(103, 7)), "b.npy": rng.integers(0, 99, 50).astype(">i4"), "c.npy": np.asfortranarray(rng.normal(size=(31, 4)).astype("f4")),
        "d.npy": rng.normal(size=(9, 2, 3)), "e.npy": np.zeros((0, 5)), "f.npy": np.asfortranarray(rng.normal(size=(8, 2, 3))),
    }
    for name, a in arrays.items():
        np.save(tmp_path / name, a)
    (tmp_path / "g.txt").write_text("not an array")
    return tmp_path, {(n, i): a[i].ravel().astype(float).tolist() for n, a in arrays.items() for i in range(len(a))}


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_array_rows_of_all_shapes(spark, folder, size):
    path, want = folder
    assert rows_of(array_rows(spark, str(path), partition_bytes=size)) == want
    df = array_rows(spark, f"file://{path}/a*.npy", partition_bytes=size)
    assert rows_of(df) == {k: v for k, v in want.items() if k[0] == "a.npy"}
    assert df.rdd.getNumPartitions() == {1: 103, 100: 103, 1 << 20: 1}[size]


def test_array_filters_leave_other_ranges_unread(spark, folder):
    path, want = folder
    df = array_rows(spark, str(path), partition_bytes=7 * 8)  # a row of the first file
    some = df.where("row > 2 and row <= 6 and file = 'a.npy'")
    assert rows_of(some) == {("a.npy", i): want["a.npy", i] for i in range(3, 7)} and some.rdd.getNumPartitions() == 4
    assert rows_of(df.where("row = 8 and file in ('a.npy', 'd.npy', 'x')")) == {(n, 8): want[n, 8] for n in ("a.npy", "d.npy")}
    assert rows_of(df.where("row >= 5 and row < 5")) == {} and df.where("row between 40 and 49 and (row % 2 = 0)").count() == 10
    assert rows_of(df.where("file like 'c%' and values[0] > 0")) == {k: v for k, v in want.items() if k[0] == "c.npy" and v[0] > 0}


def test_array_columns_that_are_asked_for(spark, folder):
    path, want = folder
    names = array_rows(spark, str(path), "row long, file string")
    assert {(r.file, r.row) for r in names.collect()} == set(want)
    floats = array_rows(spark, f"{path}/a.npy", "values array<float>")
    assert floats.schema.simpleString() == "struct<values:array<float>>" and floats.count() == 103
    with pytest.raises(Exception, match="no columns price"):
        array_rows(spark, str(path), "price int").count()
    with pytest.raises(Exception, match="nothing"):
        array_rows(spark, f"{path}/nothing*.npy").count()


def test_an_array_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse, so it costs no disk; a task holds its range alone."""
    big = np.lib.format.open_memmap(tmp_path / "big.npy", mode="w+", dtype="f8", shape=(3_000_000, 128))
    big[2_999_990:, 5] = 7
    big.flush()
    del big
    df = array_rows(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 46
    got = df.where("row >= 2999985").selectExpr("row", "values[5] as v").collect()
    assert [(r.row, r.v) for r in got] == [(i, 7.0 if i >= 2_999_990 else 0.0) for i in range(2_999_985, 3_000_000)]


# ----------------------------------------------------------------- records
def structure(i, rng):
    block = "\n".join([f"title {i}", *("x" * rng.randrange(30) for _ in range(rng.randrange(4))), "M  END"])
    return block, {"SMILES": f"C{i % 3}", "NOTE": f"costs $$$$ {i}\nsecond line"}


def written(records):
    return "".join(b + "".join(f"\n> <{k}>\n{v}\n" for k, v in p.items()) + "\n$$$$\n" for b, p in records)


@pytest.mark.parametrize("size", [7, 64, 501, 1 << 20])
def test_records_across_split_edges_come_once(spark, tmp_path, size):
    rng = random.Random(size)
    records = [structure(i, rng) for i in range(40)]
    (tmp_path / "x.sdf").write_text(written(records))
    (tmp_path / "y.sdf").write_text(written(records[:3])[:-1])  # no line feed at the end
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = tables.structure_records(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 40 or size > 64
        got = sorted((r.title, r.block, tuple(sorted(r.properties.items()))) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted((b.split("\n")[0], b, tuple(sorted(p.items()))) for b, p in records + records[:3])


def test_odd_records(spark, tmp_path):
    text = "$$$$\n\n \n$$$$\nonly a title\n$$$$\nt\nM  END\n> <A>\n1\n\n>  25 <B> (DT)\n2\n\n> <A>\n3\n\n> <EMPTY>\n\n$$$$\nno separator at the end\n> <A>\n4"
    (tmp_path / "x.sdf").write_text(text)
    got = {r.title: (r.block, r.properties) for r in tables.structure_records(spark, str(tmp_path)).collect()}
    assert got == {"only a title": ("only a title", {}), "t": ("t\nM  END", {"A": "1", "B": "2", "EMPTY": ""}), "no separator at the end": ("no separator at the end", {"A": "4"})}
