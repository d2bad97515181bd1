"""The store of results, and runs as merged cells."""

import pytest

from foliospark.sources.results import Store, mergeable, safe, spans


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.tables() == [] and s.load("none").columns == [] and s.load("none").count() == 0
    a, b = spark.createDataFrame([(1, "x")], "n long, t string"), spark.createDataFrame([("2", 3.5)], "n string, extra double")
    s.save("my table!", a)
    whole = s.save("my table!", b, "append")
    assert sorted(map(tuple, whole.select("n", "t", "extra").collect())) == [("1", "x", None), ("2", None, 3.5)]
    assert s.tables() == ["my_table"] and s.versions("my table!") == [0, 1]
    assert s.load("my_table", 0).collect()[0].asDict() == {"n": 1, "t": "x"}
    assert s.save("my_table", a).count() == 1
    s.save("empty", a.limit(0))
    assert s.load("empty").columns == ["n", "t"] and s.save("empty", a, "append").count() == 1
    with pytest.raises(FileNotFoundError):
        s.rename("gone", "x")
    with pytest.raises(ValueError, match="already"):
        s.rename("empty", "my table")
    assert s.rename("empty", "my_table.2") == "my_table_2" and s.rename("my_table", "my_table") == "my_table"
    assert s.tables() == ["my_table", "my_table_2"] and s.load("my_table_2").count() == 1
    s.delete("my_table")
    s.delete("my_table")
    assert s.tables() == ["my_table_2"] and s.load("my_table").columns == [] and s.load("my_table", 1).count() == 2
    assert s.save("my_table", b, "append").count() == 1
    with pytest.raises(FileNotFoundError):
        s.load("my_table", 99)
    with pytest.raises(ValueError, match="neither"):
        s.save("x", a, "replace")


def test_second_writer_fails(spark, tmp_path):
    """A version that another writer has made since is not replaced."""
    s = Store(spark, str(tmp_path / "store"))
    s.save("t", spark.range(3))
    late = s._last("t")
    s.save("t", spark.range(2), "append")
    with pytest.raises(FileExistsError):
        s._switch("t", [], late)
    assert s.load("t").count() == 5 and s.tables() == ["t"]


def test_merged_cells(spark):
    assert [safe(n) for n in ("", " é b ", "__", "a/b")] == ["table", "é_b", "table", "a_b"]
    rows = [("p", 1, "a", "v", None), ("p", 2, "a", None, "w"), ("p", 3, None, "v", None), ("p", 4, None, None, None), ("p", 5, "a", "v", None), ("q", 1, "a", None, None)]
    df = spans(spark.createDataFrame(rows, "part string, n int, key string, first string, later string"), "part", "key", "n")
    assert [r.rowspan for r in df.orderBy("part", "n").collect()] == [2, 0, 2, 0, 1, 1]
    assert {r.column: r.mergeable for r in mergeable(df, ["first", "later"]).collect()} == {"first": True, "later": False}
    assert {r.column: r.mergeable for r in mergeable(df.filter("n > 9"), ["first"]).collect()} == {"first": True}
