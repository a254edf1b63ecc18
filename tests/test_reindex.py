"""The log of the streaming index: versions of files, snapshots, and what is read."""

import os

from corvane.streaming.reindex import append_batch, compact, current, live

ROWS = "path string, content string, mtime long"


def names(spark, where):
    return sorted(r.name for r in current(spark, where).where("what = 'definition'").collect())


def test_an_older_version_that_comes_later_does_not_win(spark, tmp_path):
    where = str(tmp_path / "index")
    put = append_batch(where)
    assert current(spark, where).count() == 0
    put(spark.createDataFrame([("a.py", "def a1(): pass", 10), ("b.py", "def b1(): pass", 10), (None, "x", 1), ("n.py", None, 1)], ROWS), 0)
    put(spark.createDataFrame([("a.py", "def a0(): pass", 5), ("b.py", "def b2(): pass", 10), ("c.rs", "fn c1() {}", 1), ("c.rs", "fn c2() {}", 2)], ROWS), 1)
    assert names(spark, where) == ["a1", "b2", "c2"]
    put(spark.createDataFrame([("c.rs", "", 3)], ROWS), 2)
    put(spark.createDataFrame([("c.rs", "", 3)], ROWS), 2)  # a batch that runs again
    assert names(spark, where) == ["a1", "b2"]


def test_snapshots_take_the_place_of_batches(spark, tmp_path):
    where = str(tmp_path / "index")
    put = append_batch(where)
    assert compact(spark, where) is None
    for v in range(3):
        put(spark.createDataFrame([("a.py", f"def a{v}(): pass", 9 - v), (f"b{v}.py", f"def b{v}(): pass", 1)], ROWS), v)
    before = names(spark, where)
    assert before == ["a0", "b0", "b1", "b2"] and compact(spark, where) == 2
    assert live(spark, where) == (2, []) and names(spark, where) == before and compact(spark, where) is None
    put(spark.createDataFrame([("a.py", "def late(): pass", 3), ("b1.py", "def b9(): pass", 2)], ROWS), 3)
    assert live(spark, where) == (2, [3]) and names(spark, where) == ["a0", "b0", "b2", "b9"]
    read = {f.split("index/")[1].rsplit("/", 2)[0] for f in current(spark, where).inputFiles()}
    assert read <= {"snapshots/2", "log/v=3"}
    assert compact(spark, where) == 3 and names(spark, where) == ["a0", "b0", "b2", "b9"]
    assert sorted(os.listdir(f"{where}/snapshots")) == ["2", "3"] and os.listdir(f"{where}/log") == ["v=3"]


def test_a_batch_or_snapshot_that_broke_off_is_not_read(spark, tmp_path):
    where = str(tmp_path / "index")
    put = append_batch(where)
    put(spark.createDataFrame([("a.py", "def a(): pass")], "path string, content string"), 0)
    put(spark.createDataFrame([("a.py", "def b(): pass")], "path string, content string"), 1)
    os.remove(f"{where}/log/v=1/files/_SUCCESS")
    os.makedirs(f"{where}/snapshots/7")
    assert names(spark, where) == ["a"] and live(spark, where) == (None, [0])
