"""Exact row numbers, and tables compared by position."""

import pytest
from pyspark.sql import functions as F

from stubble.operators.checks import aligned, position_differences, require_aligned
from stubble.operators.order import row_numbers, with_file_order


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_numbers_are_gapless_and_ties_follow_the_file(spark, tmp_path, many_ranges):
    # A third of the rows share one key; the file's order decides among them.
    rows = [(i, None if i % 10 == 0 else ("k" if i % 3 == 0 else f"k{i % 17}")) for i in range(3000)]
    (tmp_path / "t").mkdir()
    for part in range(3):
        text = "".join(f"{i},{k or ''}\n" for i, k in rows[part * 1000 : part * 1000 + 1000])
        (tmp_path / "t" / f"{'abc'[part]}.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = with_file_order(spark.read.schema("i long, k string").csv(f"{tmp_path}/t"))
        got = row_numbers(read, ["k"], "n", "__place").orderBy("n").collect()
        first = row_numbers(read, ["k"], "n", "__place", nulls="first").orderBy("n").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert [r["n"] for r in got] == list(range(1, 3001))
    assert [(r["i"], r["k"]) for r in got] == want
    assert first["i"] == 0


def test_numbers_of_an_empty_table(spark):
    assert row_numbers(spark.createDataFrame([], "k long"), ["k"], "n").collect() == []


def tables(spark, mine, theirs):
    return [spark.createDataFrame(r, "k long, a string, b double") for r in (mine, theirs)]


def test_differences_by_position(spark):
    mine, theirs = tables(spark, [(1, "1", 1.0), (2, "x", 2.0), (3, "3", None), (4, "4", 4.0)], [(10, "1", 1.5), (20, None, 2.0), (30, None, None)])
    got = position_differences(mine, theirs, ["k"], {"a": "a", "b": "b"}, 0.25)
    cells = {(r["position"], r["measure"]): (r["side"], r["mine"], r["theirs"], r["difference"]) for r in got.collect()}
    assert cells == {
        (1, "b"): ("both", 1.0, 1.5, -0.5),
        (3, "a"): ("both", 3.0, None, None),
        (4, "a"): ("mine", 4.0, None, None),
        (4, "b"): ("mine", 4.0, None, None),
    }
    assert aligned(mine, theirs, ["k"], {"b": "b"}).count() == 4


def test_aligned_tables_pass_and_others_raise(spark):
    mine, theirs = tables(spark, [(1, "1", 1.0), (2, "2", None)], [(5, "1", 1.0), (6, "2", 7.0)])
    require_aligned(mine, theirs, ["k"], {"a": "a", "b": "b"})
    with pytest.raises(ValueError, match="a"):
        require_aligned(mine, theirs.withColumn("a", F.lit("9")), ["k"], {"a": "a"})
    with pytest.raises(ValueError, match="one side"):
        require_aligned(mine, theirs.where("k = 5"), ["k"], {"a": "a"})
