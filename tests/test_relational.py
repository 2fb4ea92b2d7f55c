from pyspark.sql import functions as F

from cropline.operators import relational as rel


def test_pivot_fills_missing_cells_but_keeps_null_values(spark, rows_of):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "a", 7)], "k int, n string, v int")
    assert rows_of(rel.pivot_wider(df, ["k"], "n", "v", ["a", "b", "c"])) == [(1, 5, None, 0), (2, 7, 0, 0)]


def test_column_names(spark, rows_of):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert rel.column_names(df, "k") == ["a", "b", None]
    wide = rel.pivot_wider(df.withColumn("one", F.lit(1)), ["one"], "k", "one", rel.column_names(df, "k"))
    assert wide.columns == ["one", "a", "b", "null"]
    many = spark.range(1500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit(0).alias("by"))
    assert len(rel.column_names(many, "k")) == 1500


def test_total_row(spark, rows_of):
    df = spark.createDataFrame([("x", 1, 2), (None, 10, None)], "k string, a int, b int")
    assert rows_of(rel.with_total_row(df, "k", ["a", "b"])) == sorted(
        [("x", 1, 2), (None, 10, None), ("Total", 11, None)], key=repr
    )


def test_null_safe_join(spark, rows_of):
    a = spark.createDataFrame([(1, "p"), (None, "q")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "k int, b int")
    assert rows_of(rel.join_null_safe(a, b, ["k"])) == [(1, "p", 10), (None, "q", 20)]
    assert rows_of(a.join(b, "k")) == [(1, "p", 10)]


def test_union_sources_fills_missing_columns(spark, rows_of):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert rows_of(rel.union_sources({"new": a, "old": b})) == [(1, 2, "new"), (3, None, "old")]


def test_keep_members(spark, rows_of):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "c", None])], "i int, k string")
    members = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "k string")
    assert rows_of(rel.keep_members(df, members, "k"), "i") == [(0,), (2,)]


def test_rows_without_a_key_are_spread_and_match_nothing(spark, rows_of):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k bigint, v string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k bigint, w int")
    assert rows_of(rel.left_join_spread(left, right, "k", ["v"])) == rows_of(left.join(right, "k", "left"))


def test_bind_columns_by_position(spark, rows_of, tmp_path):
    a = spark.createDataFrame([(2024, 1), (2025, 2)], "s int, x int")
    b = spark.createDataFrame([(7, 30), (5, 10)], "t int, y int")
    assert rows_of(rel.bind_columns(a, b, "s", "t", str(tmp_path / "1"))) == [(2024, 1, 5, 10), (2025, 2, 7, 30)]
    c = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (9, 8)], "t int, y int")
    assert rows_of(rel.bind_columns(c, a, "t", "s", str(tmp_path / "2"))) == [(1, 5, 2025, 2), (None, 7, 2024, 1)]


def test_relocate_and_sum_across(spark):
    df = spark.createDataFrame([(1, 2, None)], "a int, b int, c int")
    assert rel.relocate_first(df, "c").columns == ["c", "a", "b"]
    row = df.select(rel.sum_across([F.col("a"), F.col("b")]), rel.sum_across([F.col("a"), F.col("c")])).first()
    assert tuple(row) == (3, None)
