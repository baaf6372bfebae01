from cohortspan.functions.relational import (
    complete_grid, crosstab, fill_downup, null_safe_join,
)


def test_null_keys_match_each_other(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, g string, v string")
    right = spark.createDataFrame([(1, None, 10), (2, "y", 20)], "k int, g string, w int")
    assert [tuple(r) for r in null_safe_join(left, right, ["k", "g"]).collect()] == [(1, None, "a", 10)]
    both = null_safe_join(left, right, ["k", "g"], "left").orderBy("k")
    assert [tuple(r) for r in both.collect()] == [(1, None, "a", 10), (2, "x", "b", None)]


def test_grid_is_complete_and_filled(spark):
    df = spark.createDataFrame([(None, 2, 5, 9), ("b", 1, 1, 4)], "g string, m int, c int, s int")
    full = complete_grid(df, ["g"], "m", [1, 2, 3], {"c": 0})
    rows = {(r["g"], r["m"]): (r["c"], r["s"]) for r in fill_downup(full, ["g"], "m", "s").collect()}
    assert rows == {
        (None, 1): (0, 9), (None, 2): (5, 9), (None, 3): (0, 9),
        ("b", 1): (1, 4), ("b", 2): (0, 4), ("b", 3): (0, 4),
    }


def test_fill_takes_previous_then_next(spark):
    df = spark.createDataFrame([(1, None), (2, 7), (3, None), (4, 8), (5, None)], "m int, s int")
    rows = fill_downup(df.selectExpr("1 AS g", "*"), ["g"], "m", "s").orderBy("m").collect()
    assert [r["s"] for r in rows] == [7, 7, 7, 8, 8]


def test_crosstab_has_null_levels_and_empty_pairs(spark):
    df = spark.createDataFrame([(1, "Y"), (1, "Y"), (2, "N"), (2, None)], "y int, s string")
    rows = crosstab(df, "y", "s").collect()
    got = {(r["y"], r["s"]): r["count"] for r in rows}
    assert len(rows) == 9 and sum(got.values()) == 4
    assert got[(1, "Y")] == 2 and got[(2, None)] == 1 and got[(1, "N")] == 0
    assert got[(None, None)] == 0 and got[(None, "Y")] == 0


def test_crosstab_of_many_levels(spark):
    df = spark.range(12_000).selectExpr("CAST(2000 + id % 2 AS INT) AS y", "CAST(id AS STRING) AS s")
    rows = crosstab(df, "y", "s")
    assert rows.count() == 3 * 12_001
    assert rows.where("count = 1").count() == 12_000
