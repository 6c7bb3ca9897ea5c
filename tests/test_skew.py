from tidemark.operators import skew


def test_hot_parts_are_bounded(spark):
    rows = [("hot" if k % 3 else None if k % 2 else f"k{k}", k) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, row long")
    assert skew.hot_parts(df, "key", 50) == {"hot": 12}
    # A share bounds how many keys can be hot.
    assert skew.hot_parts(df, "key", 1, 2) == {"hot": 2}
    assert skew.hot_parts(df, "key", 1_000) == {} and skew.hot_parts(df.limit(0), "key", 1) == {}


def test_spread_join_is_a_left_join(spark):
    rows = [("hot" if k % 3 else None if k % 2 else f"k{k}", k) for k in range(900)]
    big = spark.createDataFrame(rows, "key string, row long")
    small = spark.createDataFrame([("hot", 1), ("k6", 2), ("unused", 3), (None, 4)], "key string, v int")
    got = sorted(tuple(r) for r in skew.left_join_spread(big, small, "key", "row", 50).select("row", "key", "v").collect())
    expected = sorted(tuple(r) for r in big.join(small, "key", "left").select("row", "key", "v").collect())
    assert got == expected and len(got) == 900


def test_split_join_is_an_inner_join(spark):
    rows = [("hot" if k % 3 else f"k{k}", 1, k) for k in range(900)] + [(None, 1, 5)]
    big = spark.createDataFrame(rows, "a string, b int, row long")
    small = spark.createDataFrame([("hot", 1, "x"), ("k6", 1, "y"), ("k6", 2, "z"), (None, 1, "n")], "a string, b int, v string")
    made = skew.hot_split(big, small, ["a", "b"], "row", 50)
    assert made.filter("a = 'hot'").select("part_").distinct().count() == 12
    got = sorted(tuple(r) for r in made.select("row", "a", "v").collect())
    assert got == sorted(tuple(r) for r in big.join(small, ["a", "b"]).select("row", "a", "v").collect())
