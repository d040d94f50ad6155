"""The search-string join equals the brute-force test, broadcast or salted."""

import itertools

import pytest

from corpusspark.functions import sizing
from corpusspark.operators.search_strings import contained


@pytest.mark.parametrize("rows", [1000, 0])
def test_contained_equals_brute_force(spark, rows):
    needles = ["a", "ab", "abc", "bca", "数据", "权", "zzz", "the cat", "cat"]
    texts = ["".join(t) for t in itertools.product("abc", repeat=4)] + ["数据权限", "the cat sat", "", "at"] * 3
    expected = sorted((n, i) for n in needles for i, t in enumerate(texts) if n in t)
    got = contained(spark.createDataFrame([(n,) for n in needles], "needle string"),
                    spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", broadcast_rows=rows)
    assert sorted((r["needle"], r["id"]) for r in got.collect()) == expected


def test_lookup_join_salts_a_hot_key(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k")
    small = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    for rows in (10, 0):
        assert sizing.lookup_join(big, small, ["k"], "left", rows=rows, spread=["id"]).where("v is not null").count() == 335


def test_numbered_spans_partitions(spark):
    from pyspark.sql import functions as F

    from corpusspark.functions.numbering import numbered

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 7919 % 3001).alias("o"))
    got = {(r["g"], r["o"]): r["n"] for r in numbered(rows, ["g"], "o", "n").collect()}
    order = {}
    for g, o in sorted(got):
        order[g] = order.get(g, 0) + 1
        assert got[(g, o)] == order[g]
