"""The cache by content, merged arguments, and discovery of files."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.cache import ContentCache, FutureData, stable_key

SCHEMA = "value long, used long, allowed long"


def fetcher(path, calls, used=1, mode="a"):
    cache = ContentCache(path, {"x": F.col("x"), "mode": F.lit(mode)})

    def compute(missing):
        calls.append(sorted(r.x for r in missing.collect()))
        return missing.select("key", (F.coalesce("x", F.lit(-1)) * 10).alias("value"), F.lit(used).cast("long").alias("used"), F.lit(1).cast("long").alias("allowed"))

    return lambda df: {(r.x, r.value, r.hit) for r in cache.fetch(df, compute, SCHEMA, "used", "allowed").collect()}


def test_cache(spark, tmp_path):
    path, calls = f"file://{tmp_path}/c", []
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "x long")
    get = fetcher(path, calls)
    assert get(df(1, 2, 2)) == {(1, 10, False), (2, 20, False)}
    assert get(df(2, 3)) == {(2, 20, True), (3, 30, False)}
    assert get(df()) == set() and calls == [[1, 2], [3], []]
    assert fetcher(path, calls, mode="b")(df(1)) == {(1, 10, False)}  # another payload, another key
    # a row whose payload doesn't give its key is computed anew
    key = df(9).select(stable_key({"x": F.col("x"), "mode": F.lit("a")})[1].alias("k")).first().k
    spark.createDataFrame([(key, '{"mode":"a","x":8}', 5, 1, 1, key[:2])], f"key string, _payload string, {SCHEMA}, part string").write.mode("append").partitionBy("part").parquet(path)
    assert get(df(9)) == {(9, 90, False)} and get(df(9)) == {(9, 90, True)}


def test_cache_keeps_nothing_that_saw_the_future(spark, tmp_path):
    path, calls = f"file://{tmp_path}/c", []
    one = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(FutureData, match="used 2 of 1"):
        fetcher(path, calls, used=2)(one)
    assert fetcher(path, calls)(one) == {(1, 10, False)} and calls == [[1], [1]]


def test_keys_are_stable(spark):
    row = spark.range(1).select(*stable_key({"b": F.lit(None).cast("string"), "a": F.lit("é\"")})).first()
    assert row[0] == '{"a":"é\\"","b":null}'


def test_overridden(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), ({}, {})], "base map<string,string>, own map<string,string>")
    assert [r.m for r in df.select(X.overridden(F.col("base"), F.col("own")).alias("m")).collect()] == [{"a": "1", "b": None, "c": "3"}, {}]
