"""A cache of computed rows, addressed by the content of what they were computed from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder


class FutureData(ValueError):
    """A cached or computed row used more of its source than its payload allows."""


def stable_key(payload: dict[str, Column]) -> tuple[Column, Column]:
    """The payload as JSON with its fields in the order of their names, nulls included, and the SHA-256 of that."""
    text = F.to_json(F.struct(*[payload[n].alias(n) for n in sorted(payload)]), {"ignoreNullFields": "false"})
    return text, F.sha2(text, 256)


class ContentCache:
    """Rows by key below ``path``, in a folder for each two first digits of the key, so that a lookup opens no more than it needs.

    ``fetch`` computes what is missing and adds it, once, when it is called; a row whose payload doesn't give its key counts as missing. A key that
    was added twice, as by two builds at a time, is read once.
    """

    def __init__(self, path: str, payload: dict[str, Column]):
        self.path, self.payload = path.rstrip("/"), payload

    def _held(self, spark: SparkSession, schema) -> DataFrame:
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
        return spark.read.schema(schema).option("basePath", self.path).parquet(self.path) if there else spark.createDataFrame([], schema)

    def fetch(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], schema: str, used: str, allowed: str) -> DataFrame:
        """``wanted`` with ``key, hit`` and the columns of ``schema``, by its distinct payloads.

        ``compute`` takes ``key`` and the columns of ``wanted`` for the missing keys, one row each, and returns ``key`` and
        the columns of ``schema``. Raises ``FutureData`` if a row's ``used`` is more than its ``allowed``; nothing is kept
        of such a computation.
        """
        spark = wanted.sparkSession
        text, key = stable_key(self.payload)
        asked = wanted.withColumn("key", key).withColumn("_payload", text)
        kept = f"key string, _payload string, {schema}, part string"
        held = self._held(spark, kept)
        parts = [r[0] for r in asked.select(F.substring("key", 1, 2)).distinct().collect()]  # 256 at most
        good = held.where(F.col("part").isin(parts) & (F.sha2("_payload", 256) == F.col("key"))).dropDuplicates(["key"]).drop("_payload", "part")
        self._check(good.join(asked.select("key"), "key", "left_semi"), used, allowed)
        missing = asked.join(good.select("key"), "key", "left_anti").dropDuplicates(["key"])
        made = compute(missing.drop("_payload")).join(missing.select("key", "_payload"), "key").withColumn("part", F.substring("key", 1, 2))
        fresh = folder(spark, "computed")
        made.select(*spark.createDataFrame([], kept).columns).write.parquet(fresh)
        new = spark.read.schema(kept).parquet(fresh)
        self._check(new, used, allowed)
        before = good.join(asked.select("key"), "key", "left_semi").withColumn("hit", F.lit(True))
        new.repartition("part").write.mode("append").partitionBy("part").parquet(self.path)
        found = before.unionByName(new.drop("_payload", "part").withColumn("hit", F.lit(False)))
        return asked.drop("_payload").join(found, "key", "left")

    def _check(self, rows: DataFrame, used: str, allowed: str) -> None:
        bad = rows.where(F.col(used) > F.col(allowed)).select("key", used, allowed).first()
        if bad:
            raise FutureData(f"{bad.key} used {bad[used]} of {bad[allowed]}")
