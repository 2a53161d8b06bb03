"""Resuming long builds: a keyed sink that a restarted stream may write to again, remaining work, and a gate on what is unfinished.

The sink keeps its rows in buckets of the key. A batch writes new versions of the buckets that it touches and, last, a list
of the current version of each; readers follow the newest list that is whole. A batch that is run again after a failure
writes the same versions and the same list, so each key counts once, whatever was interrupted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses that end a key's work.
DONE = ("ok", "skipped")
#: Rows of a report that name what is missing.
PREVIEW = 20


class KeyedSink:
    """The row of the greatest ``order`` for each key, in ``buckets`` buckets below ``path``. Usable as a ``foreachBatch`` function.

    Ties in ``order`` keep the greatest row. A null order comes before all others. One stream writes at a time.
    """

    def __init__(self, path: str, keys: Sequence[str], order: str, buckets: int = 64):
        self.path, self.keys, self.order, self.buckets = path.rstrip("/"), list(keys), order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def epochs(self, spark: SparkSession) -> list[int]:
        """Batches whose list is whole, in order."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "epoch=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The current version of each bucket: as many entries as there are buckets."""
        known = [e for e in self.epochs(spark) if before is None or e < before]
        if not known:
            return {}
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{self.path}/lists/epoch={known[-1]}").collect()}

    def _read(self, spark: SparkSession, versions: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        whole = F.struct(*rest)
        return rows.groupBy(*self.keys).agg(F.max_by(whole, F.struct(F.col(self.order).isNotNull(), self.order, whole)).alias("_r")).select(*self.keys, "_r.*")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = self._versions(spark, epoch)
        batch = batch.persist()
        try:
            touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
            old = self._read(spark, {b: v for b, v in before.items() if b in touched}, batch.schema)
            latest = self._latest(old.unionByName(batch)).withColumn("bucket", self._bucket())
            if touched:
                latest.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/rows/version={epoch}")
            now = {**before, **dict.fromkeys(touched, epoch)}
            listed = spark.createDataFrame(sorted(now.items()), "bucket int, version long")
            listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/lists/epoch={epoch}")
        finally:
            batch.unpersist()

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of the newest whole list, without partition columns."""
        return self._read(spark, self._versions(spark), schema)

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes versions and lists that the newest list doesn't need; returns how many versions of buckets went."""
        versions, known = self._versions(spark), self.epochs(spark)
        Path = spark._jvm.org.apache.hadoop.fs.Path
        files = Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        gone = 0
        for s in files.globStatus(Path(f"{self.path}/rows/version=*/bucket=*")) or []:
            version, bucket = (int(n.split("=")[1]) for n in (s.getPath().getParent().getName(), s.getPath().getName()))
            if known and version <= known[-1] and versions.get(bucket) != version:
                files.delete(s.getPath(), True)
                gone += 1
        for e in known[:-1]:
            files.delete(Path(f"{self.path}/lists/epoch={e}"), True)
        return gone


def _valid(records: DataFrame, schema_name: str) -> Column:
    return (records["schema"] == schema_name) & records["status"].isin(*DONE)


def remaining(expected: DataFrame, records: DataFrame, keys: Sequence[str], schema_name: str) -> DataFrame:
    """The expected keys without a record of this schema that is ok or skipped: what a restarted build has to do."""
    return expected.join(records.where(F.coalesce(_valid(records, schema_name), F.lit(False))).select(*keys), list(keys), "left_anti")


def progress(expected: DataFrame, records: DataFrame, keys: Sequence[str], schema_name: str) -> DataFrame:
    """One row: ``expected, ok, skipped, missing, malformed`` keys. Malformed: a record of another schema or without a known status."""
    state = F.when(records["schema"].isNull() | (records["schema"] != schema_name) | records["status"].isNull(), "malformed").when(records["status"] == "ok", "ok").when(records["status"] == "skipped", "skipped").otherwise("malformed")
    met = expected.select(*keys).distinct().join(records.select(*keys, state.alias("_state")), list(keys), "left")
    count = lambda s: F.count_if(F.col("_state") == s).alias(s)
    return met.agg(F.count("*").alias("expected"), count("ok"), count("skipped"), F.count_if(F.col("_state").isNull()).alias("missing"), count("malformed"))


class Unfinished(ValueError):
    """Raised by ``finished``; names at most PREVIEW keys."""


def finished(expected: DataFrame, records: DataFrame, keys: Sequence[str], schema_name: str) -> DataFrame:
    """The ok records of the expected keys; raises ``Unfinished`` if any key is missing or malformed."""
    r = progress(expected, records, keys, schema_name).first()
    if r.missing or r.malformed:
        some = [tuple(x) for x in remaining(expected.select(*keys).distinct(), records, keys, schema_name).limit(PREVIEW).collect()]
        raise Unfinished(f"{r.missing} of {r.expected} keys are missing and {r.malformed} malformed, such as {some}")
    ok = records.where((records["schema"] == schema_name) & (records["status"] == "ok"))
    return ok.join(expected.select(*keys).distinct(), list(keys), "left_semi")
