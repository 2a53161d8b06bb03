"""Shared helpers: table access, shared storage, and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java regular expressions.
BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Shuffle files go with their query; batches for Python workers are small, whatever the texts' lengths.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/tidemark"
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage; a lost executor costs no recomputation.

    The shuffle files behind it aren't needed any more and go as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        Path = spark._jvm.org.apache.hadoop.fs.Path
        root = Path(shared_dir(spark)).toUri().getPath() + "/"
        for file in df.inputFiles()[:1]:
            folder = Path(file).getParent()
            if folder.toUri().getPath().startswith(root):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = f"[{BLANK}]+") -> Column:
    """Maximal runs between ``separators``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def shifted(values: Column, by: int, drop: int | None = None) -> Column:
    """``values`` from index ``by`` on, without its last ``drop`` items."""
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by - (drop or 0), F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
