"""Sinks: formats, unions of unlike columns, atomic and guarded writes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order first seen, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, mode="errorifexists", nullValue="")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="errorifexists", ignoreNullFields=False)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet by split; a reader of one split opens only its files."""
    df.write.partitionBy(split).parquet(path, mode="errorifexists")


def free_path(spark: SparkSession, path: str) -> str:
    """``path``, or the first of ``stem.1.ext``, ``stem.2.ext``, ... where there is nothing yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if stem else (name, "")
    tries = chain([name], (f"{stem}.{k}{ext}" for k in count(1)))
    free = next(x for x in tries if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")))
    return f"{folder}/{free}"


def replace(df: DataFrame, path: str, required: Sequence[str]) -> DataFrame:
    """Writes beside ``path``, checks what was written, and then takes its place by renames; the old folder stays until then."""
    spark = df.sparkSession
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    new, old, at = Path(path + ".new"), Path(path + ".old"), Path(path)
    fs = at.getFileSystem(conf)
    df.write.parquet(path + ".new", mode="overwrite")
    missing = set(required) - set(spark.read.parquet(path + ".new").columns)
    if missing:
        fs.delete(new, True)
        raise ValueError(f"missing columns: {sorted(missing)}")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
    return spark.read.parquet(path)


def prediction_line(utt: Column, scores: dict[str, Column], valid: Column) -> Column:
    """A semicolon record with six decimals; blanks for invalid rows."""
    parts = [F.concat(F.lit(f"{k}:"), F.when(valid, F.coalesce(F.format_string("%.6f", v), F.lit(""))).otherwise("")) for k, v in scores.items()]
    return F.concat_ws("; ", F.concat(utt, F.lit(".wav")), *parts, F.concat(F.lit("Valid:"), F.when(valid, "T").otherwise("F")))


def speaker_lists(df: DataFrame, speaker: str, utt: str) -> DataFrame:
    """``speaker, line``: a speaker's utterances in order, as one line."""
    return df.groupBy(speaker).agg(F.array_join(F.sort_array(F.collect_list(utt)), " ").alias("utts")).select(speaker, F.concat_ws(" ", speaker, "utts").alias("line"))
