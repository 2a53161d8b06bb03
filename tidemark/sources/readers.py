"""Readers of the text formats, as DataFrames with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "map<string, struct<text: string, accuracy: double, completeness: double, fluency: double, prosodic: double, total: double, words: array<struct<text: string, accuracy: double, stress: double, total: double, phones: array<string>, `phones-accuracy`: array<double>>>>>"


#: The place of a line: files by path, their blocks by offset, and lines within a block.
PLACE = "struct<file: string, start: bigint, line: bigint>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, value``: lines with their place; ``idx`` orders them as the files do, by path and offset."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(place.alias("idx"), F.regexp_replace("value", "^﻿", "").alias("value"))


def csv_matrix(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A headerless comma-separated file with its row order in ``idx``."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    lines = numbered_lines(spark, path)
    parsed = lines.select("idx", F.from_csv("value", columns, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("idx", *[F.col("r")[n].alias(n) for n in names])


def header_records(spark: SparkSession, path: str, columns: str, key: str) -> DataFrame:
    """``key, records``: the rows of comma-separated files with a header, by key, in the order of the files."""
    rows = spark.read.csv(path, schema=columns, header=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    each = rows.select(F.col(key), F.struct(place.alias("idx"), F.struct(*rows.columns).alias("r")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("records"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``key  [ v v v ]`` lines: the key, the first value as the phone's id, and the vector. The text form of the archives."""
    lines = numbered_lines(spark, path).select("idx", F.split(F.trim(F.regexp_replace("value", r"[\[\]]", " ")), r"\s+").alias("p")).where(F.size("p") > 1)
    values = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.try_cast("float"))
    return lines.select("idx", F.get("p", F.lit(0)).alias("key"), F.get(values, F.lit(0)).cast("int").alias("phone_id"), values.alias("feat"))


def key_path(spark: SparkSession, paths: Sequence[str], root: str, sep: str = r"\s+") -> DataFrame:
    """``utt_id, path`` lists merged; a later file's line wins. Relative paths begin at ``root``."""
    parts = [numbered_lines(spark, p).withColumn("file", F.lit(k)) for k, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    pair = F.split(F.trim("value"), sep, 2)
    rows = rows.where(F.size(pair) == 2).select(F.get(pair, F.lit(0)).alias("utt_id"), F.get(pair, F.lit(1)).alias("p"), "file", "idx")
    last = rows.groupBy("utt_id").agg(F.max_by("p", F.struct("file", "idx")).alias("p"))
    return last.select("utt_id", F.when(F.col("p").startswith("/"), F.col("p")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "p")).alias("path"))


def resolve_rx(rx: Column, parent: Column) -> Column:
    """``path:offset`` against the list's folder; what starts with ark:, scp:, / or ends in a pipe stays."""
    return F.when(F.rlike(rx, F.lit(r"^(ark:|scp:|/)|\|\s*$")), rx).otherwise(F.concat(parent, F.lit("/"), rx))


def score_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per phone of a JSON object keyed by utterance; words without phones give one row with null phone."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", DOCUMENT)).alias("utt_id", "d"))
    words = docs.select("utt_id", *[F.col(f"d.{c}").alias(f"utt_{c}") for c in ("accuracy", "completeness", "fluency", "prosodic", "total")], F.posexplode_outer("d.words").alias("word_id", "w"))
    phones = words.select(
        "utt_id",
        *[c for c in words.columns if c.startswith("utt_") and c != "utt_id"],
        "word_id",
        F.col("w.text").alias("word"),
        *[F.col(f"w.{c}").alias(f"word_{c}") for c in ("accuracy", "stress", "total")],
        F.size("w.phones").alias("n_phones"),
        F.size(F.col("w")["phones-accuracy"]).alias("n_scores"),
        F.posexplode_outer(F.arrays_zip(F.col("w.phones").alias("phone"), F.col("w")["phones-accuracy"].alias("score"))).alias("phone_idx", "p"),
    )
    return phones.select(*[c for c in phones.columns if c != "p"], F.col("p.phone").alias("phone"), F.col("p.score").alias("phone_score"))


def json_lines(spark: SparkSession, path: str, schema: str, head: int | None = None, drop_bad: bool = True) -> DataFrame:
    """One object a line; blank lines and, if told so, unreadable ones are left out; a byte-order mark is dropped."""
    fields = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select("idx", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("idx", "r.*")
    rows = rows.where("_corrupt IS NULL").drop("_corrupt") if drop_bad else rows
    return rows if head is None else rows.orderBy("idx").limit(head)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines at ``path``, or no rows where there is nothing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"idx {PLACE}, {schema}")
    return json_lines(spark, path, schema)


def transcripts(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """``utt_id<TAB>text``; the last line of an id wins."""
    pair = F.split("value", "\t", 2)
    rows = numbered_lines(spark, path).where(F.size(pair) == 2).select("idx", F.trim(F.get(pair, F.lit(0))).alias("utt_id"), F.get(pair, F.lit(1)).alias("text"))
    rows = rows.withColumn("text", F.trim("text")) if strip else rows
    return rows.groupBy("utt_id").agg(F.max_by("text", "idx").alias("text"))


def lexicon(spark: SparkSession, path: str, keep_stress: bool = True) -> DataFrame:
    """``WORD ph ph``: the first entry of a word wins."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).where(F.size(parts) > 1).select("idx", F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts)).alias("phones"))
    if not keep_stress:
        rows = rows.withColumn("phones", F.transform("phones", lambda p: F.regexp_replace(p, r"\d", "")))
    return rows.groupBy("word").agg(F.min_by("phones", "idx").alias("phones"))


def prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id.wav; A:..; F:..; ...; Valid:T; ...; alignment:[...]`` lines, by key; numbers that are none are null."""
    entry = F.regexp_replace("value", r";\s*alignment:.*$", "")
    pairs = F.transform(F.slice(F.split(entry, ";"), F.lit(2), F.size(F.split(entry, ";"))), lambda x: F.split(F.trim(x), ":", 2))
    kv = F.map_from_entries(F.filter(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.get(p, F.lit(1)).alias("v"))), lambda e: F.coalesce(e["k"], F.lit("")) != ""))
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = rows.select("idx", F.regexp_replace(F.trim(F.substring_index("value", ";", 1)), r"\.wav$", "").alias("utt_id"), kv.alias("kv"), F.regexp_extract("value", r"alignment:(.*)$", 1).alias("raw"))
    num = lambda k: F.col("kv").getItem(k).try_cast("double")
    spans = F.from_json(F.replace("raw", F.lit("'"), F.lit('"')), "array<array<string>>")
    aligned = F.transform(spans, lambda a: F.struct(F.get(a, F.lit(0)).try_cast("double").alias("start"), F.get(a, F.lit(1)).try_cast("double").alias("end"), F.get(a, F.lit(2)).alias("word")))
    lists = lambda k: F.transform(F.split(F.col("kv").getItem(k), ","), lambda x: x.try_cast("double"))
    return rows.select(
        "idx", "utt_id", *[num(k).alias(n) for k, n in (("A", "accuracy"), ("F", "fluency"), ("P", "prosodic"), ("T", "total"))], (F.col("kv").getItem("Valid") == "T").alias("valid"),
        *[lists(k).alias(n) for k, n in (("w_a", "word_accuracy"), ("w_s", "word_stress"), ("w_t", "word_total"))], aligned.alias("alignment"),
    )


def after_noise(raw: Column, schema: str) -> Column:
    """A JSON object behind log lines: parsed from the first brace on; null if there is none."""
    return F.when(F.locate("{", raw) > 0, F.from_json(F.substring(raw, F.locate("{", raw), F.length(raw)), schema))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """``symbol<TAB>id``."""
    p = F.split(F.trim("value"), r"\s+")
    return numbered_lines(spark, path).where(F.size(p) == 2).select(F.get(p, F.lit(0)).alias("symbol"), F.get(p, F.lit(1)).try_cast("int").alias("id"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """The integer of every ``seed:`` line."""
    rows = numbered_lines(spark, path).select("idx", F.regexp_extract("value", r"^\s*-?\s*seed:\s*(\d+)", 1).try_cast("int").alias("seed"))
    return rows.where("seed IS NOT NULL")


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths and sizes below ``folder`` whose names match; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def wav_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``path, rate, channels, frames, duration`` from 44-byte RIFF headers."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    le = lambda at, n: F.conv(F.array_join(F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substring(F.col("content"), F.lit(at) + i, F.lit(1)))), ""), 16, 10).cast("long")
    rows = raw.select("path", le(24, 4).alias("rate"), le(22, 2).alias("channels"), le(34, 2).alias("bits"), le(40, 4).alias("bytes"))
    frames = F.try_divide(F.col("bytes"), F.col("channels") * F.col("bits") / 8)
    return rows.select("path", "rate", "channels", frames.cast("long").alias("frames"), F.try_divide(frames, F.col("rate")).alias("duration"))


def wav_prefix(content: Column, seconds: float, rate: int, width: int = 2) -> Column:
    """Header and the samples of the first ``ceil(seconds * rate) + 1`` frames of a mono file; nothing later is passed on."""
    import math

    return F.substring(content, 1, 44 + width * (math.ceil(seconds * rate) + 1))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
