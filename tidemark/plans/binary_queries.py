"""Binary archives, arrays on disk, and sound files by byte ranges: written from the tables, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import ranges as B
from tidemark.sources.npy import Npy
from tidemark.sources.scratch import folder

from .registry import Tables, query
from .sequence_queries import _ev


@query("SELECT 'v' || vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 8 END AS n_rows, CASE WHEN vec_id % 3 = 0 THEN 64 ELSE 8 END AS n_cols, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, round(embedding[12]::DOUBLE, 6) AS twelfth FROM embeddings")
def a2_binary_archives(t: Tables) -> DataFrame:
    """Vectors and 8 x 8 matrices in binary archives, with an index of text lines."""
    key = F.concat(F.lit("v"), "vec_id").alias("key")
    vectors = t.embeddings.where("vec_id % 3 = 0").select(key, F.col("embedding").alias("data"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    matrices = t.embeddings.where("vec_id % 3 <> 0").select(key, matrix.alias("data"))
    index, root = folder(t.spark, "scp"), folder(t.spark, "ark")
    for part in (vectors, matrices):
        B.index_lines(B.write_archives(part, "key", "data", root)).write.mode("append").text(index)
    found = B.read_archives(B.index_of(t.spark, index)).where("error IS NULL")
    return found.select("key", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("s"), F.round(F.get("data", F.lit(11)), 6).alias("twelfth"))


@query("SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE), 4) AS last FROM embeddings GROUP BY 1")
def a10_a11_b2_arrays(t: Tables) -> DataFrame:
    """Rows of a label and an embedding as an array on disk, read in slabs of 100 rows."""
    t.spark.dataSource.register(Npy)
    path = folder(t.spark, "array")
    rows = t.embeddings.select(F.lit(0).cast("long").alias("row"), F.concat(F.array(F.col("label").cast("double")), F.col("embedding").cast("array<double>")).alias("data"))
    rows.write.format("npy").option("path", path).option("kind", "<f8").mode("append").save()
    back = t.spark.read.format("npy").option("path", path).option("rows", 100).load()
    part = lambda i: F.get("data", F.lit(i))
    return back.groupBy(part(0).cast("int").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(part(1)), 4).alias("first"), F.round(F.sum(part(64)), 4).alias("last"))


@query("WITH x AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) % 30000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(n) AS frames, round(max(n) / 10.0::DOUBLE, 6) AS duration, least(max(n), 26) - 13 AS part_frames, sum(s) FILTER (k > 13 AND k <= 26) AS part_sum FROM x GROUP BY 1 HAVING max(n) > 13")
def a17_wav_parts(t: Tables) -> DataFrame:
    """Sound files of 10 Hz from a user's events; of each the seconds 1.3 to 2.55 are cropped to a file and read again."""
    ev = _ev(t)
    samples = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", (F.floor(F.col("value") * 100) % 30000).cast("short").alias("s")))).alias("x"))
    wavs = B.write_wavs(samples.select("user_id", F.col("x.s").alias("s")), "user_id", "s", 10, folder(t.spark, "wav"))
    crops = B.wav_parts(wavs, "path", F.lit(1.3), F.lit(2.55), keep=folder(t.spark, "crops")).where("part_frames > 0")
    back = B.wav_parts(crops.select("name", "part_path", F.col("frames").alias("all_frames"), F.col("duration").alias("all_seconds")), "part_path", F.lit(0.0), F.lit(1e6))
    values = F.transform(F.sequence(F.lit(0), F.col("part_frames").cast("int") - 1), lambda i: F.conv(F.hex(F.concat(F.substring(F.col("part"), 2 * i + 2, F.lit(1)), F.substring(F.col("part"), 2 * i + 1, F.lit(1)))), 16, 10).cast("long"))
    return back.select(F.col("name").cast("long").alias("user_id"), F.col("all_frames").alias("frames"), F.round("all_seconds", 6).alias("duration"), "part_frames", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("part_sum"))
