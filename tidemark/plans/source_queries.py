"""Readers and writers on the driver tables: each query writes a format and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import writers as W
from tidemark.sources.scratch import folder

from .registry import Tables, query


def _lines(t: Tables, df: DataFrame, value: Column, name: str) -> str:
    path = folder(t.spark, name)
    df.select(value.cast("string").alias("value")).write.text(path)
    return path


@query("SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, count(nullif(l_tax, 0)) AS taxed FROM lineitem GROUP BY 1")
def a1_b1_csv_matrix(t: Tables) -> DataFrame:
    path = folder(t.spark, "csv")
    W.write_csv(t.lineitem.select("l_linestatus", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")), path, header=False)
    m = R.csv_matrix(t.spark, path, "l_linestatus string, l_quantity double, l_tax double")
    return m.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.count("l_tax").alias("taxed"))


@query("SELECT 'v' || vec_id AS key, CAST(label AS INTEGER) AS phone_id, 65 AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + label, 2) AS s FROM embeddings")
def a2_vectors(t: Tables) -> DataFrame:
    e = t.embeddings
    path = _lines(t, e, F.concat(F.lit("v"), "vec_id", F.lit("  [ "), "label", F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " "), F.lit(" ]")), "ark")
    total = F.aggregate("feat", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return R.vectors(t.spark, path).select("key", "phone_id", F.size("feat").alias("n"), F.round(total, 2).alias("s"))


@query("SELECT 'p' || page_id AS utt_id, CASE WHEN page_id % 5 = 0 THEN '/second' ELSE '/root/wav' END || '/' || page_id || '.wav' AS path FROM pages")
def a3_a4_key_path(t: Tables) -> DataFrame:
    key = F.concat(F.lit("p"), "page_id")
    a = _lines(t, t.pages, F.concat(key, F.lit(" wav/"), "page_id", F.lit(".wav")), "scp")
    b = _lines(t, t.pages.where("page_id % 5 = 0"), F.concat(key, F.lit("   /second/"), "page_id", F.lit(".wav")), "scp")
    return R.key_path(t.spark, [a, b], "/root/")


@query("SELECT 'o' || o_orderkey AS utt_id, count(*) AS phones, round(sum(l_quantity), 2) AS s, round(any_value(o_totalprice), 2) AS utt_total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a5_score_documents(t: Tables) -> DataFrame:
    words = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_linestatus").alias("phones"), F.collect_list("l_quantity").alias("phones-accuracy"))
    words = words.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("text"), F.lit(1.0).alias("accuracy"), F.lit(2.0).alias("stress"), F.lit(3.0).alias("total"), "phones", "phones-accuracy")).alias("words"))
    o = t.orders.join(words, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct(F.lit("t").alias("text"), F.lit(1.0).alias("accuracy"), F.lit(1.0).alias("completeness"), F.lit(1.0).alias("fluency"), F.lit(1.0).alias("prosodic"), F.col("o_totalprice").alias("total"), "words")
    rows = o.select(F.from_json(F.to_json(F.create_map(F.concat(F.lit("o"), "o_orderkey"), doc)), R.DOCUMENT).alias("m")).select(F.explode("m").alias("utt_id", "d"))
    flat = rows.select("utt_id", F.col("d.total").alias("utt_total"), F.explode("d.words").alias("w")).select("utt_id", "utt_total", F.explode(F.arrays_zip(F.col("w")["phones-accuracy"].alias("s"))).alias("x"))
    return flat.groupBy("utt_id").agg(F.count("*").alias("phones"), F.round(F.sum("x.s"), 2).alias("s"), F.round(F.max("utt_total"), 2).alias("utt_total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_id % 10 <> 3 GROUP BY 1")
def a6_a7_q5_json_lines(t: Tables) -> DataFrame:
    good = F.to_json(F.struct("event_type", "value"))
    path = _lines(t, t.events, F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(good), "jsonl")
    rows = R.json_lines(t.spark, path, "event_type string, value double")
    none = R.optional(t.spark, path + "-missing", "event_type string, value double")
    return rows.unionByName(none).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT 'd' || doc_id AS utt_id, lang || ' of ' || source AS text FROM documents WHERE lang IS NOT NULL")
def a8_transcripts(t: Tables) -> DataFrame:
    d = t.documents.where("lang IS NOT NULL")
    return R.transcripts(t.spark, _lines(t, d, F.concat(F.lit("d"), "doc_id", F.lit("\t"), "lang", F.lit(" of "), "source", F.lit("  ")), "tsv"))


@query("SELECT p_brand AS word, count(*) AS n FROM (SELECT DISTINCT p_brand, upper(p_type) FROM part) GROUP BY 1")
def a9_lexicon(t: Tables) -> DataFrame:
    entries = t.part.select("p_brand", F.upper("p_type").alias("ph")).distinct()
    path = _lines(t, entries, F.concat_ws(" ", F.replace("p_brand", F.lit(" "), F.lit("_")), "ph"), "lexicon")
    found = R.lexicon(t.spark, path).select(F.col("word").alias("w"))
    return entries.join(found, F.replace("p_brand", F.lit(" "), F.lit("_")) == F.col("w")).groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("n"))


@query("SELECT 'c' || c_custkey AS utt_id, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 6) END AS accuracy, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS DOUBLE) END AS total, c_acctbal > 0 AS valid FROM customer")
def a12_b8_prediction_lines(t: Tables) -> DataFrame:
    line = W.prediction_line(F.concat(F.lit("c"), "c_custkey"), {"A": F.col("c_acctbal"), "T": F.col("c_nationkey").cast("double")}, F.col("c_acctbal") > 0)
    return R.prediction_lines(t.spark, _lines(t, t.customer, line, "predictions")).select("utt_id", "accuracy", "total", "valid")


@query("SELECT n_name AS symbol, n_nationkey AS id FROM nation")
def a14_symbols(t: Tables) -> DataFrame:
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    found = R.symbols(t.spark, _lines(t, t.nation, F.concat(name, F.lit("\t"), "n_nationkey"), "symbols")).select(F.col("symbol").alias("s"), "id")
    return t.nation.join(found, name == F.col("s")).select(F.col("n_name").alias("symbol"), "id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a15_a16_json_behind_noise(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("WARN step "), F.col("event_id").cast("string"), F.lit("\n"), F.col("props"))
    return t.events.select("event_id", R.after_noise(raw, "k bigint")["k"].alias("k"))


@query("SELECT event_id % 100 AS seed, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def a20_seeds(t: Tables) -> DataFrame:
    path = _lines(t, t.events, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  seed: "), (F.col("event_id") % 100).cast("string"))).otherwise("other: 1"), "yaml")
    return R.seeds(t.spark, path).groupBy(F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"))


@query("SELECT 'correct' AS subset, l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 49 UNION ALL SELECT 'error', l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 49")
def a21_tagged_arrays(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_quantity > 49").groupBy((F.col("l_orderkey") % 64).alias("g")).agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("correct"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey"))).alias("error")
    )
    parts = [rows.select(F.lit(k).alias("subset"), F.explode(k).alias("id")) for k in ("correct", "error")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'a' AS kind, r_regionkey AS k, r_name AS name, NULL::VARCHAR AS extra FROM region UNION ALL SELECT 'b', n_nationkey, NULL, n_name FROM nation")
def b4_dynamic_header(t: Tables) -> DataFrame:
    a = t.region.select(F.lit("a").alias("kind"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = t.nation.select(F.lit("b").alias("kind"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("extra"))
    path = folder(t.spark, "union")
    W.write_json_lines(W.union_all([a, b]), path)
    return t.spark.read.schema("kind string, k int, name string, extra string").json(path)


@query("SELECT o_orderstatus AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def a10_a11_b2_splits(t: Tables) -> DataFrame:
    path = folder(t.spark, "splits")
    W.write_splits(t.orders.select(F.col("o_orderstatus").alias("split"), "o_totalprice"), path)
    rows = R.require_columns(t.spark.read.parquet(path), ["o_totalprice"]).where("split <> 'P'")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_nationkey, s_nationkey || ' ' || string_agg(s_suppkey, ' ' ORDER BY CAST(s_suppkey AS VARCHAR)) AS line FROM supplier GROUP BY 1")
def b7_speaker_lists(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_nationkey").cast("string").alias("spk"), F.col("s_suppkey").cast("string").alias("utt"))
    return W.speaker_lists(rows, "spk", "utt").select(F.col("spk").cast("int").alias("s_nationkey"), "line")


@query("SELECT sha256('{\"b\":\"' || p_brand || '\",\"s\":' || p_size || '}') AS key, count(*) AS n FROM part GROUP BY 1")
def b10_cache_keys(t: Tables) -> DataFrame:
    key = F.sha2(F.to_json(F.struct(F.col("p_brand").alias("b"), F.col("p_size").alias("s"))), 256)
    return t.part.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang || chr(10) || 'ASR: ' || coalesce(b.text, '') || chr(10) || source AS body FROM documents LEFT JOIN benchmark b ON doc_id = item_id WHERE lang IS NOT NULL AND source IS NOT NULL")
def b11_text_patch(t: Tables) -> DataFrame:
    """Each document's record, its old text replaced by the whole text of the item with its id."""
    b = t.benchmark.select("item_id", F.col("text").alias("item"))
    body = F.concat_ws("\n", "lang", F.lit("ASR: old"), "source")
    rows = t.documents.where("lang IS NOT NULL AND source IS NOT NULL").join(b, F.col("doc_id") == F.col("item_id"), "left")
    return rows.select("doc_id", F.replace(body, F.lit("ASR: old"), F.concat(F.lit("ASR: "), F.coalesce("item", F.lit("")))).alias("body"))


@query("SELECT doc_id % 10 AS g, count(*) FILTER (l.doc_id IS NOT NULL) AS present, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def a18_a19_b12_missing_list(t: Tables) -> DataFrame:
    have = t.labels.select("doc_id").distinct().withColumn("have", F.lit(1))
    return t.documents.select("doc_id").join(have, "doc_id", "left").groupBy((F.col("doc_id") % 10).alias("g")).agg(F.count("have").alias("present"), F.count_if(F.col("have").isNull()).alias("missing"))


@query("SELECT l_orderkey, l_linenumber AS i, l_shipmode FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode, l_quantity FROM lineitem) WHERE l_quantity > 30")
def o1_asr_flatten(t: Tables) -> DataFrame:
    word = F.struct(F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).alias("text"), F.col("l_linenumber").alias("start"))
    segs = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(word).alias("words")).groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("words")).alias("segments"))).alias("j"))
    doc = segs.select("l_orderkey", F.from_json("j", "segments array<struct<words: array<struct<text: string, start: int>>>>").alias("d"))
    rows = doc.select("l_orderkey", F.explode("d.segments").alias("s")).select("l_orderkey", F.explode("s.words").alias("w"))
    return rows.where("w.text IS NOT NULL AND w.start IS NOT NULL").select("l_orderkey", F.col("w.start").alias("i"), F.col("w.text").alias("l_shipmode"))


@query("SELECT n_nationkey, MAP {'a': 1, 'b': n_regionkey, 'c': 3}::VARCHAR AS merged FROM nation")
def o15_argument_merge(t: Tables) -> DataFrame:
    base, own = {"a": F.lit(1), "b": F.lit(0)}, {"b": F.col("n_regionkey"), "c": F.lit(3)}
    merged = base | own
    return t.nation.select("n_nationkey", F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(merged.items())]), F.lit("}")).alias("merged"))
