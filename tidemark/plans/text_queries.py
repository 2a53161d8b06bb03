"""Text, key, scalar and filter operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as X
from tidemark.operators import sets

from .registry import Tables, query


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(trim(p_brand)), '[\\[\\]]', '', 'g'), '[_\\d].*', '') AS phone, regexp_replace(upper(p_brand), '\\d', '', 'g') AS plain FROM part")
def c1_c2_phone_normalize(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.normalize_phone(F.col("p_brand")).alias("phone"), X.strip_digits(F.col("p_brand")).alias("plain"))


@query("SELECT c_custkey, regexp_replace(upper(trim(c_name)), '[^A-Z'']', '', 'g') AS word, lower(trim(c_name)) AS shown FROM customer")
def c3_word_normalize(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.normalize_word(F.col("c_name")).alias("word"), F.lower(F.trim("c_name")).alias("shown"))


@query(
    "SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS words FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: regexp_replace(upper(x), '[^A-Z'']', '', 'g')), lambda x: x <> '') AS w FROM benchmark)"
)
def c4_c12_tokenize(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", X.tokenize(F.col("text")).alias("w"))
    return w.select("item_id", F.size("w").cast("long").alias("n"), X.join_words(F.col("w")).alias("words"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))) AS h FROM documents")
def c5_wer_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize_for_wer(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).cast("binary")).alias("h"))


@query("""SELECT item_id, replace(translate(text, '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', ''), '  ', ' ') AS plain FROM benchmark""")
def c7_strip_punctuation(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.strip_punctuation(F.col("text")).alias("plain"))


@query(
    "SELECT p_partkey, trim(regexp_replace("
    + "replace(" * 10
    + "p_brand"
    + "".join(f", '{i}', ' {w} ')" for i, w in enumerate(X.DIGIT_WORDS))
    + ", ' +', ' ', 'g')) AS spelled FROM part"
)
def c8_digits_to_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.digits_to_words(F.col("p_brand")).alias("spelled"))


@query()
def c9_whole_ascii_fold(t: Tables) -> DataFrame:
    """The whole text of every document; ``strip_accents`` differs from the fold outside of French and Spanish."""
    return t.documents.select("doc_id", F.length(X.ascii_fold(F.col("text"))).cast("long").alias("n"))


@query()
def c6_transcript_normalize(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.normalize_transcript(F.col("text")).alias("plain"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(trim(p_type), ' '), lambda x: x <> ''), lambda x: upper(x)), '|') AS toks FROM part")
def c10_upper_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.upper_tokens(F.col("p_type")), "|").alias("toks"))


@query(
    "SELECT p_partkey, array_to_string(list_transform(w, lambda p, i: p || CASE WHEN len(w) = 1 THEN '_S' WHEN i = 1 THEN '_B' WHEN i = len(w) THEN '_E' ELSE '_I' END), ' ') AS tagged FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)"
)
def c11_position_tags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.position_tags(F.split("p_type", " ")), " ").alias("tagged"))


@query(
    "SELECT l_returnflag, round(sum(round_even(least(greatest(l_tax * 20, 0), 2) / 0.25, 0) * 0.25), 4) AS total FROM lineitem GROUP BY 1"
)
def c13_grid_score(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(S.grid_score(F.col("l_tax") * 20, 0.25)), 4).alias("total"))


@query(
    "SELECT event_type, count(x) AS n_good, count(*) - count(x) AS n_bad FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS x FROM events) GROUP BY 1"
)
def c14_safe_float(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "inf").otherwise(F.col("value").cast("string"))
    return t.events.withColumn("x", S.safe_float(raw)).groupBy("event_type").agg(F.count("x").alias("n_good"), (F.count("*") - F.count("x")).alias("n_bad"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS pick FROM documents")
def c15_c31_first_present(t: Tables) -> DataFrame:
    lang = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return t.documents.select("doc_id", F.coalesce(X.first_present(lang, F.col("source")), F.lit("none")).alias("pick"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def c16_variant_access(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'double')").alias("k"))


@query(
    "SELECT l_orderkey, l_linenumber, regexp_replace(k, '\\.[^.]*$', '') AS utt, CAST(regexp_extract(k, '([^.]*)$', 1) AS INTEGER) AS idx, split_part(k, '.', 1) AS utt_first, TRY_CAST(split_part(k, '.', 2) AS INTEGER) AS idx_first FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'u' || l_suppkey % 3 || CASE WHEN l_suppkey % 3 = 0 THEN '.x' ELSE '' END || '.' || l_linenumber AS k FROM lineitem)"
)
def c17_split_key(t: Tables) -> DataFrame:
    third = F.col("l_suppkey") % 3
    key = F.concat(F.lit("u"), third.cast("string"), F.when(third == 0, ".x").otherwise(""), F.lit("."), F.col("l_linenumber").cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", key.alias("k")).distinct()
    (a, i), (b, j) = X.split_key(F.col("k")), X.split_key_first(F.col("k"))
    return rows.select("l_orderkey", "l_linenumber", a.alias("utt"), i.alias("idx"), b.alias("utt_first"), j.alias("idx_first"))


@query(
    "SELECT conv_id, turn, printf('u%d_c%04d', conv_id, turn) AS eval_id, 'u' || conv_id AS source_id, sha1('u' || conv_id || chr(10) || turn) AS key_hash FROM conversations"
)
def c18_c19_c21_eval_ids(t: Tables) -> DataFrame:
    utt = F.concat(F.lit("u"), F.col("conv_id").cast("string"))
    e = X.eval_id(utt, F.col("turn"))
    return t.conversations.select("conv_id", "turn", e.alias("eval_id"), X.source_id(e).alias("source_id"), X.key_hash([utt, F.col("turn").cast("string")]).alias("key_hash"))


@query(
    "SELECT page_id, coalesce(nullif(regexp_extract(url, '(SPEAKER\\d+)', 1), ''), nullif(upper(list_extract(string_split(url, '/'), -2)), ''), substr('u' || page_id, 1, 5)) AS speaker FROM pages"
)
def c20_speaker(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.speaker(F.col("url"), F.concat(F.lit("u"), F.col("page_id").cast("string"))).alias("speaker"))


_BANDS = {"phone": ("l_tax * 25", S.PHONE_BANDS), "word": ("l_quantity / 5", S.WORD_BANDS), "stress": ("l_discount * 100", S.STRESS_BANDS), "utt": ("l_quantity / 5", S.UTTERANCE_BANDS), "flu": ("l_quantity / 6", S.FLUENCY_BANDS), "pros": ("l_quantity / 5", S.PROSODY_BANDS)}


def _band_sql(expr: str, bounds: tuple[float, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {expr} >= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


@query("SELECT " + ", ".join(f"sum({_band_sql(e, b)}) AS {k}" for k, (e, b) in _BANDS.items()) + ", l_linestatus FROM lineitem GROUP BY l_linestatus")
def c22_bands(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(*[F.sum(S.band(F.expr(e), b)).alias(k) for k, (e, b) in _BANDS.items()])


@query("SELECT l_returnflag, round(sum(least(greatest(l_quantity / 5.0 * 5, 0), 10)), 3) AS a, round(sum(least(greatest(l_quantity / 20.0, 0), 2)), 3) AS b FROM lineitem GROUP BY 1")
def c23_scales(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(S.clip(q / 5.0 * 5, 0.0, 10.0)), 3).alias("a"), F.round(F.sum(S.clip(q / 20.0, 0.0, 2.0)), 3).alias("b"))


@query("SELECT o_orderkey, round(coalesce(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END), -1), 6) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def c24_mean_or(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))).alias("q"))
    j = t.orders.select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.round(S.mean_or(F.coalesce("q", F.array().cast("array<double>")), -1.0), 6).alias("m"))


@query("SELECT vec_id, round(list_sum(list_transform(list_resize(embedding, 5, -1.0::FLOAT), lambda x: x::DOUBLE)), 5) AS s, 70 AS n FROM embeddings")
def c25_fit_length(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(S.fit_length(e, 5, F.lit(-1.0)), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.round(total, 5).alias("s"), F.size(S.fit_length(e, 70, F.lit(0.0))).alias("n"))


@query("SELECT event_id, CAST(floor(a / 0.02) AS BIGINT) AS first_frame, CAST(greatest(ceil(b / 0.02), floor(a / 0.02) + 1) AS BIGINT) AS end_frame FROM (SELECT event_id, value AS a, value + (event_id % 5) / 100.0 AS b FROM events)")
def c26_frames(t: Tables) -> DataFrame:
    a, b = S.frame_bounds(F.col("value"), F.col("value") + (F.col("event_id") % 5) / F.lit(100.0), 0.02)
    return t.events.select("event_id", a.cast("long").alias("first_frame"), b.cast("long").alias("end_frame"))


@query("SELECT item_id, i, round(i * 2.0 / n, 6) AS s, round(least(2.0, (i + 1) * 2.0 / n), 6) AS e FROM (SELECT item_id, n, unnest(range(0, n)) AS i FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark))")
def c27_uniform_segments(t: Tables) -> DataFrame:
    n = F.size(F.split("text", " "))
    rows = t.benchmark.select("item_id", F.posexplode(S.uniform_segments(n, F.lit(2.0))).alias("i", "x"))
    return rows.select("item_id", F.col("i").cast("long").alias("i"), F.round("x.start", 6).alias("s"), F.round("x.end", 6).alias("e"))


@query("SELECT r_regionkey, '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}' AS j, sha256('{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}') AS h FROM region")
def c28_json(t: Tables) -> DataFrame:
    v = F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))
    return t.region.select("r_regionkey", F.to_json(v).alias("j"), X.json_hash(v).alias("h"))


@query("SELECT user_id, round(min(value), 6) AS best, count(*) AS n FROM events GROUP BY 1")
def c30_best_of_history(t: Tables) -> DataFrame:
    h = t.events.groupBy("user_id").agg(F.collect_list(F.struct("ts", "value")).alias("h"))
    return h.select("user_id", F.round(F.array_min(F.transform("h", lambda x: x["value"])), 6).alias("best"), F.size("h").cast("long").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new FROM (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, n_regionkey + n_nationkey % 2 AS v FROM nation WHERE n_nationkey > 3) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def c32_config_diff(t: Tables) -> DataFrame:
    from tidemark.operators.joins import changed

    a = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    b = t.nation.where("n_nationkey > 3").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).alias("v"))
    return changed(a, b, "k", "v")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem WHERE l_discount >= 0.02 AND l_linenumber < 5 AND l_quantity BETWEEN 5 AND 40 GROUP BY 1")
def d1_d2_d3_masks(t: Tables) -> DataFrame:
    kept = t.lineitem.where((F.col("l_discount") >= 0.02) & (F.col("l_linenumber") < 5) & F.col("l_quantity").between(5, 40))
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q"))


@query("SELECT event_type, count(*) AS n FROM events WHERE coalesce(nullif(event_type, 'view'), 'ok') = 'ok' AND props IS NOT NULL GROUP BY 1")
def d4_d5_status(t: Tables) -> DataFrame:
    ok = F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("ok")) == "ok"
    return t.events.where(ok & F.col("props").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS visible FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events) WHERE value > 10 AND frame < greatest(ceil(0.5 / 0.02), 1) GROUP BY 1")
def d6_visible_frames(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.withColumn("frame", k).where((F.col("value") > 10) & (F.col("frame") < F.greatest(F.ceil(F.lit(0.5) / 0.02), F.lit(1))))
    return rows.groupBy("user_id").agg(F.count("*").alias("visible"))


@query(
    "SELECT user_id, sum(ok) AS n FROM (SELECT user_id, min(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events) GROUP BY 1"
)
def d7_until_first_zero(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = F.min((F.col("event_type") != "purchase").cast("int")).over(w)
    return t.events.withColumn("ok", ok).groupBy("user_id").agg(F.sum("ok").alias("n"))


@query("SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 45 THEN 'too_long' WHEN l_discount < 0.01 THEN 'missing_scores' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'missing_audio' END AS reason FROM lineitem) GROUP BY 1")
def d8_d12_o19_skip_reasons(t: Tables) -> DataFrame:
    reason = sets.skip_reason([("too_long", F.col("l_quantity") > 45), ("missing_scores", F.col("l_discount") < 0.01), ("missing_audio", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"))])
    return t.lineitem.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, round(sum(d * d * CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN m ELSE 0.5 END), 4) AS s FROM (SELECT l_linestatus, l_discount - l_tax AS d, l_linenumber % 3 AS k, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS m FROM lineitem) GROUP BY 1")
def d10_d11_dimension_masks(t: Tables) -> DataFrame:
    d, k = F.col("l_discount") - F.col("l_tax"), F.col("l_linenumber") % 3
    w = F.when(k == 0, 1.0).when(k == 1, (F.col("l_quantity") > 25).cast("double")).otherwise(0.5)
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.sum(d * d * w), 4).alias("s"))


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 25")
def d13_limit(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value").orderBy("event_id").limit(25)


@query("SELECT 'tax' AS rule, count(*) FILTER (NOT (l_tax BETWEEN 0 AND 1)) AS violations FROM lineitem UNION ALL SELECT 'qty', count(*) FILTER (NOT (l_quantity < 45)) FROM lineitem")
def d15_q8_constraints(t: Tables) -> DataFrame:
    return sets.constraint(t.lineitem, {"tax": F.col("l_tax").between(0, 1), "qty": F.col("l_quantity") < 45})
