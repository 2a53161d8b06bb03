"""Hypotheses, tokens, slots and composite reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import sequence as Q
from tidemark.sources.writers import union_all

from .join_queries import _IV, _intervals
from .metric_queries import _corr
from .registry import Tables, query

_TOK = "(SELECT item_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: upper(x)), lambda x: x <> '')) AS word FROM benchmark)"


@query(
    f"WITH w AS (SELECT * FROM {_TOK}), lex AS (SELECT word, len(word) % 4 + 1 AS n FROM w GROUP BY 1, 2 HAVING count(*) > 1) SELECT item_id, CAST(sum(coalesce(n, greatest(ceil(len(regexp_replace(word, '[^A-Z]', '', 'g')) / 3.0), 1))) AS BIGINT) AS phones, count(n) AS known FROM w LEFT JOIN lex USING (word) GROUP BY 1"
)
def j10_hypothesis_phones(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", F.explode(X.tokenize(F.col("text"))).alias("word"))
    lex = w.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word", F.array_repeat(F.lit("X"), F.length("word") % 4 + 1).alias("phones"))
    out = Q.phones_of_words(w, lex, "word")
    return out.groupBy("item_id").agg(F.sum(F.size("phones")).alias("phones"), F.count_if(F.col("source") == "lexicon").alias("known"))


@query(
    "WITH c AS (SELECT item_id, i, text[i] AS ch, -((i - 1) // 3 % 7) / 10.0::DOUBLE AS lp FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)), g AS (SELECT *, regexp_matches(ch, '[\\p{L}'']') AS l, sum(CASE WHEN regexp_matches(ch, '[\\p{L}'']') THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY i) AS word_no FROM c) SELECT item_id, word_no, string_agg(ch, '' ORDER BY i) AS word, min((i - 1) // 3) AS first, max((i - 1) // 3) AS last, round(avg(lp), 6) AS logprob, round(least(exp(avg(lp)), 1), 6) AS confidence FROM g WHERE l GROUP BY 1, 2"
)
def j11_token_words(t: Tables) -> DataFrame:
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3).cast("int")), lambda i: F.substring(F.col("text"), i * 3 + 1, F.lit(3)))
    toks = t.benchmark.select("item_id", F.posexplode(pieces).alias("pos", "piece")).withColumn("lp", -(F.col("pos") % 7) / F.lit(10.0))
    out = Q.words_of_tokens(toks, "item_id", "pos", "piece", "lp")
    return out.select("item_id", "word_no", "word", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round("logprob", 6).alias("logprob"), F.round("confidence", 6).alias("confidence"))


@query(_IV + " SELECT a.event_id, count(b.event_id) AS frames, round(avg(b.value), 6) AS mean, round(stddev_pop(b.value), 6) AS std FROM iv a JOIN iv b ON a.user_id = b.user_id AND b.s >= a.s AND b.s < a.e WHERE a.event_type = 'click' GROUP BY 1")
def j13_slot_frames(t: Tables) -> DataFrame:
    iv = _intervals(t)
    slots = iv.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("ls"), F.col("e").alias("le"))
    met = J.frames_in_slots(iv.select("user_id", F.col("s").alias("time"), "value"), slots, "user_id", "time", 4.0)
    return met.groupBy("event_id").agg(F.count("*").alias("frames"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query()
def g17_d9_loop_kind(t: Tables) -> DataFrame:
    """Whole documents as token arrays; counted by language and reason."""
    kind = Q.loop_kind(F.split(F.lower("text"), r"[\s.]+"), repeats=4)
    return t.documents.groupBy("lang", F.coalesce(kind, F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query()
def e27_pad_to_reference(t: Tables) -> DataFrame:
    from .sequence_queries import replies

    pairs = replies(t).select("reply", X.tokenize(F.col("before")).alias("a"), X.tokenize(F.col("text")).alias("b"))
    out = Q.pad_to_reference(F.col("a"), F.col("b"), F.transform("b", lambda w: F.length(w).cast("double")))
    return pairs.select("reply", out.alias("scores"))


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 100")
def h5_seeded_sample(t: Tables) -> DataFrame:
    return J.seeded_sample(t.events, "event_id", 100, 3).select("event_id", F.round("value", 6).alias("value"))


@query(
    "SELECT 'utt' AS level, count(*) AS n, round("
    + _corr("p", "q")
    + ", 6) AS pcc, NULL::DOUBLE AS ece FROM (SELECT o_orderkey, max(o_totalprice) / 1000 AS p, sum(l_extendedprice) / 1000 AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) UNION ALL SELECT 'phone', count(*), round("
    + _corr("l_quantity", "l_extendedprice")
    + ", 6), NULL FROM lineitem UNION ALL SELECT 'confidence', count(*), NULL, round(avg(l_discount * 10), 6) FROM lineitem"
)
def f11_f12_o16_report(t: Tables) -> DataFrame:
    utt = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg((F.max("o_totalprice") / 1000).alias("p"), (F.sum("l_extendedprice") / 1000).alias("q"))
    a = utt.agg(F.lit("utt").alias("level"), F.count("*").alias("n"), F.round(M.safe_corr("p", "q"), 6).alias("pcc"))
    b = t.lineitem.agg(F.lit("phone").alias("level"), F.count("*").alias("n"), F.round(M.safe_corr("l_quantity", "l_extendedprice"), 6).alias("pcc"))
    c = t.lineitem.agg(F.lit("confidence").alias("level"), F.count("*").alias("n"), F.round(F.avg(F.col("l_discount") * 10), 6).alias("ece"))
    return union_all([a, b, c])
