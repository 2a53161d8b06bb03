"""Benchmark decontamination by winnowing.

Of each run of ``window`` words, the smallest hash of its k-grams is kept as a fingerprint. Two texts that share a run share
its fingerprint, so a join of the fingerprints of documents and items misses no shared run. Hits are extended to whole
windows and compared as text, so nothing else is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, shifted, words, written

#: Between words: all of ASCII but digits and letters (upper case letters are lowered before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 4
#: Fingerprints and windows of the items are broadcast up to so many rows and bytes of text; beyond, the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def _spanned(values: Column, have: int, want: int, join) -> Column:
    """From values over runs of ``have`` items to values over runs of ``want``, in steps that at most double the run."""
    while have < want:
        by = min(have, want - have)
        values = let(values, lambda v, by=by: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - by, F.lit(0))), shifted(v, by), join))
        have += by
    return values


def minima(word_array: Column, window: int, gram: int = GRAM) -> Column:
    """At index i: the least hash of the k-grams in words i to i + window - 1."""
    k = min(gram, window)
    hashes = _spanned(F.transform(word_array, lambda w: F.xxhash64(w)), 1, k, lambda a, b: F.xxhash64(a, b))
    return _spanned(hashes, 1, window - k + 1, lambda a, b: F.least(a, b))


def _kept(df: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.rows <= BROADCAST_ROWS and found.bytes <= BROADCAST_BYTES else df


def _fingerprints(word_col: str, lengths: list[int]) -> Column:
    """All fingerprints of the windows of the given lengths, each once."""
    of = [F.when(F.size(word_col) >= n, minima(F.col(word_col), n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    return F.array_distinct(F.concat(*of)) if of else F.array().cast("array<bigint>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids`` (sorted as strings), ``text_md5``.

    Null and empty texts have no words; items without words are no windows; an item shorter than ``window`` words is one
    window. Repeated rows of documents are judged each; items of the same text or id count as their distinct ids; null
    item ids are left out of ``item_ids``. Other columns are ignored; empty tables give no rows or no hits. Texts are read whole.
    """
    item_rows = items.select(F.col(item_col).cast("string").alias("item_id"), item_words(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0)
    size = F.least(F.size("iw"), F.lit(window))
    spans = F.transform(F.sequence(F.lit(0), F.size("iw") - size), lambda i: F.struct(size.alias("span"), F.array_join(F.slice("iw", i + 1, size), " ").alias("gram")))
    windows = written(item_rows.select("item_id", F.explode(F.array_distinct(spans)).alias("x")).select("item_id", "x.span", "x.gram").distinct(), "windows")
    lengths = sorted(r.span for r in windows.select("span").distinct().collect())  # at most `window` values
    marks = written(windows.select(F.split("gram", " ").alias("gw"), "span").select(F.explode(_marks_of("gw", lengths)).alias("mark")).distinct(), "marks")
    marks = _kept(marks)

    # Which texts share a fingerprint. Words are lowered in full, each by itself as those of the items are: a sigma's form depends on what follows.
    rough = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("key"), F.transform(item_words(F.col(text_col)), lambda w: F.lower(w)).alias("dw"))
    rough = rough.select("doc_id", "key", F.size("dw").cast("long").alias("n_words"), F.posexplode_outer(_fingerprints("dw", lengths)).alias("i", "mark"))
    flagged = rough.join(marks.withColumn("shared", F.lit(1)), "mark", "left").groupBy("doc_id", "key", "n_words")
    flagged = written(flagged.agg(F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("copies"), F.max("shared").alias("shared")), "flagged")

    # The texts that do, each once: their windows around the shared fingerprints, compared as text.
    wanted = flagged.where("shared = 1").select("key").distinct()
    texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    exact = texts.select("key", item_words(F.col("text")).alias("dw"))
    starts = None
    for n in lengths:
        at = exact.where(F.size("dw") >= n).select("key", "dw", F.posexplode(minima(F.transform("dw", lambda w: F.lower(w)), n)).alias("at", "mark"))
        at = at.join(marks, "mark", "left_semi").select("key", "at", F.lit(n).alias("span"), F.array_join(F.slice("dw", F.col("at") + 1, n), " ").alias("gram"))
        starts = at if starts is None else starts.unionByName(at)
    if starts is None:
        starts = exact.select("key", F.lit(0).alias("at"), F.lit(0).alias("span"), F.lit("").alias("gram")).where("false")
    grams = windows.select("span", "gram").distinct()
    hits = written(starts.join(_kept(grams), ["span", "gram"], "left_semi"), "hits")

    by_start = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.groupBy("key", "at").agg(F.max(F.col("at") + F.col("span")).alias("end"))
    covered = ends.withColumn("before", F.coalesce(F.max("end").over(by_start), F.lit(0))).groupBy("key").agg(F.sum(F.greatest(F.col("end") - F.greatest("at", "before"), F.lit(0))).alias("n_hit"))
    per_key = hits.select("key", "span", "gram").distinct().join(_kept(windows), ["span", "gram"]).select("key", "item_id").distinct()
    ids = per_key.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    found = covered.join(ids, "key")
    out = flagged.join(found, "key", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "item_ids",
        F.col("key").alias("text_md5"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts aren't contaminated."""
    bad = decontaminate(docs, items, text_col=text_col, **names).where("contaminated").select(F.col("text_md5").alias("_md5")).distinct()
    own = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    return docs.join(bad, own == bad["_md5"], "left_anti")


def _marks_of(word_col: str, lengths: list[int]) -> Column:
    """The fingerprint of a window, as documents get it: words are lowered in full."""
    out = F.array().cast("array<bigint>")
    for n in lengths:
        out = F.when(F.size(word_col) == n, minima(F.transform(word_col, lambda w: F.lower(w)), n)).otherwise(out)
    return out
