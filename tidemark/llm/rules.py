"""Quality rules as a short-circuit cascade.

A sample gives each rule's cost, with all that it has to measure, and the share it rejects. Rules are evaluated by
rejections per cost, and a document that one rule rejects is not shown to the rules behind it, nor measured for them. The
verdict doesn't depend on the order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, shifted, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects``: a condition on the columns ``text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""

    name: str
    rejects: str


#: The first two are the base rules. Each is a SQL condition; null counts as not rejected.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * (length(text) - length(replace(text, '\n', '')) + 1)"),
    Rule("ellipsis_lines", "10 * regexp_count(text, '(\\\\.\\\\.\\\\.|…)(\\n|$)') > 3 * (length(text) - length(replace(text, '\n', '')) + 1)"),
    Rule("no_letters", "2 * regexp_count(text, '[\\\\p{L}]+') < n_words"),
)
BASE_RULES = 2
#: Bytes of a text in the sample that orders the rules, at most; longer texts have no say in the order.
SAMPLE_TEXT = 64 << 10


def repeated_words(words_col: str) -> Column:
    """How many words lie in 3-word windows that occur twice or more. Windows are told apart by 64-bit hashes."""
    w = F.col(words_col)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    pairs = F.zip_with(hashes, shifted(hashes, 1), lambda a, b: F.xxhash64(a, b))
    n = F.size(w) - 2
    return F.slice(F.zip_with(pairs, shifted(hashes, 2), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(n, F.lit(0)))


#: What rules can be written on, beside ``text``.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def needs(rule: Rule) -> list[str]:
    return [m for m in MEASURES if re.search(rf"\b{m}\b", rule.rejects)]


def _measure(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with the measures of its column ``text`` that are named."""
    if not names:
        return df
    base, out = df, {}
    if "n_words" in names:
        out["n_words"] = F.regexp_count("text", F.lit(f"[^{BLANK}]+"))
    if "word_chars" in names:
        out["word_chars"] = F.char_length(F.regexp_replace("text", f"[{BLANK}]+", ""))
    if "n_symbols" in names:
        out["n_symbols"] = F.regexp_count("text", F.lit(SYMBOLS))
    if "n_dup_lines" in names:
        base = base.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(f"[^{BLANK}]"))))
        out["n_dup_lines"] = F.size("_lines") - F.size(F.array_distinct("_lines"))
    if "n_repeat_words" in names:
        base = base.withColumn("_words", words(F.col("text")))
        if "n_words" in out:
            out["n_words"] = F.size("_words")
        base = base.withColumn("_grams", repeated_words("_words"))
        base = base.withColumn("_sorted", F.sort_array("_grams"))
        same = F.zip_with("_sorted", shifted(F.col("_sorted"), 1), lambda a, b: F.when(a == b, a))
        base = base.withColumn("_twice", F.array_distinct(F.filter(same, lambda x: x.isNotNull())))
        # Positions of repeated windows, in order. Few repeated values are looked up; else a sort by value and place finds them.
        few = F.filter(F.sequence(F.lit(0), F.size("_grams") - 1), lambda i: F.array_contains("_twice", F.get("_grams", i)))
        placed = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        base = base.withColumn("_placed", F.when(F.size("_twice") > 32, placed))
        marked = F.transform("_placed", lambda x, k: F.when((F.get("_placed", k - 1)["g"] == x["g"]) | (F.get("_placed", k + 1)["g"] == x["g"]), x["i"]))
        many = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
        base = base.withColumn("_starts", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 32, few).otherwise(many))
        gaps = F.zip_with("_starts", shifted(F.col("_starts"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        out["n_repeat_words"] = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    found = F.struct(*[out[m].cast("long").alias(m) for m in MEASURES if m in names])
    # Filters on a verdict aren't pushed through a generator; else they would repeat these expressions many times over,
    # and measures would be taken of texts that an earlier filter drops.
    return base.select(*df.columns, F.explode(F.array(found)).alias("_m")).select(*df.columns, "_m.*")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text`` (null: empty), the ``extra`` columns, and the base measures of each whole text. One row per input row."""
    return _measure(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra), MEASURES)


def _rejected(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects), F.lit(False))


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample: int = 1024, copies: int = 4) -> list[Rule]:
    """``rules`` by rejections per cost on a sample.

    The sample is ``sample`` rows of ``SAMPLE_TEXT`` bytes at most, picked by a hash of the id; each rule alone runs over ``copies`` of it, from the
    text, and the time of a job without a rule is taken off. It decides only the order of evaluation. Ties, also those of an
    empty sample, stay in the given order.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = texts.where((F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0) & (F.octet_length("text") <= SAMPLE_TEXT)).limit(sample)
    held = docs.sparkSession.createDataFrame(few.select("text").toArrow())
    held = held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")

    def run(df: DataFrame, hit: Column) -> tuple[float, float]:
        began = time.perf_counter()
        found, n = df.agg(F.count_if(hit), F.count("*")).first()
        return found / max(n, 1), time.perf_counter() - began

    idle = min(run(held, F.length("text") < 0)[1] for _ in range(2))
    gain = {}
    for rule in rules:
        share, took = run(_measure(held, needs(rule)), _rejected(rule))
        gain[rule.name] = share / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -gain[r.name])


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", order: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; what a rule needs is measured when its turn comes, of the rows left then.

    ``order`` is found on a sample unless it is given. Nulls, repeated rows, other columns and empty tables are as in ``quality``.
    """
    out, have = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), set()
    for rule in order if order is not None else ordered(docs, rules, id_col, text_col):
        out = _measure(out, [m for m in needs(rule) if m not in have]).where(~_rejected(rule))
        have |= set(needs(rule))
    return out.select("row.*")


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, in the order given; null for documents to keep. Later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_rejected(rule), F.lit(rule.name)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """The measures, ``base_failed, kept`` and the rule that rejected.

    A null or empty text has no words and fails. Repeated rows and ties stay rows of their own; null ids are kept; other
    columns are ignored unless named in ``extra``; an empty table gives no rows. Texts of any length are read whole.
    """
    m = measured(docs, id_col, text_col, extra)  # asked for of every row; the other rules' expressions are evaluated in turn
    base_failed = F.expr(" OR ".join(f"({r.rejects})" for r in RULES[:BASE_RULES]))
    out = m.withColumn("rejected_by", cascade(ordered(docs, rules, id_col, text_col)))
    return out.select("doc_id", "text", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
