"""Text and key functions as column expressions. Null in gives null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII punctuation without the apostrophe.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def normalize_phone(p: Column) -> Column:
    """Upper case, no brackets, cut at the first underscore or digit."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(p)), r"[\[\]]", ""), r"[_\d].*", "")


def strip_digits(p: Column) -> Column:
    return F.regexp_replace(F.upper(p), r"\d", "")


def normalize_word(w: Column) -> Column:
    """Upper case letters and apostrophes only."""
    return F.regexp_replace(F.upper(F.trim(w)), "[^A-Z']", "")


def tokenize(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), lambda w: normalize_word(w)), lambda w: w != "")


def normalize_for_wer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9' ]+", " "), " +", " "))


def strip_punctuation(text: Column) -> Column:
    """Without punctuation but apostrophes, then each pair of blanks made one, in one pass."""
    return F.replace(F.translate(text, PUNCTUATION, ""), F.lit("  "), F.lit(" "))


def digits_to_words(text: Column) -> Column:
    """Each digit spelled, blanks between."""
    names = F.array(*[F.lit(w) for w in DIGIT_WORDS])
    spelled = F.transform(F.split(text, ""), lambda c: F.when(F.rlike(c, F.lit("^[0-9]$")), F.concat(F.lit(" "), F.get(names, c.try_cast("int")), F.lit(" "))).otherwise(c))
    return F.trim(F.regexp_replace(F.array_join(spelled, ""), " +", " "))


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII only; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normalize_transcript(text: Column) -> Column:
    """Punctuation out, lower case, digits spelled, ASCII, single blanks."""
    return F.trim(F.regexp_replace(ascii_fold(digits_to_words(F.lower(strip_punctuation(text)))), r"\s+", " "))


def upper_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), " +"), lambda w: F.upper(w)), lambda w: w != "")


def position_tags(phones: Column) -> Column:
    """``_S`` for a single phone; ``_B``, ``_I`` and ``_E`` by place else."""
    n = F.size(phones)
    tag = lambda i: F.when(n == 1, "_S").when(i == 0, "_B").when(i == n - 1, "_E").otherwise("_I")
    return F.transform(phones, lambda p, i: F.concat(p, tag(i)))


def join_words(words: Column) -> Column:
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def split_key(key: Column) -> tuple[Column, Column]:
    """``utt.index`` at the last dot."""
    at = F.length(key) - F.length(F.substring_index(key, ".", -1))
    return F.substring(key, F.lit(1), at - 1), F.substring_index(key, ".", -1).try_cast("int")


def split_key_first(key: Column) -> tuple[Column, Column]:
    """``utt.index`` at the first dot; the two variants differ when ids have dots."""
    return F.substring_index(key, ".", 1), F.get(F.split(key, r"\."), F.lit(1)).try_cast("int")


def source_id(eval_id: Column) -> Column:
    return F.regexp_replace(eval_id, r"_c\d+$", "")


def eval_id(utt: Column, chunk: Column) -> Column:
    return F.format_string("%s_c%04d", utt, chunk)


def speaker(path: Column, utt: Column) -> Column:
    """From the parent folder, else a tag in the path, else the id's prefix, else UNKNOWN."""
    parent = F.upper(F.try_element_at(F.split(path, "/"), F.lit(-2)))
    tag = F.regexp_extract(path, r"(SPEAKER\d+)", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.nullif(parent, F.lit("")), F.nullif(F.substring(utt, 1, 5), F.lit("")), F.lit("UNKNOWN"))


def key_hash(parts: Sequence[Column]) -> Column:
    return F.sha1(F.concat_ws("\n", *parts))


def json_hash(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


def first_present(*candidates: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def edit_distance(a: Column, b: Column) -> Column:
    """Between word arrays: rows of the usual table, folded over ``a``."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.get(prev, F.lit(0)) + 1)
        step = lambda acc, j: F.concat(
            acc,
            F.array(F.least(F.get(prev, j) + 1, F.get(acc, j - 1) + 1, F.get(prev, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))),
        )
        return F.when(F.size(b) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), start, step))

    return F.get(F.aggregate(a, first, row), F.size(b))


def overridden(base: Column, own: Column) -> Column:
    """The entries of two maps; where both have a key, that of ``own``, even if it is null."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(own, e["key"])), F.map_entries(own)))
