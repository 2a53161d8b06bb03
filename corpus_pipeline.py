"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage works on all rows that the one before kept and, but for the last, returns the columns of documents; other
columns are ignored. An empty table gives an empty table in each. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linejoin, packing, rules, simhash, winnow
from tidemark.llm.common import new_path, table

#: The columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else ``docs`` has."""
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null, empty and short texts go; repeated rows are judged alike; nulls in other columns stay."""
    return rules.passing(_kept_text(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; a document left without a word goes. ``n_chars`` is counted anew.

    Earlier: by document id, null ids last, then by a hash of the text, then by place; rows equal in id and text lose the
    same lines. Null texts have no word.
    """
    out = linejoin.dedup_lines(docs, extra=("lang", "source"))
    out = out.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return _kept_text(out.withColumn("n_chars", F.char_length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null last; of equal ids that of the smallest hash of
    the text, and of repeated rows any one. Texts without a word, null ones included, are one group."""
    return simhash.one_of_each(_kept_text(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate. Null and empty texts stay; repeated rows are judged alike."""
    return winnow.clean(_kept_text(docs), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces, with their token ids. A null or empty text is one end token; repeated rows and null ids are documents of their own."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Fingerprints, components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
