"""The vocabularies, alphabets and records that the queries read from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alphabet as A
from ..session import table

#: Artificial frequency of lexical words in the tables.
ARTIFRQ = 100_000_000


def word_list(spark: SparkSession, d: str) -> DataFrame:
    """(word, freq): the words of all lists with their total frequency."""
    w = table(spark, d, "read_words").where("wrd is not null")
    return w.groupBy(F.col("wrd").alias("word")).agg(F.coalesce(F.sum("frq"), F.lit(0)).alias("freq"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(word, freq): variants and candidates with their largest frequency."""
    r = table(spark, d, "rank_record")
    both = r.select(F.col("variant").alias("word"), F.col("variant_freq").alias("freq")).unionByName(r.select(F.col("candidate").alias("word"), F.col("candidate_freq").alias("freq")))
    return both.where("word is not null").groupBy("word").agg(F.max(F.coalesce("freq", F.lit(0))).alias("freq"))


def alphabet_rows(spark: SparkSession, d: str) -> list:
    """The alphabet: tens of rows."""
    return table(spark, d, "alphabet").collect()


def letters(spark: SparkSession, d: str) -> dict[str, int]:
    return X.alphabet_values(alphabet_rows(spark, d))


def symbols(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return A.symbols(alphabet_rows(spark, d))


def records(spark: SparkSession, d: str) -> DataFrame:
    """The pairs as ranking reads them, each once (the one of the lowest id)."""
    r = table(spark, d, "rank_record").where("variant is not null and candidate is not null")
    keep = ["variant_freq", "low_variant_freq", "candidate_freq", "low_candidate_freq", "char_conf_val", "ld", "cls", "canon", "fl", "ll", "khc", "ngram_points", "cosine"]
    one = r.groupBy("variant", "candidate").agg(F.min_by(F.struct(*keep), "rec_id").alias("r"))
    return one.select("variant", "candidate", "r.*").withColumnRenamed("char_conf_val", "kwc").na.fill(0.0, ["cosine"])
