"""Frequency tables: n-grams of a corpus, sorted lists with running totals, merging and cleaning of lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch


def corpus_tokens(docs: DataFrame, text: str, *, per_line: bool = False, lower: bool = False) -> DataFrame:
    """One row of `tokens` (array) for each document, or for each line of it."""
    t = F.lower(F.col(f"`{text}`")) if lower else F.col(f"`{text}`")
    lines = F.explode(F.split(t, "\n")).alias("t") if per_line else t.alias("t")
    return docs.select(lines).where(F.col("t").isNotNull()).select(X.tokens("t").alias("tokens"))


def word_count(docs: DataFrame, text: str, n: int = 1, *, per_line: bool = False, lower: bool = False, separator: str = X.SEPARATOR) -> DataFrame:
    """(word, freq) of the n-grams of all documents. N-grams don't cross documents, nor lines with `per_line`. Null
    texts give none. Counting is partially aggregated, so a frequent word is no hot key."""
    rows = corpus_tokens(docs, text, per_line=per_line, lower=lower)
    return rows.select(F.explode(X.ngrams(F.col("tokens"), n, separator)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def is_emphasis(token: Column) -> Column:
    return token.rlike(r"^[\p{L}\p{Nd}]$")


def emphasis_runs(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, run): words written with spaces between the letters: maximal runs of two or more single letters or digits,
    joined with the separator. A run at the end of a text counts, too."""
    toks = docs.select(F.col(f"`{doc_id}`").alias(doc_id), X.tokens(f"`{text}`").alias("tokens"))
    # Single characters stay, anything else becomes a break; runs are what lies between breaks. All inside one row.
    marked = F.array_join(F.transform("tokens", lambda t: F.when(is_emphasis(t), t).otherwise(F.lit("\n"))), "_")
    runs = F.filter(F.transform(F.split(marked, "\n"), lambda x: F.regexp_replace(x, "^_+|_+$", "")), lambda x: x.contains("_"))
    return toks.select(doc_id, F.explode(runs).alias("run"))


def clip(freqs: DataFrame, at_most: int, freq: str = "freq") -> DataFrame:
    """Without the words of at most this frequency."""
    return freqs.where(F.col(freq) > at_most)


def with_running_totals(freqs: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """`freqs` with `cumsum` (in the order frequency descending, word ascending) and `pct` of the total.

    The order is total, so it is found by a range partition: every part sums for itself and is moved by the sum of the
    parts before it, of which there are few."""
    spark = freqs.sparkSession
    order = [F.desc(freq), F.asc(word)]
    parts = Scratch(spark, "totals").save(freqs.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(freq).alias("_s"))
    w = Window.orderBy("_p")  # one row for each part
    before = F.broadcast(sums.select(F.col("_p").alias("_q"), (F.sum("_s").over(w) - F.col("_s")).alias("_b"), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_t")))
    local = F.sum(freq).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("_l", local).join(before, F.col("_p") == F.col("_q"))
    total = F.col("_l") + F.col("_b")
    return rows.select(*[F.col(f"`{c}`") for c in freqs.columns], total.alias("cumsum"), (100 * total / F.col("_t")).alias("pct"))


def summary(freqs: DataFrame, freq: str = "freq") -> DataFrame:
    """tokens, types, type-token ratio and its angle in degrees."""
    s = freqs.agg(F.coalesce(F.sum(freq), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"))
    ratio = F.when(F.col("tokens") > 0, F.col("types") / F.col("tokens"))
    return s.select("tokens", "types", ratio.alias("ttr"), X.ratio_angle(ratio).alias("angle"))


def merge_lexicons(*lexicons: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """Sum of the frequencies of each word over all lexicons; further columns are left out."""
    rows = [x.select(F.col(word).alias("word"), F.col(freq).cast("bigint").alias("freq")) for x in lexicons]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out.where(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


def last_wins(rows: DataFrame, word: str, freq: str, order: str) -> DataFrame:
    """(word, freq): of repeated words the row that comes last in `order`."""
    return rows.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.max_by(freq, order).alias("freq"))


def within_alphabet(word: Column, letters: str, *, reverse: bool = False, tagged: bool = False) -> Column:
    """Whether all characters of a word are in the alphabet (`reverse`: none is). `tagged`: only the first of its
    space-separated tokens is tested."""
    w = F.split(word, " ")[0] if tagged else word
    rest = X.remove(w, letters)
    return F.length(rest) == F.length(w) if reverse else F.length(rest) == 0


def lexclean(lexicon: DataFrame, letters: str, *, word: str = "word", reverse: bool = False, tagged: bool = False) -> tuple[DataFrame, DataFrame]:
    """The clean and the other rows of a lexicon. Null words are in neither."""
    ok = within_alphabet(F.col(word), letters, reverse=reverse, tagged=tagged)
    return lexicon.where(ok), lexicon.where(~ok)


def length_band(rows: DataFrame, word: str, low: int = 5, high: int = 35) -> DataFrame:
    """Words of `low` to `high` characters; a bound of 0 is none."""
    n = F.length(word)
    return rows.where((n >= low) if low else F.lit(True)).where((n <= high) if high else F.lit(True))
