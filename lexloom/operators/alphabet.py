"""Alphabets with anagram values, and the confusions between strings of their symbols."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Values are fifth powers of ranks; with a word of 35 characters their sums stay within 64 bits up to this rank.
MOST_SYMBOLS = 3000


def char_count(lines: DataFrame, line: str) -> DataFrame:
    """(ch, freq) of the lower-case characters of whole lines, blanks included."""
    rows = lines.select(F.explode(X.chars(F.lower(F.col(f"`{line}`")))).alias("ch"))
    return rows.groupBy("ch").agg(F.count(F.lit(1)).alias("freq"))


def alphabet_build(counts: DataFrame, *, clip: int = -1, separator: str | None = None) -> DataFrame:
    """(ch, freq, hash): the collective symbols `*` and `$`, the separator if given, then the characters of a frequency
    of at least `clip`, the most frequent first (of equals the higher code point), with values from 102 (103 with a
    separator) to the fifth power. White space, the separator and the collective symbols are no letters."""
    first = 103 if separator else 102
    special = [("*", 0, X.FOREIGN_PUNCT), ("$", 0, X.FOREIGN_CHAR)] + ([(separator, 0, X.SEPARATOR_VALUE)] if separator else [])
    kept = counts.where((F.col("freq") >= clip) & ~F.col("ch").rlike(rf"^[{X.SPACE}]$") & ~F.col("ch").isin(*[s[0] for s in special]))
    if kept.count() > MOST_SYMBOLS:
        raise ValueError("alphabet too large for 64-bit values")
    # The ordered window holds MOST_SYMBOLS rows at most.
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.desc("ch"))) + (first - 1)
    letters = kept.select("ch", "freq", X.fifth_power(rank).alias("hash"))
    spark = counts.sparkSession
    return spark.createDataFrame(special, "ch string, freq bigint, hash bigint").unionByName(letters)


def symbols(spark_rows: list) -> list[tuple[str, int]]:
    """(symbol, value) of collected alphabet rows, the collective symbols included, in the order of the values."""
    return sorted(((r.ch, r.hash) for r in spark_rows), key=lambda x: x[1])


def multisets(values: list[tuple[str, int]], most: int) -> list[tuple[int, str, int]]:
    """(size, text, sum) of every multiset of up to `most` symbols, the empty one included."""
    out = [(0, "", 0)]
    for k in range(1, most + 1):
        out += [(k, "".join(s for s, _ in c), sum(v for _, v in c)) for c in combinations_with_replacement(values, k)]
    return out


def confusions(spark: SparkSession, values: list[tuple[str, int]], distance: int = 2, *, all_examples: bool = False) -> DataFrame:
    """(kwc, example[s]): every positive difference of the values of two disjoint strings of up to `distance` symbols.

    The strings are multisets, so there are C(n + d, d) squared pairs of them rather than n to the power of 2d. The
    example is `longer~shorter` of the pair that comes first by length, then text; `all_examples` gives them all."""
    if len(values) > MOST_SYMBOLS:
        raise ValueError("alphabet too large for 64-bit values")
    if distance == 0:
        return spark.createDataFrame([], "kwc bigint, example string")
    strings = multisets(values, distance)
    # Both sides are bounded by the alphabet, not by data: one is a table, the other a constant of the plan.
    a = spark.createDataFrame(strings, "na int, a string, va bigint").repartition(max(1, min(64, len(values))))
    other = X.literal([{"nb": n, "b": s, "vb": v} for n, s, v in strings], "array<struct<nb:int,b:string,vb:bigint>>")
    pairs = a.select("*", F.inline(other)).where("va > vb")
    pairs = pairs.where(~F.arrays_overlap(X.chars("a"), X.chars("b")))
    example = F.concat("a", F.lit("~"), "b")
    rows = pairs.select((F.col("va") - F.col("vb")).alias("kwc"), example.alias("example"), F.struct((F.col("na") + F.col("nb")).alias("n"), example.alias("e")).alias("o"))
    if all_examples:
        return rows.groupBy("kwc").agg(F.array_sort(F.collect_set("example")).alias("examples"))
    return rows.groupBy("kwc").agg(F.min("o").alias("o")).select("kwc", F.col("o.e").alias("example"))


def diacritic_confusions(alphabet: DataFrame) -> DataFrame:
    """(kwc, example): each accented letter against its plain letter, where both are in the alphabet."""
    pairs = plain_letters(alphabet.select("ch", "hash"))
    other = alphabet.select(F.col("ch").alias("plain"), F.col("hash").alias("h2"))
    return pairs.join(F.broadcast(other), "plain").where("ch <> plain").select(F.abs(F.col("hash") - F.col("h2")).alias("kwc"), F.concat("ch", F.lit("~"), "plain").alias("example"))


def plain_letters(rows: DataFrame, column: str = "ch") -> DataFrame:
    """`rows` with `plain`, the column without accents."""
    return rows.withColumn("plain", strip_accents(F.col(column)))


def _accents() -> tuple[str, str]:
    """Every accented letter of the Basic Multilingual Plane and its plain letter, by canonical decomposition."""
    import unicodedata

    pairs = [(chr(i), d) for i in range(0xC0, 0x3000) if (d := "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")) and d != chr(i) and len(d) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c):
    """Without accents, whether composed with their letter or following it."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), *_accents())
