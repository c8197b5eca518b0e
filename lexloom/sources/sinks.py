"""The delimited text formats as one string column `value`, in their order, and the writer.

The order is a global sort; `write` keeps it over the part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that belong to the kinds of files.
EXTENSIONS = {"anagrams": ".anahash", "hash_list": ".list", "foci": ".corpusfoci", "index": ".index", "pairs": ".ldcalc", "short": ".short.ldcalc", "ambiguous": ".ambi", "ranked": ".ranked", "chained": ".chained", "cleaned": ".cleaned", "deleted": ".deleted", "diacritics": ".lc.diac"}


def with_extension(path: str, kind: str) -> str:
    ext = EXTENSIONS[kind]
    return path if path.endswith(ext) else path + ext


def write(values: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    values.select("value").write.mode(mode).text(path)


def _join(separator: str, *cols: Column | str) -> Column:
    return F.concat_ws(separator, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]).alias("value")


def wordfreq(freqs: DataFrame) -> DataFrame:
    """word, freq [, cumsum, pct]: the most frequent first, equals by word."""
    more = [c for c in ("cumsum", "pct") if c in freqs.columns]
    return freqs.orderBy(F.desc("freq"), "word").select(_join("\t", "word", "freq", *more))


def wordfreq_clean(freqs: DataFrame) -> DataFrame:
    """As `wordfreq`; words of frequency 0 come last and alone."""
    return freqs.orderBy(F.desc("freq"), "word").select(F.when(F.col("freq") == 0, F.col("word")).otherwise(_join("\t", "word", "freq")).alias("value"))


def quarantine(words: DataFrame) -> DataFrame:
    return words.orderBy("word").select(F.col("word").alias("value"))


def alphabet(letters: DataFrame) -> DataFrame:
    """The collective symbols as comments, then the letters by value; the separator row has an empty field more."""
    special = F.col("ch").isin("*", "$")
    line = F.when(special, F.concat(F.lit("# "), F.col("ch"), F.lit("\t"), F.when(F.col("ch") == "*", "digits_and_punctuation").otherwise("unknown_characters"), F.lit("\t"), F.col("hash").cast("string")))
    line = line.when(F.col("freq") == 0, _join("\t", "ch", "freq", F.lit(""), "hash")).otherwise(_join("\t", "ch", "freq", "hash"))
    return letters.orderBy("hash").select(line.alias("value"))


def confusions(rows: DataFrame) -> DataFrame:
    last = F.array_join("examples", "#") if "examples" in rows.columns else F.col("example")
    return rows.orderBy("kwc").select(_join("#", "kwc", last))


def _cut(rows: DataFrame, key: str, value: str, per_line: int) -> DataFrame:
    """(key, _s, v): the distinct values of each key, sorted, on as many lines as it takes to hold about `per_line` each."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    cut = rows.join(counts, key).withColumn("_s", F.pmod(F.xxhash64(value), F.ceil(F.col("_n") / per_line)))
    return cut.groupBy(key, "_s").agg(F.array_sort(F.collect_set(value)).alias("v")).orderBy(key, "_s")


def anagrams(rows: DataFrame, per_line: int = 100_000) -> DataFrame:
    """hash~word#word by hash, the words sorted. A value of more than `per_line` words goes on over several lines, which
    readers take as one."""
    return _cut(rows, "hash", "word", per_line).select(_join("~", "hash", F.array_join("v", "#")))


def hash_list(rows: DataFrame) -> DataFrame:
    return rows.select(_join("\t", "word", "hash"))


def index(rows: DataFrame, per_line: int = 100_000) -> DataFrame:
    """kwc#hash,hash by kwc. The values of a frequent confusion go on over several lines of `per_line` each, which
    readers take as one."""
    return _cut(rows, "kwc", "hash", per_line).select(_join("#", "kwc", F.array_join(F.col("v").cast("array<string>"), ",")))


def confusion_stats(rows: DataFrame) -> DataFrame:
    return rows.orderBy("kwc").select(_join("#", "kwc", "n"))


def pairs(rows: DataFrame) -> DataFrame:
    from ..operators.pairs import COLUMNS

    return rows.orderBy("variant", "candidate").select(_join("~", *COLUMNS))


def ambiguous(rows: DataFrame) -> DataFrame:
    return rows.orderBy("pair").select(F.concat("pair", F.lit("#"), F.array_join("ngram_pairs", "#"), F.lit("#")).alias("value"))


def score_text(score: Column | str) -> Column:
    """A number with six significant digits, without trailing zeros: plain for exponents from -4 to 5, else with an
    exponent of two digits at least."""
    s = F.col(score) if isinstance(score, str) else score
    long = F.format_string("%.5e", s)
    power = F.regexp_extract(long, r"e([-+]\d+)$", 1).cast("int")
    fixed = F.lit(None).cast("string")
    for p in range(10):
        fixed = F.coalesce(fixed, F.when(5 - power == p, F.format_string(f"%.{p}f", s)))
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(s == 0, "0").when(power.between(-4, 5), fixed).otherwise(F.regexp_replace(long, r"\.?0+e", "e"))


def ranked(rows: DataFrame, clip: int = 0) -> DataFrame:
    """By variant and falling score; with a clip of 1 by the candidate's frequency, falling, for chaining."""
    order = [F.desc("candidate_freq"), F.desc("score"), F.asc("variant")] if clip == 1 else [F.asc("variant"), F.desc("score"), F.asc("candidate")]
    return rows.orderBy(*order).select(_join("#", "variant", "variant_freq", "candidate", "candidate_freq", "kwc", "ld", score_text("score")))


def ranked_debug(rows: DataFrame) -> DataFrame:
    """The ranked fields, each feature as value~rank, the sum of ranks and the score."""
    from ..operators.rank import FEATURES

    return rows.orderBy("variant", F.desc("score"), "candidate").select(_join("#", "variant", "variant_freq", "candidate", "candidate_freq", "kwc", "ld", score_text("score"), *[_join("~", c, f"{c}_rank") for c in FEATURES], "rank_sum", score_text("score")))


def confusion_frequencies(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("n"), "kwc").select(_join("\t", "kwc", "example", "n"))


def chained(rows: DataFrame) -> DataFrame:
    """By the head's frequency, falling, head and variant."""
    kwc = ["kwc"] if "kwc" in rows.columns else []
    return rows.orderBy(F.desc("head_freq"), "head", "variant").select(_join("#", "variant", "variant_freq", "head", "head_freq", *kwc, "ld", F.lit("C")))


def cleaned(rows: DataFrame, *, deleted: bool = False) -> DataFrame:
    """The kept or the deleted chain records in their input order."""
    kwc = ["kwc"] if "kwc" in rows.columns else []
    return rows.where(F.col("deleted") == deleted).orderBy("pos").select(_join("#", "variant", "variant_freq", "head", "head_freq", *kwc, "ld", F.lit("D" if deleted else "C")))


def classified(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The files of a classified lexicon by name."""
    out = {k: wordfreq(tables[k]) for k in ("clean", "fore", "unk") if k in tables}
    out["punct"] = tables["punct"].orderBy("word").select(_join("\t", "word", "form"))
    out["acro"] = tables["acro"].orderBy("word").select(_join("\t", "word", "freq"))
    return out
