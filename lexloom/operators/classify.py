"""Classification of a vocabulary into clean words, words with punctuation around them, acronyms and unrecoverable ones.

Everything is expressions and two aggregations: the parts of a word are classified by character counts, folded into the
class of the word, and each word becomes the rows it adds to the tables (`tag`). A background lexicon is joined by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch
from .lookup import lookup

CLEAN, UNK, PUNCT, IGNORE = "CLEAN", "UNK", "PUNCT", "IGNORE"


def both_cases(letters: str) -> str:
    """The letters in lower and upper case, as an alphabet for `classify_word`."""
    return "".join(sorted({c for ch in letters for c in (ch, ch.lower(), ch.upper()) if len(c) == 1}))


def _rest(word: Column, letters: str) -> Column:
    """The word without its letters: those of the alphabet, or by category where there is none."""
    return X.remove(word, letters) if letters else F.regexp_replace(word, rf"[{X.LETTER}]", "")


def _class(word: Column, rest: Column, blanks: Column, digit: Column, punct: Column) -> Column:
    n = F.length(word)
    letter = n - F.length(rest)
    out = F.length(rest) - blanks - digit - punct
    known = (letter + digit) / n
    clean = ((n >= 4) & (known >= 0.75)) | ((n == 3) & (known >= 0.66)) | ((n < 3) & (out + digit < 1))
    clean = clean | ((n >= 8) & (letter + punct > n - 2)) | ((n >= 4) & (letter + punct > n - 1))
    return F.when((n < 2) | X.is_roman(word) | (digit == n) | (digit >= letter + out), IGNORE).when(clean, CLEAN).otherwise(UNK)


def with_word_class(rows: DataFrame, word: str, out: str, letters: str = "") -> DataFrame:
    """`rows` with CLEAN, UNK or IGNORE for a word, by its numbers of letters, digits, dots (punctuation without an
    alphabet) and other characters. `letters` is the alphabet in both cases. Blanks only count for the length. Counted in
    steps, so that no count is computed twice."""
    rest = F.col("_rest")
    rows = rows.withColumn("_rest", _rest(F.col(word), letters))
    rows = rows.withColumns({"_blanks": F.regexp_count(rest, F.lit(rf"[{X.SPACE}]")), "_digit": F.regexp_count(rest, F.lit(X.DIGIT)), "_punct": F.regexp_count(rest, F.lit(r"\." if letters else X.PUNCT))})
    return rows.withColumn(out, _class(F.col(word), rest, F.col("_blanks"), F.col("_digit"), F.col("_punct"))).drop("_rest", "_blanks", "_digit", "_punct")


def with_part_class(rows: DataFrame, part: str, letters: str = "") -> DataFrame:
    """`rows` with `cls` and `form`: a part that is clean once its edges are stripped is PUNCT, `form` being the stripped
    part; `form` is empty for other classes."""
    rows = rows.withColumn("_bare", X.strip_edges(part)).withColumn("_edged", X.has_edges(part))
    # Without edges the stripped part is the part itself, so one classification serves both cases.
    rows = with_word_class(rows, "_bare", "_inner", letters)
    stripped = F.when(F.col("_bare") == "", F.when(F.length(part) < 3, IGNORE).otherwise(UNK)).when(F.col("_inner") == CLEAN, PUNCT).otherwise(F.col("_inner"))
    rows = rows.withColumn("cls", F.when(F.col("_edged"), stripped).otherwise(F.col("_inner")))
    return rows.withColumn("form", F.when(F.col("cls") == PUNCT, F.col("_bare")).otherwise(F.lit(""))).drop("_bare", "_edged", "_inner")


def fold_classes(parts: Column) -> Column:
    """The class of an n-gram from its parts' struct(part, cls), in order."""
    many = F.size(parts) > 1

    def step(state: Column, x: Column) -> Column:
        cls = x["cls"]
        lone = many & (F.length(x["part"]) == 1) & ~x["part"].rlike(r"^[a-zA-Z0-9-]$")
        hyphen = (state["cl"] == CLEAN) & (F.size(parts) > 2) & (state["n"] == 1) & (x["part"] == "-") & (cls == IGNORE)
        new = (
            F.when(lone | (state["cl"] == IGNORE), F.lit(IGNORE))
            .when(hyphen, F.lit(CLEAN))
            .when(state["cl"] == "", cls)
            .when((cls == IGNORE) | (state["cl"] == UNK), F.lit(IGNORE))
            .when((state["cl"] == CLEAN) & (cls == UNK), F.lit(IGNORE))
            .when((state["cl"] == PUNCT) | (cls == PUNCT), F.lit(PUNCT))
            .otherwise(F.lit(CLEAN))
        )
        return F.struct(new.alias("cl"), (state["n"] + 1).alias("n"))

    return F.aggregate(parts, F.struct(F.lit("").alias("cl"), F.lit(0).alias("n")), step, lambda s: s["cl"])


def _classified_parts(words: DataFrame, letters: str, background: DataFrame | None) -> DataFrame:
    """`words` with `ps`: array of struct(pos, part, cls, form, known). Each distinct part is classified and looked up
    once, whatever the number of words it stands in."""
    rows = words.select("*", F.posexplode("parts").alias("pos", "part"))
    parts = with_part_class(words.select(F.explode("parts").alias("part")).distinct(), "part", letters)
    if background is None:
        parts = parts.withColumn("known", F.lit(0))
    else:
        known = background.select(F.lower("word").alias("w")).where(F.col("w").isNotNull()).distinct()
        parts = parts.join(known.withColumn("k1", F.lit(1)), F.lower("part") == F.col("w"), "left").drop("w")
        parts = parts.join(known.withColumn("k2", F.lit(1)), F.lower("form") == F.col("w"), "left").drop("w")
        own = F.col("k1") == 1
        parts = parts.select("part", F.when(own, CLEAN).otherwise(F.col("cls")).alias("cls"), F.when(own, "").otherwise(F.col("form")).alias("form"), F.coalesce("k1", "k2", F.lit(0)).alias("known"))
    first = [c for c in words.columns if c != "orig"]
    rows = lookup(rows, "part", parts.withColumnRenamed("part", "_part"), "_part", how="inner")
    return rows.groupBy("orig").agg(*[F.first(c).alias(c) for c in first], F.array_sort(F.collect_list(F.struct("pos", "part", "cls", "form", "known"))).alias("ps"))


def _route(words: DataFrame, acronyms: bool) -> DataFrame:
    """Rows (tag, key, value, freq, lex, orig) that each classified word adds to the tables."""
    end = F.array_join(F.transform("ps", lambda p: F.when(p["form"] == "", p["part"]).otherwise(p["form"])), X.SEPARATOR)
    w = words.withColumn("cl", fold_classes(F.transform("ps", lambda p: F.struct(p["part"].alias("part"), p["cls"].alias("cls"))))).where(F.col("cl") != IGNORE)
    w = w.withColumn("end", end).withColumn("lex", F.when(F.aggregate(F.transform("ps", lambda p: p["known"]), F.lit(0), lambda a, b: a + b) == F.size("ps"), 1).otherwise(0))
    on = F.lit(acronyms)
    w = w.withColumn("dotted", on & X.is_dotted_acronym(F.when(F.col("cl") == PUNCT, F.col("end")).otherwise(F.col("word"))))
    w = w.withColumn("heads", F.when(on & ~F.col("dotted"), X.article_acronyms(F.col("parts"))).otherwise(F.array().cast("array<string>")))

    def row(when: Column, tag: str, key: Column | str, value: Column | str | None = None, lex: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(tag).alias("tag"), X.col(key).alias("key"), (X.col(value) if value is not None else F.lit(None).cast("string")).alias("value"), (lex if lex is not None else F.lit(0)).alias("lex")))

    cl, dotted, headed = F.col("cl"), F.col("dotted"), F.size("heads") > 0
    plain = ~dotted & ~headed
    out = F.array(
        row(cl == CLEAN, "clean", "word", lex=F.col("lex")),
        row((cl == CLEAN) & (F.col("word") != F.col("orig")), "punct", "orig", "word"),
        row((cl != CLEAN) & dotted, "clean", "word"),
        row(dotted, "dotted", F.when(cl == PUNCT, F.col("end")).otherwise(F.col("word"))),
        row((cl == PUNCT) & dotted, "punct", "end", "word"),
        row((cl == UNK) & plain, "unk", "orig"),
        row((cl == PUNCT) & plain, "clean", "end", lex=F.col("lex")),
        row((cl == PUNCT) & plain, "punct", "orig", "end"),
    )
    heads = F.transform("heads", lambda a: F.struct(F.lit("acro").alias("tag"), a.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("lex")))
    rows = w.select("orig", "freq", F.explode(F.concat(F.filter(out, lambda x: x.isNotNull()), heads)).alias("r"))
    return rows.select("r.tag", "r.key", "r.value", "r.lex", "freq", "orig")


def _words(lexicon: DataFrame, rules: tuple, scratch: Scratch) -> DataFrame:
    w = lexicon.select(F.col("word").alias("orig"), F.coalesce(F.col("freq").cast("bigint"), F.lit(0)).alias("freq")).where("orig is not null")
    w = w.groupBy("orig").agg(F.max("freq").alias("freq")) if "pos" not in lexicon.columns else lexicon.where("word is not null").groupBy(F.col("word").alias("orig")).agg(F.max_by(F.col("freq").cast("bigint"), "pos").alias("freq"))
    # Written between the steps: the rules are long, and each later use of the word would repeat them in the plan.
    w = scratch.save(w.withColumn("word", X.transliterate("orig", rules)))
    w = scratch.save(w.withColumn("parts", X.split_parts("word")))
    n = F.size("parts")
    return w.where((n > 0) & ~((n == 2) & (F.length("word") < 6)) & ~((n == 3) & (F.length("word") < 8)))


def classify_lexicon(lexicon: DataFrame, *, letters: str = "", background: DataFrame | None = None, artifrq: int = 0, acronyms: bool = False,
                     hemps: DataFrame | None = None, rules: tuple = X.DEFAULT_RULES) -> dict[str, DataFrame]:
    """Tables by name: `clean`, `unk` and `acro` (word, freq), `punct` (word, form), and with a background `fore` (word, freq),
    the clean words of the lexicon alone.

    `lexicon` is (word, freq[, pos]); of a repeated word the row of the largest `pos` counts, without `pos` the largest
    frequency. `background` (word, freq) needs `artifrq`, the artificial frequency of lexical words; a null frequency is
    that. `hemps` (word) are words spelt with separators, classified first with frequency 1. Null words are left out; an
    empty lexicon gives empty tables.
    """
    if background is not None and artifrq <= 0:
        raise ValueError("a background lexicon needs artifrq")
    scratch = Scratch(lexicon.sparkSession, "classified")
    words = _words(lexicon, rules, scratch)
    rows = _route(_classified_parts(words, letters, background), acronyms).withColumn("turn", F.lit(1))
    if hemps is not None:
        h = hemps.where("word is not null").select(F.col("word").alias("hemp"), F.translate("word", X.SEPARATOR, "").alias("word"))
        spelt = _route(_classified_parts(_words(h.select("word", F.lit(1).alias("freq")).distinct(), rules, scratch), letters, None), acronyms)
        own = spelt.where("tag = 'punct'").select(F.col("orig").alias("o"), F.col("key").alias("k"), F.col("value").alias("v")).where("k = o").select("o", "v")
        named = h.join(own, F.col("word") == F.col("o"), "left").select(F.lit("punct").alias("tag"), F.col("hemp").alias("key"), F.coalesce("v", "word").alias("value"), F.lit(0).alias("lex"), F.lit(1).cast("bigint").alias("freq"), F.col("hemp").alias("orig"))
        rows = rows.unionByName(spelt.where("tag <> 'punct'").unionByName(named).withColumn("turn", F.lit(0)))
    rows = scratch.save(rows)  # five tables are made of it
    total, lex = F.sum("freq"), F.max("lex")
    fore = rows.where("tag = 'clean'").groupBy("key").agg((total + F.when((lex == 1) & (total < artifrq), F.lit(artifrq)).otherwise(F.lit(0))).alias("freq")).withColumnRenamed("key", "word")
    unk = rows.where("tag = 'unk'").groupBy(F.col("key").alias("word")).agg(total.alias("freq"))
    punct = rows.where("tag = 'punct'").groupBy(F.col("key").alias("word")).agg(F.max_by("value", F.struct("turn", "orig")).alias("form"))
    heads = rows.where("tag = 'acro'").groupBy(F.col("key").alias("word")).agg(total.alias("freq"))
    dotted = rows.where("tag = 'dotted'").groupBy(F.col("key").alias("word")).agg(total.alias("freq"))
    dotted = dotted.join(heads.select(F.col("word").alias("h")), X.filter_punct("word") == F.col("h"), "left_semi")
    acro = heads.unionByName(dotted).groupBy("word").agg(F.sum("freq").alias("freq"))
    out = {"unk": unk, "punct": punct, "acro": acro}
    if background is None:
        return out | {"clean": fore}
    back = background.where("word is not null").groupBy(F.col("word").alias("w")).agg(F.max(F.coalesce(F.col("freq").cast("bigint"), F.lit(artifrq))).alias("b"))
    both = fore.join(back, F.col("word") == F.col("w"), "full_outer")
    f, b, a = F.col("freq"), F.coalesce("b", F.lit(0)), F.lit(artifrq)
    alone = F.when((f + b > a) & (f + b - a > a), f + b - a).otherwise(f + b)
    merged = F.when(f.isNull(), b).when((f > a) & (b >= a), f - a + b).otherwise(f + b)
    return out | {"fore": both.where("word is not null").select("word", alone.alias("freq")), "clean": both.select(F.coalesce("word", "w").alias("word"), merged.alias("freq"))}
