"""One form for text that looks the same.

`compat_form` is compatibility normalisation in composed form with full case folding, mapped blanks and
default-ignorable characters removed. Texts of the same form, once look-alike letters of other scripts are mapped, make a
class. Within a class `reader_form` tells apart what a reader does: letter case, raised digits and long s. Only distinct
values with a character outside printable ASCII reach Python, as Arrow batches, and those alone in their class are done.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..operators.lookup import lookup
from ..session import Scratch

#: Strings of a group whose pairs with the group are made by one task.
PART = 1000

# Letters of other scripts with the shape of an ASCII letter.
LOOK_ALIKES = (
    ("Cyrillic capitals", "АВЕЅІЈКМНОРСТУХҮԌԚԜӀҺЬ", "ABESIJKMHOPCTYXYGQWIhb"),
    ("Cyrillic small", "аеѕіјорсухһԁԛԝӏү", "aesijopcyxhdqwly"),
    ("Greek capitals", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("Greek small", "ονϲϳρ", "ovcjp"),
    ("Armenian", "օսոհցՕՍ", "ounhgOU"),
    ("Latin letters beyond ASCII", "ɡɑ", "ga"),
)
# Default_Ignorable_Code_Point of the Unicode Character Database, as code point ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# White_Space of the Unicode Character Database, as code point ranges.
ASCII_BLANK = ((0x09, 0x0D), (0x1C, 0x1F))
BLANK = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _one_of(*tables: tuple) -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for t in tables for a, b in t) + "]")


#: Texts of printable ASCII are their own form, but for case.
PLAIN = r"^[\x20-\x7e]*\z"
_ignorable = _one_of(IGNORABLE)
_odd_blank = _one_of(BLANK)
_any_blank = _one_of(ASCII_BLANK, BLANK)
_alike = {ord(a): b for _, xs, ys in LOOK_ALIKES for a, b in zip(xs, ys, strict=True)}


@lru_cache(maxsize=65536)
def _same_shape(ch: str) -> str:
    """Width forms, ligatures, number forms and styled letters by their compatibility form; all else as it is."""
    if ch == chr(0xFB05):  # the ligature of long s and t keeps its long s
        return chr(0x17F) + "t"
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in ("<wide>", "<narrow>") or kind in ("<compat>", "<font>") and unicodedata.category(ch)[0] in "LN" and ch != chr(0x17F):
        return unicodedata.normalize("NFKC", ch)
    return ch


def compat_form(text: str) -> str:
    """Compatibility composed form, full case folding, every blank a space, no default-ignorable characters.

    Folding can undo the composition, so it is followed by a second normalisation; the result is a fixed point."""
    text = unicodedata.normalize("NFKC", _any_blank.sub(" ", _ignorable.sub("", text)))
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _alike_form(text: str) -> str:
    """Look-alike letters mapped, also under an accent."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_alike))


def class_form(text: str) -> str:
    """`compat_form` with look-alike letters mapped. Letters are mapped before their case is folded, as capitals and small
    letters look like different ones, and after what normalisation brings to light."""
    return compat_form(_alike_form(unicodedata.normalize("NFKC", _any_blank.sub(" ", _ignorable.sub("", text)))))


def reader_form(text: str) -> str:
    """Equal for texts that a reader sees as the same: case, accents, raised digits, long s and all differences
    between ASCII characters stay."""
    if text.isascii():
        return text
    text = _odd_blank.sub(" ", _ignorable.sub("", text))
    return _alike_form("".join([ch if ch < "\x80" else _same_shape(ch) for ch in text]))


def _formed(distinct: DataFrame, one, name: str, easy: Column) -> DataFrame:
    """`distinct` (text, ...) with a form; texts of printable ASCII have the expression `easy`, the others go through `one`."""
    plain = F.col("text").rlike(PLAIN)
    schema = T.StructType([*distinct.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [one(x) for x in b["text"]]})

    return distinct.where(plain).withColumn(name, easy).unionByName(distinct.where(~plain).mapInPandas(run, schema))


def visual_forms(values: DataFrame, column: str) -> DataFrame:
    """(text, form) for every distinct non-null value of `column`, form being `compat_form`. Empty text has the empty form,
    an empty table gives no rows, other columns are not read."""
    distinct = values.select(F.col(f"`{column}`").alias("text")).where(F.col("text").isNotNull()).distinct()
    return _formed(distinct, compat_form, "form", F.lower("text"))


def same_look_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """(text, look): the strings of the columns that a reader sees as the same text as another one, `look` being the same for
    all strings that look the same: equal but for width, composition of accents, invisible characters, kind of blank and
    same-shaped letters. Letter case, accents, raised digits and long s count. Nulls take no part; an empty table gives
    no rows.

    Candidates are the classes of strings with the same compatibility form; only classes of two and more strings, not all
    of printable ASCII, are told apart by the narrower form. Counting is partially aggregated, so a class may be of any size.
    """
    values = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("text")).where(F.col("text").isNotNull()).distinct()
    classed = Scratch(df.sparkSession, "looks").save(_formed(values, class_form, "class", F.lower("text")))
    # Two strings of printable ASCII never look the same, so a class needs another one.
    sizes = classed.groupBy(F.col("class").alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("text").rlike(PLAIN)).alias("odd"))
    candidates = lookup(classed, "class", sizes.where("n > 1 and odd").select("_c"), "_c", how="left_semi")
    looks = Scratch(df.sparkSession, "looks").save(_formed(candidates, reader_form, "look", F.col("text")).select("text", "look"))
    many = looks.groupBy(F.col("look").alias("_l")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_l")
    return lookup(looks, "look", many, "_l", how="left_semi")


def same_look_pairs(df: DataFrame, columns: list[str], part: int = PART) -> DataFrame:
    """(text_a, text_b), text_a < text_b: the pairs within the groups of `same_look_groups`. A large group's pairs are made
    in parts of about `part` strings against the group, so no task makes them all."""
    groups = Scratch(df.sparkSession, "looks").save(same_look_groups(df, columns))
    sizes = groups.groupBy(F.col("look").alias("_l")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    rows = lookup(groups, "look", sizes, "_l")
    left = rows.select("look", F.col("text").alias("a"), F.pmod(F.xxhash64("text"), F.col("parts")).cast("int").alias("p"))
    right = rows.select("look", F.col("text").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    return left.join(right, ["look", "p"]).where("a < b").select(F.col("a").alias("text_a"), F.col("b").alias("text_b"))
