"""Text functions as Column expressions: everything stays inside generated JVM code.

Lengths, positions and orders are by code point.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "_"

# Character classes by general category, for Java regular expressions.
LETTER = r"\p{Lu}\p{Ll}"
DIGIT = r"\p{Nd}"
PUNCT = r"\p{P}"
OTHER = r"\p{S}\p{No}\p{Cf}\p{Mn}\p{Cc}"
SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"
EDGE = rf"[{SPACE}_^<>{PUNCT}{OTHER}&&[^-]]"

#: Values for what is not in an alphabet: all punctuation of a word together, each other character; and the separator.
FOREIGN_PUNCT, FOREIGN_CHAR, SEPARATOR_VALUE = 100**5, 101**5, 102**5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(values: list, ddl: str) -> Column:
    """A constant array of any length: folded into the plan once, instead of a Column for each element."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), ddl)


def fifth_power(c: Column | str) -> Column:
    x = col(c).cast("bigint")
    return x * x * x * x * x


def chars(c: Column | str) -> Column:
    """The characters of a text as an array; none for the empty text."""
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def remove(c: Column, what: str) -> Column:
    """`c` without the characters of `what`."""
    return F.translate(c, what, "") if what else c


def alphabet_values(rows: list) -> dict[str, int]:
    """Character -> value from collected (ch, hash) rows; the two collective symbols aren't characters."""
    return {r.ch: r.hash for r in rows if r.ch not in ("*", "$")}


def anagram_hash(c: Column | str, alphabet: dict[str, int]) -> Column:
    """The sum of the characters' values, in lower case. Blanks outside the alphabet count nothing, punctuation outside it
    counts once for the word, any other character outside it each time. Null for null, 0 for the empty text."""
    low = F.lower(col(c))
    known = "".join(alphabet)
    rest = remove(low, known)
    # One pass over the characters for each distinct value would cost more than one lookup for each character.
    value = F.create_map(*[F.lit(x) for ch, v in alphabet.items() for x in (ch, v)]) if alphabet else None
    total = F.lit(0).cast("bigint")
    if value is not None:
        total = F.aggregate(chars(low), total, lambda acc, ch: acc + F.coalesce(F.element_at(value, ch), F.lit(0).cast("bigint")))
    strange = F.length(F.regexp_replace(rest, rf"[{SPACE}{PUNCT}]", "")).cast("bigint")
    return total + F.when(rest.rlike(rf"[{PUNCT}]"), F.lit(FOREIGN_PUNCT)).otherwise(F.lit(0)) + strange * F.lit(FOREIGN_CHAR)


def filter_tilde_hash(c: Column | str) -> Column:
    return F.translate(col(c), "~#", "__")


def filter_punct(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"[{PUNCT}]", "")


def strip_edges(c: Column | str) -> Column:
    """Without punctuation, symbols and blanks at either end. A hyphen at an end goes together with the character next to
    it unless that is a letter. Both ends are measured on the whole text, so they may meet and leave nothing."""
    w = col(c)
    edge = rf"^(?:{EDGE}|-[^{LETTER}])++"
    head = F.length(F.regexp_extract(w, edge, 0))
    tail = F.length(F.regexp_extract(F.reverse(w), edge, 0))
    return F.when(head + tail < F.length(w), F.substring(w, head + 1, F.length(w) - head - tail)).otherwise(F.lit(""))


def has_edges(c: Column | str) -> Column:
    return col(c).rlike(rf"^(?:{EDGE}|-[^{LETTER}])") | F.reverse(col(c)).rlike(rf"^(?:{EDGE}|-[^{LETTER}])")


# The patterns of Roman numerals, dotted acronyms, and acronyms behind a Dutch article.
ROMAN = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
DOTTED = r"^(\p{Lu}{1,2}\.{1,2}(\p{Lu}{1,2}\.{1,2})*)(\p{Lu}{0,2})$"
ARTICLE = r"^(?:de|het|een)_(\p{Lu}+)-?\p{L}*$"


def is_roman(c: Column | str) -> Column:
    return col(c).rlike(ROMAN)


def is_dotted_acronym(c: Column | str) -> Column:
    return col(c).rlike(DOTTED)


def article_acronyms(parts: Column) -> Column:
    """The capital words behind a Dutch article in neighbouring parts, sorted and without repeats."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.concat(F.get(parts, i), F.lit(SEPARATOR), F.get(parts, i + 1)))
    found = F.transform(pairs, lambda p: F.regexp_extract(p, ARTICLE, 1))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(found, lambda x: x != ""))))


# The default transliteration, first match first. (pattern, replacement)
DEFAULT_RULES = (
    ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), (r"Œ(?=\p{Lu})", "OE"), ("Œ", "Oe"), ("ĳ", "ij"), ("Ĳ", "IJ"),
    ("ﬂ", "fl"), ("ﬁ", "fi"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ß", "ss"), ("[~#]", "*"), (r"\x{A0}", "_"),
    (r"[\-\x{AD}\x{58A}\x{5BE}\x{1806}\x{2010}-\x{2015}\x{2053}\x{207B}\x{208B}\x{2212}\x{2E17}\x{2E1A}\x{2E3A}\x{2E3B}\x{301C}\x{3030}\x{30A0}\x{30FB}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}\x{FF65}]+", "-"),
    ("[•·]", "."),
)


def parse_rules(text: str) -> tuple[tuple[str, str], ...]:
    """Transliteration rules `source > target;`, one or more a line; both sides literal or in single quotes."""
    import re

    out = []
    for rule in filter(None, (r.strip() for r in re.sub(r"(?m)^\s*#.*$", "", text).split(";"))):
        m = re.fullmatch(r"(.+?)\s*>\s*(.*)", rule, re.S)
        if not m:
            raise ValueError(f"not a rule: {rule}")
        a, b = (re.fullmatch(r"'(.*)'", x.strip(), re.S) for x in m.groups())
        a, b = (x.group(1) if x else y.strip() for x, y in zip((a, b), m.groups(), strict=True))
        out.append((re.escape(a), b.replace("\\", "\\\\").replace("$", "\\$")))
    return tuple(out)


def transliterate(c: Column | str, rules: tuple[tuple[str, str], ...] = DEFAULT_RULES) -> Column:
    """Every rule in turn; a text that none applies to costs one search."""
    out = col(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return F.when(col(c).rlike("|".join(p for p, _ in rules)), out).otherwise(col(c)) if rules else col(c)


def split_parts(c: Column | str) -> Column:
    """The parts of an n-gram. Empty parts go; a separator at either end of the word stays with its neighbour."""
    w = col(c)
    parts = F.filter(F.split(w, SEPARATOR), lambda x: x != "")
    n = F.size(parts)
    return F.transform(parts, lambda x, i: F.concat(
        F.when((i == 0) & w.startswith(SEPARATOR), F.lit(SEPARATOR)).otherwise(F.lit("")), x,
        F.when((i == n - 1) & w.endswith(SEPARATOR), F.lit(SEPARATOR)).otherwise(F.lit(""))))


def plain_parts(c: Column | str, pattern: str = SEPARATOR) -> Column:
    return F.filter(F.split(col(c), pattern), lambda x: x != "")


def edit_distance(a: Column | str, b: Column | str, caseless: bool = False) -> Column:
    a, b = (F.lower(col(x)) if caseless else col(x) for x in (a, b))
    return F.levenshtein(a, b)


def first_foreign_char(a: Column | str, b: Column | str, default: str = "") -> Column:
    """The first character of `b` (in lower case) that is not in `a`."""
    return F.coalesce(F.get(F.array_except(chars(F.lower(col(b))), chars(F.lower(col(a)))), F.lit(0)), F.lit(default))


def digits(c: Column | str) -> Column:
    return F.length(col(c).cast("string"))


def ngrams(tokens: Column, n: int, separator: str = SEPARATOR) -> Column:
    """All runs of n neighbouring tokens, joined."""
    if n == 1:
        return tokens
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), separator))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(col(c), rf"[{SPACE}]+"), lambda x: x != "")


def ratio_angle(ratio: Column) -> Column:
    return F.degrees(F.atan(ratio))
