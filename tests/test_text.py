"""Text functions against plain Python."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators.alphabet import strip_accents

ALPHABET = {"a": 103**5, "b": 104**5, "é": 105**5, "-": 106**5, "_": 102**5}


def run(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    return [tuple(r) for r in df.select("i", *exprs).orderBy("i").drop("i").collect()]


def brute_hash(word):
    total, punct = 0, False
    for ch in word.lower():
        if ch in ALPHABET:
            total += ALPHABET[ch]
        elif unicodedata.category(ch)[0] == "P":
            punct = True
        elif not ch.isspace():
            total += 101**5
    return total + (100**5 if punct else 0)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.lists(st.text(alphabet="abABéÉ-_.,!xß7²  ", max_size=12), min_size=1, max_size=30))
def test_anagram_hash(spark, words):
    assert run(spark, words, X.anagram_hash("w", ALPHABET)) == [(brute_hash(w),) for w in words]


def test_hash_is_additive_and_blind_to_order(spark):
    got = [r[0] for r in run(spark, ["ab", "ba", "a", "b", None, ""], X.anagram_hash("w", ALPHABET))]
    assert got[0] == got[1] == got[2] + got[3] and got[4] is None and got[5] == 0


def brute_strip(w):
    edge = lambda c: c != "-" and (c in "_^<>\xa0" or unicodedata.category(c) in ("Po", "Pi", "Pf", "Pc", "Ps", "Pe", "Pd", "Sm", "So", "No", "Cf", "Mn", "Sc", "Sk", "Cc") or c.isspace())
    letter = lambda c: unicodedata.category(c) in ("Lu", "Ll")

    def lead(s):
        n = 0
        while n < len(s):
            if edge(s[n]):
                n += 1
            elif s[n] == "-" and n + 1 < len(s) and not letter(s[n + 1]):
                n += 2
            else:
                break
        return n

    head, tail = lead(w), lead(w[::-1])
    return w[head : len(w) - tail] if head + tail < len(w) else ""


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.lists(st.text(alphabet="ab.-_!²7é ", max_size=10), min_size=1, max_size=40))
def test_strip_edges(spark, words):
    got = run(spark, words, X.strip_edges("w"), X.has_edges("w"))
    assert got == [(brute_strip(w), brute_strip(w) != w) for w in words]


def test_acronyms_and_numerals(spark):
    words = ["MCMXCIV", "", "iv", "A.B.", "AB.C", "A.b", "N.S.B.", "VIII"]
    assert [r[0] for r in run(spark, words, X.is_roman("w"))] == [True, True, False, False, False, False, False, True]
    assert [r[0] for r in run(spark, words, X.is_dotted_acronym("w"))] == [False, False, False, True, True, False, True, False]
    grams = ["de_KLM-vlucht", "het_WHO", "een_woord", "de", "de_ANWB_het_WNF"]
    assert [r[0] for r in run(spark, grams, X.article_acronyms(X.split_parts("w")))] == [["KLM"], ["WHO"], [], [], ["ANWB", "WNF"]]


def test_parts_keep_outer_separators(spark):
    got = run(spark, ["a_b", "_a__b_", "_", "", "a-b_c"], X.split_parts("w"), X.plain_parts("w", "[_-]"))
    assert got == [(["a", "b"], ["a", "b"]), (["_a", "b_"], ["a", "b"]), ([], []), ([], []), (["a-b", "c"], ["a", "b", "c"])]


def test_transliteration(spark):
    got = [r[0] for r in run(spark, ["æŒUVRE", "Œuvre", "a–—b", "x~y#z", "ﬁn•", "c\xa0d", None, "plain"], X.transliterate("w"))]
    assert got == ["aeOEUVRE", "Oeuvre", "a-b", "x*y*z", "fin.", "c_d", None, "plain"]
    rules = X.parse_rules("# a comment\nſ > s;\n'~' > '*'; $ > S;")
    assert [r[0] for r in run(spark, ["ſoo~$"], X.transliterate("w", rules))] == ["soo*S"]


def test_ngrams_and_tokens(spark):
    got = run(spark, ["a b  c", "a", "", " \t"], X.ngrams(X.tokens("w"), 2), X.ngrams(X.tokens("w"), 1))
    assert got == [(["a_b", "b_c"], ["a", "b", "c"]), ([], ["a"]), ([], []), ([], [])]


def test_strip_accents(spark):
    words = ["é", "é", "Ångström", "ñandú", "ø", "ǖ", ""]
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words]
    assert [r[0] for r in run(spark, words, strip_accents(F.col("w")))] == want


def test_first_foreign_char(spark):
    df = spark.createDataFrame([("abc", "abXc"), ("abc", "cab"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(X.first_foreign_char("a", "b", "?")).collect()] == ["x", "?", "?"]
