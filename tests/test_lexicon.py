"""Frequency tables, alphabets, confusions, classification."""

from collections import Counter
from itertools import combinations_with_replacement

import pytest

from lexloom.operators import alphabet as A
from lexloom.operators import classify as C
from lexloom.operators import lexicon as L


def pairs(df, a="word", b="freq"):
    return {r[a]: r[b] for r in df.collect()}


def test_word_count_per_line_and_document(spark):
    docs = spark.createDataFrame([("een twee drie\nvier vijf", 1), ("een  twee", 2), (None, 3), ("", 4)], "text string, word int")
    assert pairs(L.word_count(docs, "text", 2, per_line=True)) == {"een_twee": 2, "twee_drie": 1, "vier_vijf": 1}
    assert pairs(L.word_count(docs, "text", 2)) == {"een_twee": 2, "twee_drie": 1, "drie_vier": 1, "vier_vijf": 1}
    assert pairs(L.word_count(docs, "text", 3, per_line=True)) == {"een_twee_drie": 1}
    assert L.word_count(docs.where("false"), "text").count() == 0


def test_emphasis_runs(spark):
    docs = spark.createDataFrame([(1, "dit is h e l d e r en 7 x"), (2, "a woord b"), (3, None), (4, "x y")], "id int, t string")
    assert {(r.id, r.run) for r in L.emphasis_runs(docs, "t", "id").collect()} == {(1, "h_e_l_d_e_r"), (1, "7_x"), (4, "x_y")}


def test_running_totals_follow_the_order(spark):
    rows = [(f"w{i}", (i * 7) % 13) for i in range(200)]
    got = L.with_running_totals(spark.createDataFrame(rows, "word string, freq bigint")).collect()
    total, run = sum(f for _, f in rows), 0
    for w, f in sorted(rows, key=lambda x: (-x[1], x[0])):
        run += f
        r = next(x for x in got if x.word == w)
        assert r.cumsum == run and r.pct == pytest.approx(100 * run / total)


def test_summary_merge_and_last(spark):
    a = spark.createDataFrame([("x", 2), ("y", 3), (None, 1)], "word string, freq bigint")
    b = spark.createDataFrame([("x", 5), ("z", None)], "word string, freq bigint")
    assert pairs(L.merge_lexicons(a, b)) == {"x": 7, "y": 3, "z": 0}
    s = L.summary(a.where("word is not null")).first()
    assert (s.tokens, s.types, round(s.ttr, 3)) == (5, 2, 0.4)
    assert L.summary(a.where("false")).first().ttr is None
    rows = spark.createDataFrame([("x", 1, 1), ("x", 9, 2), ("x", 4, 0)], "w string, f int, o int")
    assert pairs(L.last_wins(rows, "w", "f", "o")) == {"x": 9}


def test_lexclean(spark):
    lex = spark.createDataFrame([("abba", 1), ("ab1", 2), ("xyz", 3), ("ab N x1", 4), (None, 5)], "word string, freq int")
    clean, dirty = L.lexclean(lex, "ab")
    assert set(pairs(clean)) == {"abba"} and set(pairs(dirty)) == {"ab1", "xyz", "ab N x1"}
    assert set(pairs(L.lexclean(lex, "ab", reverse=True)[0])) == {"xyz"}
    assert set(pairs(L.lexclean(lex, "ab", tagged=True)[0])) == {"abba", "ab N x1"}
    assert set(pairs(L.length_band(lex, "word", 4, 0))) == {"abba", "ab N x1"}


def test_alphabet(spark):
    counts = A.char_count(spark.createDataFrame([("Aab b_",), (None,), ("a",)], "line string"), "line")
    assert pairs(counts, "ch") == {"a": 3, "b": 2, " ": 1, "_": 1}
    got = A.alphabet_build(counts, clip=1, separator="_").collect()
    assert {r.ch: r.hash for r in got} == {"*": 100**5, "$": 101**5, "_": 102**5, "a": 103**5, "b": 104**5}
    ties = spark.createDataFrame([("x", 1), ("y", 1)], "ch string, freq bigint")
    assert pairs(A.alphabet_build(ties).where("freq > 0"), "ch", "hash") == {"y": 102**5, "x": 103**5}
    assert A.alphabet_build(counts.where("false")).count() == 2


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_confusions(spark, distance):
    symbols = [(c, n**5) for c, n in zip("abcde", range(102, 107), strict=True)]
    strings = [c for k in range(distance + 1) for c in combinations_with_replacement(symbols, k)]
    want = {abs(sum(v for _, v in x) - sum(v for _, v in y)) for x in strings for y in strings if not {s for s, _ in x} & {s for s, _ in y}} - {0}
    got = A.confusions(spark, symbols, distance)
    assert {r.kwc for r in got.collect()} == want
    assert got.where("example = 'b~a'").first().kwc == 103**5 - 102**5
    every = A.confusions(spark, symbols, 1, all_examples=True).collect()
    assert len(every) == 5 + 10
    assert A.confusions(spark, symbols, 0).count() == 0


def test_diacritics(spark):
    table = spark.createDataFrame([("e", 0, 10), ("é", 0, 25), ("ö", 0, 3)], "ch string, freq bigint, hash bigint")
    assert [tuple(r) for r in A.diacritic_confusions(table).collect()] == [(15, "é~e")]


LETTERS = C.both_cases("abcdefghijklmnopqrstuvwxyz-'")


def test_word_classes(spark):
    want = {"huis": "CLEAN", "h": "IGNORE", "XIV": "IGNORE", "1984": "IGNORE", "12a": "IGNORE", "3.14": "IGNORE", "h%$#s": "UNK", "hu%s": "CLEAN", "a.b.c.de": "CLEAN", "%%%%": "UNK", "b2": "IGNORE", "ab": "CLEAN"}
    df = spark.createDataFrame([(w,) for w in want], "word string")
    assert pairs(C.with_word_class(df, "word", "cls", LETTERS), "word", "cls") == want
    part = {r.word: (r.cls, r.form) for r in C.with_part_class(spark.createDataFrame([("(huis)",), ("...",), ("..",), ("huis",), ("«h%$#k%s»",)], "word string"), "word", LETTERS).collect()}
    assert part == {"(huis)": ("PUNCT", "huis"), "...": ("UNK", ""), "..": ("IGNORE", ""), "huis": ("CLEAN", ""), "«h%$#k%s»": ("UNK", "")}


def test_classified_lexicon(spark):
    lex = spark.createDataFrame([("huis", 3), ("(huis)", 2), ("huis,", 1), ("...", 5), ("A.N.W.B.", 4), ("de_ANWB", 2), ("ab_c", 9), ("groot_huis", 1), ("huis_...", 1), ("œuvre", 1), (None, 1), ("1900", 3)], "word string, freq bigint")
    out = C.classify_lexicon(lex, letters=LETTERS, acronyms=True)
    assert pairs(out["clean"]) == {"huis": 6, "A.N.W.B.": 4, "de_ANWB": 2, "groot_huis": 1, "oeuvre": 1}
    assert pairs(out["unk"]) == {"...": 5}
    assert pairs(out["punct"], "word", "form") == {"(huis)": "huis", "huis,": "huis", "œuvre": "oeuvre", "A.N.W.B": "A.N.W.B."}
    assert pairs(out["acro"]) == {"ANWB": 2, "A.N.W.B": 4}
    empty = C.classify_lexicon(lex.where("false"), letters=LETTERS)
    assert all(t.count() == 0 for t in empty.values())


def test_background(spark):
    lex = spark.createDataFrame([("Huis", 3), ("(huis)", 2), ("boom", 1)], "word string, freq bigint")
    back = spark.createDataFrame([("huis", None), ("straat", 100)], "word string, freq bigint")
    out = C.classify_lexicon(lex, letters=LETTERS, background=back, artifrq=100)
    assert pairs(out["fore"]) == {"Huis": 103, "huis": 102, "boom": 1}
    assert pairs(out["clean"]) == {"Huis": 103, "huis": 102, "boom": 1, "straat": 100}
    with pytest.raises(ValueError):
        C.classify_lexicon(lex, background=back)


def test_hemps(spark):
    lex = spark.createDataFrame([("gewoon", 1)], "word string, freq bigint")
    hemps = spark.createDataFrame([("b_e_k_e_n_d",), ("z_e_e_r.",)], "word string")
    out = C.classify_lexicon(lex, letters=LETTERS, hemps=hemps)
    assert pairs(out["clean"]) == {"gewoon": 1, "bekend": 1, "zeer": 1}
    assert pairs(out["punct"], "word", "form") == {"b_e_k_e_n_d": "bekend", "z_e_e_r.": "zeer"}


def test_counts_with_a_hot_word(spark):
    docs = spark.createDataFrame([("de " * 500 + f"w{i}",) for i in range(50)], "text string")
    got = pairs(L.word_count(docs, "text"))
    assert got == dict(Counter(w for i in range(50) for w in ("de " * 500 + f"w{i}").split()))
