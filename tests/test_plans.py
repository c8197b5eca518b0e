"""The plans on small tables."""

import pytest

from lexloom.operators import alphabet as A
from lexloom.operators import vectors as V
from lexloom.plans import queries as Q
from lexloom.plans.pipeline import Pipeline


def test_chain_clean_keeps_ties(spark, tmp_path):
    texts = ["boomstam", "boomstan", "fietspad fietspad", "fietspat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [("*", 0, 100**5), ("$", 0, 101**5), ("_", 0, 102**5), *((c, 1, n**5) for n, c in enumerate("abdefimnopst", 103))]
    spark.createDataFrame(rows, "ch string, freq bigint, hash bigint").write.parquet(f"{tmp_path}/alphabet.parquet")
    # of equal frequencies the smaller value: m before n
    assert {(r.variant, r["head"]) for r in Q.chain_clean(spark, str(tmp_path)).collect()} >= {("boomstan", "boomstam"), ("fietspat", "fietspad")}


def test_pipeline_from_texts(spark):
    texts = spark.createDataFrame([("huisdeur huisdeur huisdeurs huisduer fietsen fietsen\\nfietsen fitsn fietzen",)], "text string")
    back = spark.createDataFrame([("huisdeur", 1000), ("fietsen", 1000)], "word string, freq bigint")
    got = Pipeline(spark, artifrq=1000).run(texts=texts, background=back)
    # one letter, two letters and a transposition
    want = {("huisduer", "huisdeur"), ("huisdeurs", "huisdeur"), ("fietzen", "fietsen"), ("fitsn", "fietsen")}
    assert {(r.variant, r.candidate) for r in got["ranked"].collect()} == want
    assert {(r.variant, r["head"], r.deleted) for r in got["cleaned"].collect()} == {(*w, False) for w in want}


def test_alphabet_is_whole(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "ch string, freq bigint")
    monkeypatch.setattr(A, "MOST_SYMBOLS", 2)
    assert A.alphabet_build(counts, clip=2).count() == 4
    with pytest.raises(ValueError):
        A.alphabet_build(counts, clip=1)


def test_all_words_of_a_query_count(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "word bigint, vec array<double>")
    asked = spark.createDataFrame([(1, [0] * 1001 + [1] * 3000)], "qid bigint, words array<bigint>")
    assert [r.word for r in V.nearest(v, asked, 1).collect()] == [2]
