"""Readers, sinks, raw records, vectors and streams."""

import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import vectors as V
from lexloom.sources import formats, sinks
from lexloom.sources import raw_records as R
from lexloom.streaming.word_count import stream_word_count, windowed_word_count


def values(df):
    return [r.value for r in df.collect()]


def test_round_trips(spark, tmp_path):
    freqs = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("z", 0)], "word string, freq bigint")
    assert values(sinks.wordfreq(freqs)) == ["c\t9", "a\t2", "b\t2", "z\t0"]
    assert values(sinks.wordfreq_clean(freqs))[-1] == "z"
    sinks.write(sinks.wordfreq(freqs), str(tmp_path / "f"))
    back = formats.lexicon(formats.lines(spark, str(tmp_path / "f")))
    assert {tuple(r) for r in back.collect()} == {("a", 2), ("b", 2), ("c", 9), ("z", 0)}
    ana = spark.createDataFrame([(5, "ab"), (5, "ba"), (7, "c")], "hash bigint, word string")
    assert values(sinks.anagrams(ana)) == ["5~ab#ba", "7~c"]
    assert {tuple(r) for r in formats.anagrams(sinks.anagrams(ana)).collect()} == {(5, "ab"), (5, "ba"), (7, "c")}
    idx = spark.createDataFrame([(3, 10), (3, 11), (4, 12)], "kwc bigint, hash bigint")
    assert {tuple(r) for r in formats.index(sinks.index(idx, per_line=1)).collect()} == {(3, 10), (3, 11), (4, 12)}
    conf = spark.createDataFrame([(1, "a~b"), (9, "ab~c")], "kwc bigint, example string")
    assert {tuple(r) for r in formats.confusions(sinks.confusions(conf)).collect()} == {(1, "a~b"), (9, "ab~c")}
    abc = spark.createDataFrame([("*", 0, 100**5), ("_", 0, 102**5), ("e", 9, 103**5)], "ch string, freq bigint, hash bigint")
    assert values(sinks.alphabet(abc)) == [f"# *\tdigits_and_punctuation\t{100**5}", f"_\t0\t\t{102**5}", f"e\t9\t{103**5}"]
    assert {r.ch for r in formats.alphabet(sinks.alphabet(abc)).collect()} == {"_", "e"}


def test_ranked_and_chained_lines(spark):
    rows = spark.createDataFrame([("v", 1, "c", 2, 7, 1, 0.9117647058), ("v", 1, "d", 2, 8, 1, 0.5), ("w", 1, "c", 3, 9, 1, 1.0)], "variant string, variant_freq bigint, candidate string, candidate_freq bigint, kwc bigint, ld int, score double")
    assert values(sinks.ranked(rows)) == ["v#1#c#2#7#1#0.911765", "v#1#d#2#8#1#0.5", "w#1#c#3#9#1#1"]
    assert values(sinks.ranked(rows, clip=1))[0].startswith("w#")
    assert formats.ranked(sinks.ranked(rows)).where("kwc = 7").first().score == 0.911765
    six = spark.createDataFrame([("v#1#c#2#1#0.5",), ("broken",)], "value string")
    assert [(r.kwc, r.score) for r in formats.ranked(six).collect()] == [(None, 0.5)]
    chained = spark.createDataFrame([("v", 1, "h", 9, 5, 1)], "variant string, variant_freq bigint, head string, head_freq bigint, kwc bigint, ld int")
    assert values(sinks.chained(chained)) == ["v#1#h#9#5#1#C"]
    assert formats.chained(sinks.chained(chained)).first().head == "h"
    assert [sinks.with_extension("x", "index"), sinks.with_extension("x.index", "index")] == ["x.index", "x.index"]


@pytest.mark.parametrize("x", [0.0, 1.0, 0.123456789, 0.00001234567, 0.9999999, 0.1])
def test_score_text(spark, x):
    assert float(spark.range(1).select(sinks.score_text(F.lit(x)).alias("s")).first().s) == pytest.approx(float(f"{x:.6g}"), rel=1e-6)


def test_lenient_readers(spark):
    rows = spark.createDataFrame([("huis\t3 # note",), ("huis\t\t5",), ("zonder",), ("",), ("a\tb\tc\td",)], "value string")
    assert {(r.word, r.freq) for r in formats.foreground(rows).collect()} == {("huis", 3), ("huis", 5)}
    assert {(r.word, r.freq) for r in formats.background(rows, 7).collect()} == {("huis", 3), ("huis", 5), ("zonder", 7)}
    assert formats.too_many(rows, F.col("value").contains("\t"), 1) and not formats.too_many(rows, F.col("value").contains("\t"), 2)


def test_xml(spark):
    docs = spark.createDataFrame([(1, "<a>een<b>twee</b> <c/>drie</a>"), (2, "<kapot>"), (3, None), (4, "<a/>")], "id int, x string")
    assert [(r.id, r.node, r.text) for r in formats.xml_texts(docs, "id", "x").orderBy("id", "node").collect()] == [(1, 0, "een"), (1, 1, "twee"), (1, 2, "drie")]


def test_documents_are_composed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("café\nx")
    (tmp_path / "b.xml").write_text("y")
    assert [r.text for r in formats.documents(spark, str(tmp_path), recursive=True, pattern=r"\.txt$").collect()] == ["caf\xe9\nx"]


def test_word_vectors(spark, tmp_path):
    words = [("koning", [1.0, 0.0]), ("koningin", [0.6, 0.8]), ("koning", [0.0, 1.0]), ("vrouw", [0.0, 2.0])]
    (tmp_path / "v.bin").write_bytes(b"4 2\n" + b"".join(w.encode() + b" " + struct.pack("<2f", *v) + b"\n" for w, v in words))
    v = formats.word_vectors(spark, str(tmp_path / "v.bin"))
    assert {r.word: [round(x, 3) for x in r.vec] for r in v.collect()} == {"koning": [1, 0], "koningin": [0.6, 0.8], "vrouw": [0, 2]}
    near = V.nearest(v, spark.createDataFrame([(1, ["koning"]), (2, ["koning", "vrouw"]), (3, ["weg"])], "qid bigint, words array<string>"), 5).collect()
    assert {(r.qid, r.word, round(r.similarity, 3)) for r in near} == {(1, "koningin", 0.6), (2, "koningin", 0.99)}
    got = V.analogies(v, spark.createDataFrame([(1, ["koning", "koningin", "vrouw"]), (2, ["koning"])], "qid bigint, words array<string>"), 5)
    assert got.count() == 0  # all three words are the query's own
    pairs = V.cosine_pairs(v, spark.createDataFrame([("koning", "vrouw"), ("koning", "weg")], "a string, b string")).collect()
    assert {(r.b, r.cosine) for r in pairs} == {("vrouw", 0.0), ("weg", None)}


def brute_fields(line):
    """Field by field, character by character."""
    fields, cur, state, i = [], "", "start", 0
    for i, c in enumerate(line + "\0"):
        end = i == len(line)
        if state == "start":
            if end or c == "\t":
                fields.append(cur)
            elif c == '"':
                state = "quoted"
            else:
                cur, state = c, "plain"
                continue
            cur = ""
        elif state == "plain":
            if end or c == "\t":
                fields.append(cur)
                cur, state = "", "start"
            elif c == '"':
                return None
            else:
                cur += c
        elif state == "quoted":
            if end:
                return None
            if c == '"':
                state = "closed"
            else:
                cur += c
        elif c == '"' and not end:
            cur, state = cur + '"', "quoted"
        elif end or c == "\t":
            fields.append(cur)
            cur, state = "", "start"
        else:
            return None
    return fields


@settings(max_examples=60, deadline=None)
@given(lines=st.lists(st.text(alphabet='a"\té', max_size=15), max_size=40), chunk=st.integers(1, 9))
def test_tokenizer(lines, chunk):
    import pyarrow as pa

    old, R.CHUNK = R.CHUNK, chunk
    R.states.__defaults__ = (chunk,)
    try:
        fields, reason, at = R.tokenize(pa.array(lines, pa.string()))
    finally:
        R.CHUNK = old
        R.states.__defaults__ = (old,)
    assert fields.to_pylist() == [brute_fields(x) for x in lines]
    assert [r is not None for r in reason.to_pylist()] == [brute_fields(x) is None for x in lines]
    for x, a in zip(lines, at.to_pylist(), strict=True):
        assert a is None or x.encode()[: a].count(b"\n") == 0 and a < len(x.encode())


def test_raw_records(spark):
    big = "9" * 400_000
    rows = ["﻿huis\t3\r", "huis", '"a""b"\t"7"', 'a"b\t7', '"a\t7', '"a"b\t7', "a b\t7", "a b", "a�", "a\x07b", "x\t-1", "x\t9223372036854775807", "x\t9223372036854775808", "x\t" + "0" * 30 + "5", "x\t" + big, big + "\t1", "\tx\t\t4\t", "a\t1\tb", '""', "  \t ", "", None, "x\t٣"]
    df = spark.createDataFrame([(i, v, "keep", i) for i, v in enumerate(rows)], "i int, line string, extra string, word int")
    out = {r.i: r for r in R.load_records(df, "line", [R.Field("word", "word"), R.Field("freq", "number")], least=1).collect()}
    good = {i: (r.word, r.freq) for i, r in out.items() if r._reason is None}
    assert good == {0: ("huis", 3), 1: ("huis", None), 2: ('a"b', 7), 11: ("x", 2**63 - 1), 13: ("x", 5), 15: (big, 1), 16: ("x", 4)}
    assert set(out) == set(range(19)) | {22}
    assert (out[3]._reason, out[3]._offset) == (R.QUOTE_IN_FIELD, 1) and (out[4]._reason, out[4]._offset) == (R.UNCLOSED, 0) and (out[5]._reason, out[5]._offset) == (R.AFTER_QUOTE, 3)
    assert out[17]._reason == "fields: 3" and out[18]._reason == "fields: 0" and out[12]._reason == "freq: number too large"
    assert R.load_records(df.where("false"), "line", [R.Field("word")]).count() == 0
    letters = R.load_records(spark.createDataFrame([("é\t1\t2",), ("é\t1\t2",), ("# x",), ('"\t"\t1\t2',)], "line string"), "line", [R.Field("ch", "char"), R.Field("f", "number"), R.Field("h", "number")], comment="#")
    assert [r._reason for r in letters.collect()] == [None, "ch: not one character", None]


def test_streams_count_like_batches(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a b a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"), (None, None)], "text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = stream_word_count(stream, "text").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2), ("b", 2)}
    q = windowed_word_count(stream, "text", "at").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.start)[:10], r.word, r.freq) for r in spark.table("days").collect()} == {("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "b", 1)}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    assert callable(e.entry)


def test_command_line(spark, tmp_path):
    from lexloom.__main__ import main

    at = lambda x: str(tmp_path / x)
    (tmp_path / "text").write_text("huisdeur huisdeur huisdeur huisduer fietsen fietsen\nfietsen fietzen\n")
    (tmp_path / "back").write_text("huisdeur\t1000\nfietsen\t1000\n")
    main(["stats", "-o", at("a"), at("text")], spark)
    main(["mergelex", "-o", at("b"), at("a.wordfreq"), at("back")], spark)
    main(["lexstat", "-o", at("c"), "--LD", "1", at("b.merged")], spark)
    main(["anahash", "-o", at("d"), "--alph", at("c.chars"), "--artifrq", "1000", at("b.merged")], spark)
    main(["indexer", "-o", at("e"), "--hash", at("d.anagrams"), "--charconf", at("c.confusions"), "--foci", at("d.foci")], spark)
    main(["ldcalc", "-o", at("f"), "--index", at("e.index"), "--hash", at("d.anagrams"), "--clean", at("b.merged"), "--alph", at("c.chars"), "--LD", "1", "--artifrq", "1000"], spark)
    main(["rank", "-o", at("g"), "--alph", at("c.chars"), "--charconf", at("c.confusions"), "--clip", "1", at("f.ldcalc")], spark)
    main(["chain", "-o", at("h"), "--alph", at("c.chars"), at("g.ranked")], spark)
    got = {(r.variant, r["head"]) for r in formats.chained(formats.lines(spark, at("h.chained"))).collect()}
    assert got == {("fietzen", "fietsen")}


def test_streamed_vector_files(spark, tmp_path, monkeypatch):
    rows = [(f"w{i}", [float(i), -1.5, 2.0]) for i in range(50)]
    (tmp_path / "v.bin").write_bytes(b"50 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + b"\n" for w, v in rows))
    monkeypatch.setattr(formats, "READ_BYTES", 7)
    assert {n: v for n, v in formats._stored_vectors(f"file://{tmp_path}/v.bin")} == dict(rows)
    assert {r.word: list(r.vec) for r in formats.word_vectors(spark, str(tmp_path / "v.bin")).collect()} == dict(rows)


def test_xml_faults(spark):
    docs = spark.createDataFrame([(1, "<a>een</a>"), (2, "<kapot>"), (3, None)], "id int, x string")
    got = {r.id: (r.text, r.fault) for r in formats.xml_nodes(docs, "id", "x").collect()}
    assert got[1] == ("een", None) and got[2][0] is None and got[2][1] and set(got) == {1, 2}


def test_streamed_table(spark, tmp_path):
    from lexloom.streaming.word_count import read_table, to_table

    (tmp_path / "in").mkdir()
    for t in ("de de kat", "de hond"):
        spark.createDataFrame([(t,)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = to_table(stream_word_count(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), "text"), str(tmp_path / "out"), str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    assert {r.word: r.freq for r in read_table(spark, str(tmp_path / "out")).collect()} == {"de": 3, "kat": 1, "hond": 1}
