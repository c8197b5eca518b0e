"""Readers of the delimited text formats, of plain text, XML and binary vectors.

Each reader takes paths (a file, a directory or a glob; `recursive` descends) and gives a typed DataFrame. Lines that
can't be parsed are dropped, and `too_many` tells whether there were more of them than a format tolerates.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def composed(c: Column | str) -> Column:
    """Text in composed form; text of ASCII only doesn't leave the JVM's batch for nothing but the check."""
    return nfc(X.col(c))


def lines(spark: SparkSession, path: str | list[str], *, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(file, value): the lines of the files whose path matches the regular expression."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path).select(F.input_file_name().alias("file"), "value")
    return rows.where(F.col("file").rlike(pattern)) if pattern else rows


def documents(spark: SparkSession, path: str | list[str], *, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(file, text): whole files in composed form."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    rows = rows.where(F.col("file").rlike(pattern)) if pattern else rows
    return rows.withColumn("text", composed("text"))


def xml_nodes(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """(doc_id, node, text, fault): as `xml_texts`, and a row with the reason as `fault`, and null node and text, for every
    document that isn't well formed."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for b in batches:
            out = []
            for i, x in zip(b["i"], b["x"], strict=True):
                try:
                    root = ElementTree.fromstring(x)
                except (ElementTree.ParseError, ValueError) as e:
                    out.append((i, None, None, str(e)))
                    continue
                out += [(i, n, t, None) for n, t in enumerate(s for s in root.itertext() if s.strip())]
            yield pd.DataFrame(out, columns=[doc_id, "node", "text", "fault"]).astype({"node": "Int32"})

    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{xml}`").alias("x")).where("x <> ''")
    return rows.mapInPandas(run, f"`{doc_id}` {kind}, node int, text string, fault string")


def xml_texts(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """(doc_id, node, text): the text of every text node of each XML document, numbered in document order; n-grams of a
    node stay in it. Nulls and blank nodes give no rows, documents that aren't well formed are left to `xml_nodes`. No
    external entities."""
    return xml_nodes(docs, doc_id, xml).where("fault is null").drop("fault")


def too_many(rows: DataFrame, good: Column, limit: int) -> bool:
    """Whether more than `limit` rows fail the test."""
    return rows.where(~F.coalesce(good, F.lit(False))).limit(limit + 1).count() > limit


def _fields(rows: DataFrame, separator: str, keep_empty: bool = False) -> DataFrame:
    f = F.split("value", separator)
    return rows.withColumn("f", f if keep_empty else F.filter(f, lambda x: x != ""))


def _int(c: Column) -> Column:
    """The integer that a field begins with; null without one."""
    return F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("bigint")


def foreground(rows: DataFrame) -> DataFrame:
    """(word, freq, pos) of `word TAB freq[...]` lines; `pos` orders repeated words. Other lines are dropped."""
    f = _fields(rows.withColumn("value", F.trim("value")), "\t").withColumn("pos", F.monotonically_increasing_id())
    return f.where(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("word"), _int(F.get("f", F.lit(1))).alias("freq"), "pos").where("freq is not null")


def background(rows: DataFrame, artifrq: int) -> DataFrame:
    """(word, freq, pos) of `word[TAB freq]` lines; a missing frequency is the artificial one."""
    f = _fields(rows, "\t").withColumn("pos", F.monotonically_increasing_id())
    return f.where(F.size("f").isin(1, 2)).select(F.get("f", F.lit(0)).alias("word"), F.coalesce(_int(F.get("f", F.lit(1))), F.lit(artifrq)).alias("freq"), "pos")


def lexicon(rows: DataFrame) -> DataFrame:
    """(word, freq) of lines of white-space separated fields, two at least."""
    f = _fields(rows, r"\s+")
    return f.where(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("word"), _int(F.get("f", F.lit(1))).alias("freq")).where("freq is not null")


def tagged_lexicon(rows: DataFrame) -> DataFrame:
    """(word, freq) of lines of one, two or four TAB-separated columns; without a second column the frequency is 0."""
    f = _fields(rows, "\t")
    return f.where(F.size("f").isin(1, 2, 4)).select(F.get("f", F.lit(0)).alias("word"), F.coalesce(_int(F.get("f", F.lit(1))), F.lit(0)).alias("freq"))


def alphabet(rows: DataFrame, clip: int = 0) -> DataFrame:
    """(ch, freq, hash) of three-field lines that are no comments, of a frequency over `clip` or of 0."""
    f = _fields(rows.where(~F.col("value").startswith("#")), "\t").where(F.size("f") == 3)
    out = f.select(F.left(F.get("f", F.lit(0)), F.lit(1)).alias("ch"), _int(F.get("f", F.lit(1))).alias("freq"), _int(F.get("f", F.lit(2))).alias("hash"))
    return out.where((F.col("freq") > clip) | (F.col("freq") == 0))


def hemps(rows: DataFrame) -> DataFrame:
    """(word) of the lines that are no comments."""
    return rows.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.col("value").alias("word"))


def anagrams(rows: DataFrame) -> DataFrame:
    """(hash, word) of `hash~word#word` lines."""
    f = F.split("value", "~", 2)
    got = rows.where(F.col("value").contains("~")).select(F.get(f, F.lit(0)).try_cast("bigint").alias("hash"), F.explode(F.filter(F.split(F.get(f, F.lit(1)), "#"), lambda x: x != "")).alias("word"))
    return got.where("hash is not null")


def foci(rows: DataFrame) -> DataFrame:
    """(hash): the number each line begins with."""
    return rows.select(_int(F.col("value")).alias("hash")).where("hash is not null").distinct()


def confusions(rows: DataFrame) -> DataFrame:
    """(kwc, example) of `kwc#example[#example]` lines."""
    f = F.split("value", "#")
    return rows.select(F.get(f, F.lit(0)).try_cast("bigint").alias("kwc"), F.get(f, F.lit(1)).alias("example")).where("kwc is not null")


def flagged_confusions(rows: DataFrame) -> DataFrame:
    """(kwc, example) of the lines of exactly two fields."""
    return confusions(rows.where(F.size(F.split("value", "#")) == 2))


def index(rows: DataFrame) -> DataFrame:
    """(kwc, hash) of `kwc#hash,hash` lines."""
    f = F.split("value", "#")
    cut = rows.where(F.size(f) == 2).select(F.get(f, F.lit(0)).try_cast("bigint").alias("kwc"), F.explode(F.split(F.get(f, F.lit(1)), ",")).alias("h"))
    return cut.select("kwc", F.col("h").try_cast("bigint").alias("hash")).where("kwc is not null and hash is not null")


PAIR_TYPES = "variant string, variant_freq bigint, low_variant_freq bigint, candidate string, candidate_freq bigint, low_candidate_freq bigint, kwc bigint, ld int, cls int, canon int, fl int, ll int, khc int, ngram_points bigint"


def _typed(rows: DataFrame, separator: str, ddl: str, sizes: tuple[int, ...], keep_empty: bool) -> DataFrame:
    cols = [c.strip().split(" ") for c in ddl.split(",")]
    f = _fields(rows, separator, keep_empty).where(F.size("f").isin(*sizes))
    return f.select(*[F.get("f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(cols)])


def pairs(rows: DataFrame) -> DataFrame:
    """The 14 columns of `~`-separated pair lines."""
    return _typed(rows, "~", PAIR_TYPES, (14,), False)


def ranked(rows: DataFrame) -> DataFrame:
    """(variant, variant_freq, candidate, candidate_freq, kwc, ld, score) of 7 fields, or of 6 without kwc."""
    seven = _typed(rows, "#", "variant string, variant_freq bigint, candidate string, candidate_freq bigint, kwc bigint, ld int, score double", (7,), True)
    six = _typed(rows, "#", "variant string, variant_freq bigint, candidate string, candidate_freq bigint, ld int, score double", (6,), True)
    return seven.unionByName(six, allowMissingColumns=True)


def chained(rows: DataFrame) -> DataFrame:
    """(variant, variant_freq, head, head_freq, kwc, ld, flag) of 7 fields, or of 6 without kwc, in file order by `pos`."""
    rows = rows.withColumn("value", F.concat(F.monotonically_increasing_id().cast("string"), F.lit("#"), "value"))
    seven = _typed(rows, "#", "pos bigint, variant string, variant_freq bigint, head string, head_freq bigint, kwc bigint, ld int, flag string", (8,), True)
    six = _typed(rows, "#", "pos bigint, variant string, variant_freq bigint, head string, head_freq bigint, ld int, flag string", (7,), True)
    return seven.unionByName(six, allowMissingColumns=True)


#: Bytes read from a vector file at a time.
READ_BYTES = 8 << 20


def _stored_vectors(path: str) -> Iterator[tuple[str, list[float]]]:
    """The words and vectors of a binary file, read in pieces, so that its size doesn't matter."""
    import numpy as np
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        held = b""

        def more() -> bytes:
            got = f.read(READ_BYTES)
            if not got:
                raise ValueError(f"vector file ends too early: {path}")
            return bytes(got)

        while b"\n" not in held:
            held += more()
        head, _, held = held.partition(b"\n")
        n, dim = map(int, head.split())
        pos = 0
        for _ in range(n):
            while (cut := held.find(b" ", pos)) < 0 or cut + 1 + 4 * dim > len(held):
                held, pos = held[pos:] + more(), 0
            end = cut + 1 + 4 * dim
            yield held[pos:cut].decode("utf-8", "replace").lstrip("\n"), np.frombuffer(held[cut + 1 : end], dtype="<f4").tolist()
            pos = end


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of binary vector files: a header line `words dimension`, then each word, a space and its floats. Of a
    repeated word the first counts; vectors are as stored. Each file is streamed by one task, whatever its size; a file
    that is cut off is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["path"]:
                words, vecs = [], []
                for word, vec in _stored_vectors(at):
                    words.append(word)
                    vecs.append(vec)
                    if len(words) == 4096:
                        yield pd.DataFrame({"word": words, "vec": vecs})
                        words, vecs = [], []
                yield pd.DataFrame({"word": words, "vec": vecs})

    # Only the names of the files are read by Spark.
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")).orderBy("path")
    got = files.mapInPandas(run, "word string, vec array<float>").withColumn("_p", F.monotonically_increasing_id())
    return got.groupBy("word").agg(F.min_by("vec", "_p").alias("vec"))


def word_frequencies(rows: DataFrame) -> DataFrame:
    """(word, freq, pos) of lines of exactly two fields; `pos` orders repeated words."""
    f = _fields(rows, r"\s+").withColumn("pos", F.monotonically_increasing_id())
    return f.where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("word"), _int(F.get("f", F.lit(1))).alias("freq"), "pos").where("freq is not null")
