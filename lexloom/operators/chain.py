"""Chains of corrections: every variant is led to the root of its candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch
from .lookup import lookup


def first_candidates(ranked: DataFrame) -> DataFrame:
    """Of each variant only its best record: the first `pos` if there is such a column, else the best score."""
    order = [F.asc("pos")] if "pos" in ranked.columns else [F.desc(F.round("score", 9)), F.asc("candidate")]
    return ranked.withColumn("_k", F.row_number().over(Window.partitionBy("variant").orderBy(*order))).where("_k = 1").drop("_k")


def drop_unknown_letters(ranked: DataFrame, letters: str) -> DataFrame:
    """Without the records whose only difference is a character that is not in the alphabet."""
    extra = X.first_foreign_char("variant", "candidate", letters[:1])
    lone = (F.col("kwc") == X.FOREIGN_CHAR) & (F.length("candidate") > F.length("variant")) & (F.length(X.remove(extra, letters)) > 0)
    return ranked.where(~F.coalesce(lone, F.lit(False)))


def roots(edges: DataFrame) -> DataFrame:
    """(word, root) for edges (word, head), one for each word: heads are followed by pointer doubling, so a chain of n
    needs log n joins. A cycle is an error."""
    scratch = Scratch(edges.sparkSession, "chain")
    at = scratch.save(edges.select("word", F.col("head").alias("root")))
    for _ in range(at.count().bit_length() + 1):  # after so many doublings every chain has ended
        up = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = scratch.save(lookup(at, "root", up, "_w").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if new.where("word = root").limit(1).count():
            raise ValueError("corrections lead in a circle")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        at = new.select("word", "root")
    raise ValueError("corrections lead in a circle")


def chain(ranked: DataFrame, alphabet: dict[str, int], *, caseless: bool = False, no_unknown: bool = False) -> DataFrame:
    """(variant, variant_freq, head, head_freq, kwc, ld): every variant with the root of its chain. Where the root is not
    the variant's own candidate, kwc is the difference of the two values."""
    best = first_candidates(ranked)
    if no_unknown:
        best = drop_unknown_letters(best, "".join(alphabet))
    best = Scratch(ranked.sparkSession, "chain").save(best.select("variant", "variant_freq", "candidate", "candidate_freq", "kwc"))
    freqs = best.select(F.col("candidate").alias("_h"), F.col("candidate_freq").alias("head_freq")).groupBy("_h").agg(F.max("head_freq").alias("head_freq"))
    led = best.join(roots(best.select(F.col("variant").alias("word"), F.col("candidate").alias("head"))), F.col("variant") == F.col("word"))
    led = lookup(Scratch(ranked.sparkSession, "chain").save(led), "root", freqs, "_h", how="inner")
    own = F.col("root") == F.col("candidate")
    kwc = F.when(own, F.col("kwc")).otherwise(F.abs(X.anagram_hash("variant", alphabet) - X.anagram_hash("root", alphabet)))
    return led.select("variant", "variant_freq", F.col("root").alias("head"), "head_freq", kwc.alias("kwc"), X.edit_distance("root", "variant", caseless).alias("ld"))


def validated_words(lexicon: DataFrame, artifrq: int = 100_000_000, caseless: bool = True) -> DataFrame:
    """(word) of the lexical frequency."""
    w = F.lower("word") if caseless else F.col("word")
    return lexicon.where(F.col("freq") >= artifrq).select(w.alias("word")).where("word is not null").distinct()


def clean_chains(chained: DataFrame, lexicon: DataFrame, *, artifrq: int = 100_000_000, low_length: int = 5, caseless: bool = True) -> DataFrame:
    """`chained` (variant, head and a unique `pos`) with `deleted`: n-grams whose unknown parts are corrected otherwise in
    shorter records.

    Unknown parts are taken by falling number of n-grams, and for each the parts of its records' heads by falling number,
    then first occurrence. A record is settled at the first such turn that it takes part in, and all that decides the
    turn are counts and positions, so every record's turn is found by joins. What is left to do in sequence is to
    remember, for each part of a head, the variant that it was settled for last: the records are sorted by that part and
    their turn and streamed, with one word held at a time. No task holds the records of a part.

    Records with a null variant or head are never deleted. An empty table gives no rows.
    """
    fold = (lambda c: F.lower(c)) if caseless else (lambda c: c)
    scratch = Scratch(chained.sparkSession, "chains")
    r = chained.where("variant is not null and head is not null").select("pos", fold(F.col("variant")).alias("v"), fold(F.col("head")).alias("h"), X.plain_parts("variant").alias("raw"))
    r = r.withColumn("vp", X.plain_parts("v")).withColumn("hp", X.plain_parts("h"))
    r = scratch.save(r.withColumn("short", (F.size("vp") > 1) & (F.length(F.array_join("vp", "")) <= low_length)))
    valid = validated_words(lexicon, artifrq, caseless).select(F.col("word").alias("_v"))
    parts = lookup(scratch.save(r.where(F.size("vp") > 1).select(F.explode("vp").alias("part"))), "part", valid, "_v", how="left_anti")
    unknown = scratch.save(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    known = unknown.select(F.col("part").alias("_u"), F.col("n").alias("pn"))

    # (part, cand, ord): the parts of heads in the order of their turns within an unknown part.
    cut = r.select("pos", "h", F.explode(F.array_distinct(X.plain_parts("v", "[_-]"))).alias("part"))
    cut = lookup(scratch.save(cut), "part", known.select("_u"), "_u", how="left_semi")
    tally = cut.select("part", "pos", F.posexplode(X.plain_parts("h", "[_-]")).alias("i", "cand")).groupBy("part", "cand").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pos", "i")).alias("at"))
    tally = scratch.save(tally.select("part", "cand", F.struct((-F.col("k")).alias("k"), "at.pos", "at.i").alias("ord")))

    # Single words: settled at the first turn whose part of a head lies in their own head.
    single = r.where(F.size("vp") == 1).select("pos", F.col("v").alias("part"), "v", "h", (F.size("hp") == 1).alias("sole"))
    single = single.join(tally.withColumnRenamed("part", "_p"), F.col("part") == F.col("_p")).where(F.col("h").contains(F.col("cand")))
    single = single.groupBy("pos", "part", "v", "h", "sole").agg(F.min("ord").alias("ord"))
    single = scratch.save(single.join(known, F.col("part") == F.col("_u")).drop("_u"))
    # For each unknown part the turns at which a single word with a single head settles it: one for each spelling at most.
    solves = single.where("sole").groupBy(F.col("part").alias("_s")).agg(F.collect_list(F.struct("ord", "pos")).alias("solves"))

    # N-grams: of each unknown part the first turn by a part of the head, and the first by a settled word before them.
    grams = r.where((F.size("vp") > 1) & ~F.col("short")).select("pos", "v", "raw", "hp", F.explode(F.array_distinct("vp")).alias("part"))
    grams = scratch.save(lookup(scratch.save(grams), "part", known, "_u", how="inner").drop("_u"))
    key = F.concat_ws("\n", "part", "cand")
    own = grams.select("pos", "part", F.explode(F.array_distinct("hp")).alias("cand")).withColumn("key", key)
    own = lookup(scratch.save(own), "key", tally.select(key.alias("_t"), "ord"), "_t", how="inner")
    own = own.groupBy("pos", "part").agg(F.min(F.struct("ord", "cand")).alias("own"))
    turns = scratch.save(grams.drop("hp").join(own, ["pos", "part"], "left"))
    turns = lookup(turns, "part", solves, "_s").drop("_s")
    before = F.filter("solves", lambda x: x["pos"] < F.col("pos"))
    inside = F.array_contains("raw", F.col("part"))
    turns = turns.withColumn("solved", F.array_min(F.transform(before, lambda x: x["ord"])))
    turns = turns.withColumn("gone", inside & F.col("solved").isNotNull() & (F.col("own").isNull() | (F.col("solved") <= F.col("own.ord"))))
    turns = turns.withColumn("strict", F.coalesce(F.exists(before, lambda x: x["ord"] == F.col("own.ord")), F.lit(False)))
    turns = turns.where(F.col("gone") | F.col("own").isNotNull())
    rank = F.struct((-F.col("pn")).alias("pn"), "part")
    first = turns.groupBy("pos").agg(F.min_by(F.struct("v", "gone", "strict", "own"), rank).alias("e"), F.min(rank).alias("rank"))
    first = scratch.save(first.select("pos", "e.*", "rank"))

    events = first.where("not gone").select(F.col("own.cand").alias("key"), "rank", "own.ord", "pos", "v", F.lit(False).alias("word"), "strict")
    events = events.unionByName(single.select(F.col("h").alias("key"), rank.alias("rank"), "ord", "pos", "v", F.lit(True).alias("word"), F.lit(False).alias("strict")))
    late = events.repartition("key").sortWithinPartitions("key", "rank", "ord", "pos").select("key", "pos", "v", "word", "strict").mapInPandas(_settle, "pos bigint")
    gone = late.unionByName(first.where("gone").select("pos")).unionByName(r.where("short").select("pos")).select(F.col("pos").alias("_g"))
    return chained.join(scratch.save(gone), F.col("pos") == F.col("_g"), "left").withColumn("deleted", F.col("_g").isNotNull()).drop("_g")


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The positions deleted, from rows sorted by key and turn; only the last settled variant of the key is held."""
    last, settled = None, None
    for b in batches:
        out = []
        for key, pos, v, word, strict in zip(b["key"], b["pos"], b["v"], b["word"], b["strict"], strict=True):
            if key != last:
                last, settled = key, None
            if not word and settled is not None and (strict or settled in v):
                out.append(pos)
            else:
                settled = v
        yield pd.DataFrame({"pos": out}, dtype="int64")
