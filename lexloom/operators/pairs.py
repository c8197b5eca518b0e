"""Pairs of a variant and a correction candidate from the index, with their distance and features.

Candidates come from two equi-joins (index with the words of the lower value, then with those of the higher), anagrams
from a self-join. The edit distance with its threshold is the first filter; frequencies are looked up only for pairs that
pass it. Pairs of n-grams that differ in one part go to side tables of part pairs instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch
from .alphabet import multisets

#: Pairs of words that two values may bring before they are made by segments.
DENSE = 400
#: Shortened words that one shuffle holds at least, the parts that all of them are taken in, and those of one task.
SHORTENED, SHORTENED_PARTS, SHORTENED_TASK = 2_000_000, 16, 500_000
#: N-gram pairs that one row lists.
LISTED = 100_000

COLUMNS = ["variant", "variant_freq", "low_variant_freq", "candidate", "candidate_freq", "low_candidate_freq", "kwc", "ld", "cls", "canon", "fl", "ll", "khc", "ngram_points"]


@dataclass
class Pairs:
    """`records` in the 14 columns, `short` the pairs of short parts in the same columns, `ambiguous` (pair, ngram_pairs),
    `part_counts` (part1, part2, n) of the longer part pairs."""

    records: DataFrame
    short: DataFrame
    ambiguous: DataFrame
    part_counts: DataFrame


def low_frequencies(clean: DataFrame, artifrq: int) -> DataFrame:
    """(low, low_freq): the sum over a lower-cased word's spellings, the artificial frequency counted once."""
    f = F.col("freq")
    own = F.sum(F.when(f >= artifrq, f - artifrq).otherwise(f)) + F.when(F.max(f) >= artifrq, F.lit(artifrq)).otherwise(F.lit(0))
    return clean.groupBy(F.lower("word").alias("low")).agg(own.alias("low_freq"))


def _with_freqs(pairs: DataFrame, clean: DataFrame, low: DataFrame) -> DataFrame:
    """`pairs` (w1, w2) with f1, f2, l1, l2; 0 where unknown."""
    for n in ("1", "2"):
        pairs = pairs.join(clean.select(F.col("word").alias(f"w{n}"), F.col("freq").alias(f"f{n}")), f"w{n}", "left")
        pairs = pairs.withColumn("_k", F.lower(f"w{n}")).join(low.select(F.col("low").alias("_k"), F.col("low_freq").alias(f"l{n}")), "_k", "left").drop("_k")
    return pairs.na.fill(0, ["f1", "f2", "l1", "l2"])


def _oriented(pairs: DataFrame) -> DataFrame:
    """The end of higher lower-case frequency as w2; at a tie the one of smaller value (h1, h2), else as it is."""
    flip = (F.col("l1") > F.col("l2")) | ((F.col("l1") == F.col("l2")) & (F.col("h1") < F.col("h2")))
    return pairs.select(*[c for c in pairs.columns if c[0] not in "wfl" or c[1:] not in ("1", "2")], *[F.when(flip, F.col(f"{c}{3 - n}")).otherwise(F.col(f"{c}{n}")).alias(f"{c}{n}") for c in "wfl" for n in (1, 2)])


def _acceptable(artifrq: int, letters: str) -> Column:
    """The variant is no lexical word, but for diacritic confusions, and all letters of the candidate are in the alphabet."""
    ok = (F.col("l1") < artifrq) | F.col("diac")
    return ok & (F.length(X.remove(F.lower("w2"), letters)) == 0) if letters else ok


def _diff() -> Column:
    """The parts in which n-grams of the same number of parts differ; null for others."""
    p1, p2 = X.plain_parts("w1"), X.plain_parts("w2")
    same = (F.size(p1) == F.size(p2)) & (F.size(p1) > 1)
    return F.when(same, F.filter(F.zip_with(p1, p2, lambda a, b: F.when(F.lower(a) != F.lower(b), F.struct(a.alias("a"), b.alias("b")))), lambda x: x.isNotNull()))


def _split(pairs: DataFrame, artifrq: int, low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that stay, and the (part1, part2) of those that only differ in one part."""
    pairs = pairs.withColumn("diff", _diff())
    kept = pairs.where(F.col("diff").isNull() | (F.size("diff") == 0)).drop("diff")
    one = pairs.where(F.size("diff") == 1).select("w1", "w2", F.col("diff")[0]["a"].alias("part1"), F.col("diff")[0]["b"].alias("part2"))
    return kept, _not_lexical(one, artifrq, low)


def _not_lexical(parts: DataFrame, artifrq: int, low: DataFrame) -> DataFrame:
    lexical = low.where(F.col("low_freq") >= artifrq).select("low")
    return parts.join(lexical, F.lower("part1") == F.col("low"), "left_anti")


def _features(artifrq: int) -> list[Column]:
    a, b = F.lower("w1"), F.lower("w2")
    longer = F.greatest(F.length(a), F.length(b))
    return [
        F.col("w1").alias("variant"), F.col("f1").alias("variant_freq"), F.col("l1").alias("low_variant_freq"),
        F.col("w2").alias("candidate"), F.col("f2").alias("candidate_freq"), F.col("l2").alias("low_candidate_freq"),
        F.col("kwc"), F.col("ld"), (longer - F.col("ld")).alias("cls"), (F.col("l2") >= artifrq).cast("int").alias("canon"),
        (F.left(a, F.lit(1)) == F.left(b, F.lit(1))).cast("int").alias("fl"),
        ((F.length(a) > 1) & (F.length(b) > 1) & (F.right(a, F.lit(2)) == F.right(b, F.lit(2)))).cast("int").alias("ll"),
        F.col("khc").cast("int").alias("khc"),
    ]


def _segment(length: Column, i: Column, distance: int) -> tuple[Column, Column]:
    """(start, length) of the i-th of distance + 1 segments of a word of a length, the longer ones last. Two words within
    the distance share one of them."""
    n = distance + 1
    short = F.floor(length / n)
    first_long = n - (length - short * n)
    return (i * short + F.greatest(F.lit(0), i - first_long) + 1).cast("int"), (short + F.when(i >= first_long, 1).otherwise(0)).cast("int")


def _masked(word: Column | str) -> Column:
    """The lower-cased n-gram with each of its parts left out in turn; none for a single part. N-grams that differ in one
    part share one of these."""
    parts = F.transform(X.plain_parts(word), lambda x: F.lower(x))
    without = lambda i: F.array_join(F.transform(parts, lambda x, j: F.when(j == i, F.lit("\n")).otherwise(x)), "\n\n")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 1), without)).otherwise(F.array().cast("array<string>"))


def _joined(index: DataFrame, first: DataFrame, second: DataFrame, distance: int, excused: Column, parts: bool = False) -> DataFrame:
    """The index rows (kwc, hash, khc, diac, h2) with the words w1 of `hash` and w2 of `h2`, as h1, h2, kwc, khc, diac, w1, w2.

    Words of foreign letters fall into few values, so two values may bring millions of pairs. Where they bring more than
    DENSE, only pairs that agree in one of distance + 1 segments are made: all pairs within the distance do, the segment
    shifted by at most the distance. Pairs excused from the distance are all made. `parts`: n-grams that differ in one part
    are wanted at any distance, so those that agree in all parts but one are made, too."""
    sizes = first.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    many = index.join(sizes.withColumnRenamed("n", "n1"), "hash").join(sizes.select(F.col("hash").alias("h2"), F.col("n").alias("n2")), "h2")
    many = Scratch(index.sparkSession, "dense").save(many.withColumn("dense", (F.col("n1") * F.col("n2") > DENSE) & ~excused))
    keep = ["kwc", "khc", "diac", "hash", "h2"]
    cold = many.where("not dense").select(*keep).join(first, "hash").join(second, "h2").select(*keep, "w1", "w2").withColumnRenamed("hash", "h1")
    dense = many.where("dense").select(*keep)
    if dense.isEmpty():
        return cold

    n = F.length(F.lower("w1"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(i.alias("i"), n.alias("len"), F.substring(F.lower("w1"), *_segment(n, i, distance)).alias("piece")))
    left = dense.join(first, "hash").select("*", F.inline(pieces))

    def cut(i: Column, by: Column, shift: Column) -> Column:
        other = F.length("w2low") + by
        start, size = _segment(other, i, distance)
        at = start + shift
        return F.when((other > 0) & (at >= 1) & (at + size - 1 <= F.length("w2low")), F.struct(i.alias("i"), other.alias("len"), F.substring("w2low", at, size).alias("piece")))

    around = F.sequence(F.lit(-distance), F.lit(distance))
    cuts = F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.transform(around, lambda by: F.transform(around, lambda shift: cut(i, by, shift))))))
    wanted = second.join(dense.select("h2").distinct(), "h2").withColumn("w2low", F.lower("w2"))
    right = wanted.select("h2", "w2", F.inline(F.array_distinct(F.filter(cuts, lambda x: x.isNotNull()))))
    hot = left.join(right, ["h2", "i", "len", "piece"]).select(*keep, "w1", "w2")
    if parts:
        masked = dense.join(first, "hash").select("*", F.explode(_masked("w1")).alias("rest"))
        other = wanted.select("h2", "w2", F.explode(_masked("w2")).alias("rest"))
        hot = hot.unionByName(masked.join(other, ["h2", "rest"]).select(*keep, "w1", "w2"))
    hot = hot.distinct()
    return cold.unionByName(hot.withColumnRenamed("hash", "h1"))


NEAR = "w1 string, w2 string, kwc bigint, khc boolean, f1 bigint, f2 bigint, l1 bigint, l2 bigint, ld int, part1 string, part2 string"


def _equal_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id1, id2), id1 < id2, of the rows (key, id) of a partition that have the same key."""
    got = [(b["key"].to_numpy(), b["id"].to_numpy()) for b in batches]
    if not got:
        return
    key, ids = np.concatenate([k for k, _ in got]), np.concatenate([i for _, i in got])
    order = np.lexsort((ids, key))
    key, ids, apart = key[order], ids[order], 1
    while len(at := np.flatnonzero(key[apart:] == key[:-apart])):
        at = at[ids[at] != ids[at + apart]]
        yield pd.DataFrame({"id1": ids[at], "id2": ids[at + apart]})
        apart += 1


def _near(words: DataFrame, outside: DataFrame, artifrq: int, confusions: list[int]) -> DataFrame:
    """The pairs at distance 1 of distinct words (word, freq, hash) whose values aren't `outside` (_o) and differ by one of
    the confusions, oriented, with values, frequencies and distance, and as part1, part2 what differs where that is one part
    of n-grams (then without the rest). Words without a value only count for the frequencies.

    Lower-cased words at distance 1 are equal once at most one character of each is left out. Those texts are met by their
    length, some lengths at a time, so a shuffle holds a part of them; what they bring is checked."""
    scratch = Scratch(words.sparkSession, "near")
    f, known = F.col("freq"), F.col("hash").isNotNull()
    own = F.sum(F.when(f >= artifrq, f - artifrq).otherwise(f)) + F.when(F.max(f) >= artifrq, F.lit(artifrq)).otherwise(F.lit(0))
    forms = F.collect_list(F.when(known, F.struct(F.col("word").alias("w"), F.col("freq").alias("f"))))
    # Aggregated once, behind the shuffle: before it hardly two rows are of one word.
    lows = words.withColumn("low", F.lower("word")).repartition("low").groupBy("low").agg(F.max("hash").alias("hash"), own.alias("l"), forms.alias("forms"))
    lows = lows.where(known).join(outside, F.col("hash") == F.col("_o"), "left_anti")
    lows = scratch.save(lows.select(F.monotonically_increasing_id().alias("id"), "low", F.length("low").alias("n"), "hash", "l", "forms"))
    of = {r.n: r["count"] for r in lows.groupBy("n").count().collect()}
    size = {m: of.get(m, 0) + of.get(m + 1, 0) * (m + 1) for m in sorted({m for x in of for m in (x - 1, x)})}
    most, parts = max(SHORTENED, sum(size.values()) // SHORTENED_PARTS), []
    for m, rows in size.items():
        if parts and parts[-1][1] == m - 1 and parts[-1][2] + rows <= most:
            parts[-1] = (parts[-1][0], m, parts[-1][2] + rows)
        else:
            parts.append((m, m, rows))

    found = []
    for first, last, rows in parts:
        left_out = lows.where((F.col("n") > first) & (F.col("n") <= last + 1)).select("id", "low", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
        rest = F.concat(F.substring("low", F.lit(1), F.col("i") - 1), F.substring("low", F.col("i") + 1, F.length("low")))
        texts = left_out.select(F.xxhash64(rest).alias("key"), "id").unionByName(lows.where(F.col("n").between(first, last)).select(F.xxhash64("low").alias("key"), "id"))
        met = texts.repartition(max(words.sparkSession.sparkContext.defaultParallelism, rows // SHORTENED_TASK), "key").mapInPandas(_equal_keys, "id1 bigint, id2 bigint")
        side = lambda k: lows.where(F.col("n").between(first, last + 1)).select(*[F.col(c).alias(f"{c}{k}") for c in ("id", "low", "hash", "l", "forms")])  # noqa: E731, B023
        pairs = met.repartition("id1").distinct().join(side(1), "id1").join(side(2), "id2")
        kwc = F.abs(F.col("hash1") - F.col("hash2"))
        pairs = pairs.where(kwc.isin(confusions) & (F.levenshtein("low1", "low2", 1) == 1))
        swap = F.col("hash1") > F.col("hash2")
        ends = [F.when(swap, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for c in ("hash", "l", "forms") for k in (1, 2)]
        pairs = pairs.select(kwc.alias("kwc"), *ends).select("*", F.explode("forms1").alias("a")).select("*", F.explode("forms2").alias("b"))
        pairs = pairs.select(F.col("hash1").alias("h1"), F.col("hash2").alias("h2"), "kwc", F.lit(False).alias("khc"), F.lit(False).alias("diac"), F.col("a.w").alias("w1"), F.col("b.w").alias("w2"),
                             F.col("a.f").alias("f1"), F.col("b.f").alias("f2"), "l1", "l2", F.lit(1).alias("ld")).na.fill(0, ["f1", "f2", "l1", "l2"])
        pairs = _oriented(pairs).where(_acceptable(artifrq, "")).drop("h1", "h2").withColumn("diff", _diff())
        pairs = pairs.where(F.coalesce(F.size("diff") < 2, F.lit(True))).withColumn("one", F.get("diff", F.lit(0)))
        rest = [F.when(F.col("one").isNull(), F.col(c)).alias(c) for c in ("kwc", "khc", "f1", "f2", "l1", "l2", "ld")]
        found.append(scratch.save(pairs.select("w1", "w2", *rest, F.col("one.a").alias("part1"), F.col("one.b").alias("part2"))))
    scratch.drop(lows)
    if not found:
        return words.sparkSession.createDataFrame([], NEAR)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    return pairs


def _listed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair, ngram_pairs): the n-gram pairs of each pair of short parts, sorted; a pair of more than LISTED goes on over
    several rows."""
    cut = rows.join(sizes, "pair").withColumn("_s", F.pmod(F.xxhash64("n"), F.ceil(F.col("points") / LISTED)))
    return cut.groupBy("pair", "_s").agg(F.array_sort(F.collect_set("n")).alias("ngram_pairs")).drop("_s")


def find_near_pairs(clean: DataFrame, alphabet: dict[str, int], values: list[tuple[str, int]], *, artifrq: int, low_length: int = 5, high_length: int = 35,
                    band: tuple[int, int] = (5, 35)) -> Pairs:
    """What `find_pairs` gives at distance 1 for a vocabulary (word, freq), its anagram table, and the whole index of the
    keys in the `band` and the confusions between strings of the symbols, without making these: pairs of values grow with
    the square of a vocabulary, those of words at distance 1 don't, and each step holds one table of the words."""
    if artifrq <= 0:
        raise ValueError("artifrq must be positive")
    scratch, sums = Scratch(clean.sparkSession, "words"), {v for _, _, v in multisets(values, 1)}
    given = scratch.save(clean.select("word", "freq").where("word is not null"))
    every = scratch.save(given.groupBy("word").agg(F.max("freq").alias("freq")).withColumn("hash", X.anagram_hash("word", alphabet)))
    scratch.drop(given)
    tame = X.filter_tilde_hash("word") == F.col("word")
    # Values whose first word is outside the band: few, where those inside are nearly all.
    other = every.where(~tame).select(X.filter_tilde_hash("word").alias("word")).select("word", X.anagram_hash("word", alphabet).alias("hash"))
    first = every.where(tame).select("word", "hash").unionByName(other).groupBy("hash").agg(F.length(F.min("word")).alias("n"))
    outside = scratch.save(first.where(~F.col("n").between(*band)).select(F.col("hash").alias("_o")))

    words = every.where(_within(low_length, high_length)).select("word", "freq", F.when(tame & (F.col("hash") > 0), F.col("hash")).alias("hash"))
    clean = words.select("word", "freq")
    low = low_frequencies(clean, artifrq)
    near = _near(words, outside, artifrq, sorted({a - b for a in sums for b in sums if a > b}))
    lexical = scratch.save(low.where(F.col("low_freq") >= artifrq))
    kept, one = near.where("part1 is null").drop("part1", "part2"), near.where("part1 is not null").select("w1", "w2", "part1", "part2")
    return _pairs(kept, _not_lexical(one, artifrq, lexical), clean, low, artifrq, 1, low_length, scratch)


def _within(low_length: int, high_length: int) -> Column:
    """Whether the word is within the lengths."""
    n = F.length("word")
    return (n >= low_length if low_length else F.lit(True)) & (n <= high_length if high_length else F.lit(True))


def find_pairs(index: DataFrame, anagrams: DataFrame, clean: DataFrame, *, artifrq: int, distance: int = 2, low_length: int = 5, high_length: int = 35,
               letters: str = "", historical: DataFrame | None = None, diacritic: DataFrame | None = None, no_hld: bool = False) -> Pairs:
    """The pairs of an index (kwc, hash) over an anagram table (hash, word) and a vocabulary (word, freq).

    `artifrq` must be positive: words of that lower-case frequency are lexical, and with 0 all would be. The flags of an
    anagram pair are those of the smallest confusion that holds its value. Lower bound `low_length` also parts short from
    long n-gram parts; a bound of 0 is none. Null words are left out, repeated words count once.
    """
    if artifrq <= 0:
        raise ValueError("artifrq must be positive")
    clean = clean.where("word is not null").groupBy("word").agg(F.max("freq").alias("freq")).where(_within(low_length, high_length))
    low = low_frequencies(clean, artifrq)
    words = anagrams.select("hash", "word").distinct().join(clean.select("word"), "word", "left_semi")
    flags = index.select("kwc", "hash").distinct()
    for name, table in (("khc", historical), ("diac", diacritic)):
        if table is None:
            flags = flags.withColumn(name, F.lit(False))
        else:
            known = table.select(F.col("kwc").alias("_c")).distinct().withColumn(name, F.lit(True))
            flags = flags.join(known, F.col("kwc") == F.col("_c"), "left").drop("_c").na.fill(False, [name])

    first = words.select("hash", F.col("word").alias("w1"))
    second = words.select(F.col("hash").alias("h2"), F.col("word").alias("w2"))
    excused = F.col("khc") & F.lit(no_hld)
    near = _joined(flags.withColumn("h2", F.col("hash") + F.col("kwc")), first, second, distance, excused)
    near = near.withColumn("ld", F.levenshtein(F.lower("w1"), F.lower("w2"))).where((F.col("ld") <= distance) | excused)
    near = _oriented(_with_freqs(near, clean, low)).where(_acceptable(artifrq, letters))
    kept, parts = _split(near, artifrq, low)
    if distance >= 2:
        keys = flags.groupBy("hash").agg(F.min_by(F.struct("khc", "diac"), "kwc").alias("s")).select("hash", "s.khc", "s.diac")
        same = _joined(keys.select(F.lit(0).cast("bigint").alias("kwc"), "hash", "khc", "diac", F.col("hash").alias("h2")), first, second, 2, excused, parts=True).where("w1 < w2")
        same = _oriented(_with_freqs(same, clean, low)).where(_acceptable(artifrq, letters) & (F.col("l2") >= artifrq))
        mirrored, more = _split(same, artifrq, low)
        mirrored = mirrored.withColumn("ld", F.levenshtein(F.lower("w1"), F.lower("w2"))).where((F.col("ld") == 2) | (F.col("khc") & F.lit(no_hld)))
        kept, parts = kept.unionByName(mirrored), parts.unionByName(more)
    return _pairs(kept, parts, clean, low, artifrq, distance, low_length)


def _pairs(kept: DataFrame, parts: DataFrame, clean: DataFrame, low: DataFrame, artifrq: int, distance: int, low_length: int, scratch: Scratch | None = None) -> Pairs:
    """The tables of the pairs that stay and of the parts of the others."""
    short = F.length("part1") < low_length
    longer = parts.where(~short).groupBy("part1", "part2").agg(F.count(F.lit(1)).alias("n"))
    longer = scratch.save(longer) if scratch else longer
    caseless = longer.groupBy(F.lower("part1").alias("p1"), F.lower("part2").alias("p2")).agg(F.sum("n").alias("points"))
    evidence = longer.join(caseless, (F.lower("part1") == F.col("p1")) & (F.lower("part2") == F.col("p2"))).select("part1", "part2", "points")
    records = kept.select(*_features(artifrq)).join(evidence, (F.col("variant") == F.col("part1")) & (F.col("candidate") == F.col("part2")), "left")
    records = records.withColumn("ngram_points", F.coalesce("points", F.lit(0))).select(*COLUMNS)

    few = parts.where(short).groupBy("part1", "part2").agg(F.count(F.lit(1)).alias("points"))
    ambiguous = _listed(parts.where(short).select(F.concat("part1", F.lit("~"), "part2").alias("pair"), F.concat("w1", F.lit("~"), "w2").alias("n")), few.select(F.concat("part1", F.lit("~"), "part2").alias("pair"), "points"))
    few = few.select(F.col("part1").alias("w1"), F.col("part2").alias("w2"), "points").withColumn("ld", F.levenshtein(F.lower("w1"), F.lower("w2"))).where(F.col("ld") <= distance)
    few = _with_freqs(few, clean, low).withColumn("kwc", F.lit(0).cast("bigint")).withColumn("khc", F.lit(False))
    return Pairs(records, few.select(*_features(artifrq), F.col("points").alias("ngram_points")), ambiguous, longer)
