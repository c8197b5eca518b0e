"""Ranking the candidates of each variant by fourteen features.

A variant of ordinary size is ranked by windows over one shuffle. A variant with a large share of all records is not
gathered: its ranks come from its distinct feature values, counted in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch
from .lookup import lookup
from .vectors import nearest

FEATURES = ("freq_digits", "freq", "ld", "cls", "canon", "fl", "ll", "khc", "pairs1", "pairs2", "median", "lower_count", "cosine", "ngram_points")
#: Features ranked densely, descending but for the distance; the others have fixed ranks.
DENSE = ("freq_digits", "freq", "ld", "cls", "pairs1", "pairs2", "median", "lower_count", "ngram_points")
#: A variant with more than 1/HOT_SHARE of the records, and more than HOT_ROWS, is not gathered.
HOT_SHARE, HOT_ROWS = 64, 50_000


def confusion_counts(records: DataFrame) -> DataFrame:
    """(kwc, pairs1): records of each confusion."""
    return records.groupBy("kwc").agg(F.count(F.lit(1)).alias("pairs1"))


def integer_median(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The median of an integer column for each key, the mean of the middle two truncated. Values are counted first, so
    a hot key brings its distinct values only."""
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_to", F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    pick = lambda r: F.max(F.when((F.col("_to") >= r) & (F.col("_to") - F.col("_n") < r), F.col("_v")))
    return run.groupBy(*keys).agg(F.floor((pick(low) + pick(high)) / 2).cast("bigint").alias(name))


def complement_counts(counts: DataFrame, confusions: DataFrame, alphabet: dict[str, int]) -> DataFrame:
    """(kwc, pairs2) of the confusions of two symbols by two, `ab~cd`: the largest count of the single confusions a-c, a-d
    and b-c (the first at a tie), and the count of its complement. Confusions without any count are left out."""
    two = confusions.select("kwc", F.col("example").alias("e")).where(r"e rlike '^..~..$'").join(counts.select("kwc"), "kwc", "left_semi")
    value = F.create_map(*[F.lit(x) for ch, v in alphabet.items() for x in (ch, v)])
    sym = [F.element_at(value, F.substring("e", i, 1)) for i in (1, 2, 4, 5)]
    a, b, c, d = sym
    diffs = [F.abs(x - y) for x, y in ((a, c), (a, d), (b, c), (b, d))]
    two = two.where(F.isnotnull(a) & F.isnotnull(b) & F.isnotnull(c) & F.isnotnull(d))  # symbols of the alphabet only
    long = two.select("kwc", F.posexplode(F.array(*diffs)).alias("i", "k"))
    got = long.join(counts.select(F.col("kwc").alias("k"), F.col("pairs1").alias("n")), "k").groupBy("kwc").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    n = [F.coalesce(F.element_at("m", F.lit(i)), F.lit(0)) for i in range(4)]
    best = F.greatest(*n[:3])
    return got.where(best > 0).select("kwc", (best + F.when(n[0] == best, n[3]).when(n[1] == best, n[2]).otherwise(n[1])).alias("pairs2"))


def drop_weak_ngrams(records: DataFrame) -> DataFrame:
    """Without the records that have no n-gram evidence themselves while a part of their variant is a variant that has."""
    proven = records.where("ngram_points > 0").select(F.col("variant").alias("part")).distinct()
    pieces = records.where("ngram_points = 0").select("variant").distinct().select("variant", F.explode(X.plain_parts("variant")).alias("part"))
    weak = pieces.join(proven, "part", "left_semi").select(F.col("variant").alias("_w")).distinct()
    keep = records.where("ngram_points > 0 or ngram_points is null")
    return keep.unionByName(records.where("ngram_points = 0").join(weak, F.col("variant") == F.col("_w"), "left_anti"))


def add_features(records: DataFrame, *, counts: DataFrame, medians: DataFrame, complements: DataFrame | None = None, cosines: DataFrame | None = None, artifrq1: int = 0, artifrq2: int = 0) -> DataFrame:
    """The records with the columns of FEATURES that are not in them yet."""
    f = F.col("candidate_freq")
    r = records.withColumn("freq", F.when((f >= artifrq1) & F.lit(artifrq1 > 0), f - artifrq1).otherwise(f))
    r = r.withColumn("freq_digits", X.digits(F.when((f >= artifrq2) & F.lit(artifrq2 > 0), f - artifrq2).otherwise(f)))
    r = r.join(counts, "kwc", "left").join(medians, [c for c in medians.columns if c != "median"], "left")
    r = r.join(complements, "kwc", "left").na.fill(0, ["pairs2"]) if complements is not None else r.withColumn("pairs2", F.lit(0).cast("bigint"))
    if cosines is not None:
        r = r.join(cosines, ["variant", "candidate"], "left").na.fill(0.0, ["cosine"])
    elif "cosine" not in r.columns:
        r = r.withColumn("cosine", F.lit(0.0))
    return r


def _order(name: str) -> Column:
    return F.asc(name) if name == "ld" else F.desc(name)


def _fixed(name: str) -> Column:
    if name == "cosine":  # larger similarity is the larger rank, as the features are defined
        return F.when(F.col(name) <= 0.001, 1).otherwise(10)
    return F.when(F.col(name) == 0, 10 if name == "canon" else 2).otherwise(1)


def group_sizes(rows: DataFrame) -> tuple[list, int]:
    """The hot variants (fewer than HOT_SHARE), and the largest number of records of a variant."""
    sizes = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if total.most <= HOT_ROWS:
        return [], total.most
    return [x.variant for x in sizes.where(F.col("n") > max(HOT_ROWS, total.n // HOT_SHARE)).collect()], total.most


def feature_ranks(rows: DataFrame, hot: list | None = None) -> DataFrame:
    """`rows` with `lower_count` and the rank of every feature as `<feature>_rank`."""
    hot = group_sizes(rows)[0] if hot is None else hot
    rows = rows.withColumn("_low", F.lower("candidate"))
    w = Window.partitionBy("variant")
    cold = rows.where(~F.col("variant").isin(hot)) if hot else rows
    cold = cold.withColumn("lower_count", F.count(F.lit(1)).over(Window.partitionBy("variant", "_low")))
    cold = cold.select("*", *[F.dense_rank().over(w.orderBy(_order(c))).alias(f"{c}_rank") for c in DENSE])
    out = cold
    if hot:
        h = rows.where(F.col("variant").isin(hot))
        lower = h.groupBy("variant", "_low").agg(F.count(F.lit(1)).alias("lower_count"))
        # Written once: nine tables of distinct values are made of it, and joined to it.
        base = Scratch(rows.sparkSession, "hot").save(h.join(lower, ["variant", "_low"]))
        h = base
        for c in DENSE:
            ranks = base.select(F.col("variant").alias("_g"), F.col(c).alias("_v")).distinct().withColumn(f"{c}_rank", F.dense_rank().over(Window.partitionBy("_g").orderBy(F.asc("_v") if c == "ld" else F.desc("_v"))))
            h = h.join(ranks, (F.col("variant") == F.col("_g")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_g", "_v")
        out = cold.unionByName(h.select(*cold.columns))
    return out.select("*", *[_fixed(c).alias(f"{c}_rank") for c in FEATURES if c not in DENSE]).drop("_low")


def rank_pairs(records: DataFrame, *, confusions: DataFrame | None = None, alphabet: dict[str, int] | None = None, clip: int = 0, skip: tuple[int, ...] = (), artifrq1: int = 0, artifrq2: int = 0,
               cosines: DataFrame | None = None, local_medians: bool = False, debug: bool = False) -> DataFrame:
    """(variant, variant_freq, candidate, candidate_freq, kwc, ld, score) of the best `clip` candidates of each variant;
    0 means 1. `skip` names features to leave out by number, 1 to 14. The score is 1 less the record's share of the
    variant's ranks, and 1 for a variant's only record; at a tie of 9 decimals the smaller candidate goes first.

    A clip is cut to in parts before the records of a variant meet, up to the planner's limit for that.

    Counts and medians are over all records, the ranks over those left by `drop_weak_ngrams`. `debug` keeps all feature
    and rank columns. Records must have a variant and a candidate; a pair is there once. Without records no rows."""
    if set(skip) >= set(range(1, 15)):
        raise ValueError("all features are skipped")
    counts = confusion_counts(records)
    kept = drop_weak_ngrams(records)
    medians = integer_median(kept, ["variant", "kwc"], "candidate_freq") if local_medians else integer_median(records, ["kwc"], "candidate_freq")
    two = complement_counts(counts, confusions, alphabet) if confusions is not None and alphabet else None
    hot, most = group_sizes(kept)
    ranked = feature_ranks(add_features(kept, counts=counts, medians=medians, complements=two, cosines=cosines, artifrq1=artifrq1, artifrq2=artifrq2), hot)
    used = [F.col(f"{c}_rank") for i, c in enumerate(FEATURES, 1) if i not in skip]
    ranked = ranked.withColumn("rank_sum", sum(used[1:], used[0]))
    totals = ranked.groupBy(F.col("variant").alias("_g")).agg(F.sum("rank_sum").alias("_t"), F.count(F.lit(1)).alias("_n"))
    ranked = lookup(ranked, "variant", totals, "_g", how="inner", hot=hot).drop("_g").withColumn("score", F.when(F.col("_n") == 1, 1.0).otherwise(1 - F.col("rank_sum") / F.col("_t"))).drop("_t", "_n")
    best = ranked
    if max(clip, 1) < most:  # else all records stay, and no variant has to be sorted
        w = Window.partitionBy("variant").orderBy(F.desc(F.round("score", 9)), "candidate")
        best = ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(clip, 1)).drop("_k")
    return best if debug else best.select("variant", "variant_freq", "candidate", "candidate_freq", "kwc", "ld", "score")


def neighbour_cosines(vectors: DataFrame, records: DataFrame, k: int = 20) -> DataFrame:
    """(variant, candidate, cosine): for every pair whose candidate is among the `k` words nearest to the variant, the
    similarity of the two; as `cosines` of `rank_pairs`, where any other pair has 0. `vectors` is (word, vec)."""
    asked = records.select("variant").where("variant is not null").distinct()
    asked = asked.select(F.col("variant").alias("qid"), F.array("variant").alias("words"))
    near = nearest(vectors, asked, k).select(F.col("qid").alias("variant"), F.col("word").alias("candidate"), F.col("similarity").alias("cosine"))
    return near.join(records.select("variant", "candidate").distinct(), ["variant", "candidate"], "left_semi")


def confusion_frequencies(records: DataFrame, confusions: DataFrame) -> DataFrame:
    """(kwc, example, n): how often each confusion occurs in the records, with its example, `transposition` for 0, or
    `missing`."""
    c = confusions.select("kwc", "example")
    n = confusion_counts(records).withColumnRenamed("pairs1", "n")
    return n.join(c, "kwc", "left").select("kwc", F.coalesce("example", F.when(F.col("kwc") == 0, "transposition").otherwise("missing")).alias("example"), "n")
