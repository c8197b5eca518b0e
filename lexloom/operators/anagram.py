"""Anagram tables, foci, and the index of word pairs whose anagram values differ by a known confusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import Scratch
from .alphabet import multisets

#: Confusions that every key may be multiplied by.
MOST_CONFUSIONS = 20_000
#: Keys of up to this number are sent to every task (16 MB); sums that a task sorts at a time.
SENT_KEYS, MEET_ROWS = 2_000_000, 1_000_000
#: Keys of a range whose foci are looked up together.
RANGE_KEYS = 250_000


def anagram_table(words: DataFrame, alphabet: dict[str, int], word: str = "word") -> DataFrame:
    """(hash, word) of the distinct words, `~` and `#` replaced by the separator. The empty text has no value."""
    w = words.select(X.filter_tilde_hash(word).alias("word")).where("word <> ''").distinct()
    return w.select(X.anagram_hash("word", alphabet).alias("hash"), "word").where("hash > 0")


def hash_list(words: DataFrame, alphabet: dict[str, int], word: str = "word") -> DataFrame:
    """(word, hash) of every row, repeated ones included."""
    return words.select(F.col(word).alias("word"), X.anagram_hash(word, alphabet).alias("hash")).where("word is not null")


def merge_background(fore: DataFrame, background: DataFrame) -> DataFrame:
    """(word, freq): the background's sums (a null frequency is 1) added to the foreground's frequencies."""
    b = background.select("word", F.coalesce(F.col("freq").cast("bigint"), F.lit(1)).alias("freq"))
    return fore.select("word", F.col("freq").cast("bigint").alias("freq")).unionByName(b).where("word is not null").groupBy("word").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


def foci(freqs: DataFrame, alphabet: dict[str, int], artifrq: int, *, parts: bool = False, separator: str = X.SEPARATOR) -> DataFrame:
    """(hash, word): the lower-cased words worth correcting: neither the word nor its lower case has the artificial
    frequency. `parts`: n-grams with such a part that is itself a word of the table."""
    f = freqs.select("word", "freq")
    lexical = f.where(F.col("freq") >= artifrq).select(F.col("word").alias("lexical"))
    weak = f.where(F.col("freq") < artifrq).join(lexical, F.lower("word") == F.col("lexical"), "left_anti")
    if parts:
        pieces = f.select("word", F.explode(X.plain_parts("word", separator)).alias("part"))
        weak = pieces.join(weak.select(F.col("word").alias("part")), "part", "left_semi").select("word").distinct()
    return weak.select(X.anagram_hash("word", alphabet).alias("hash"), F.lower("word").alias("word")).distinct()


def keys_in_band(anagrams: DataFrame, low: int = 5, high: int = 35) -> DataFrame:
    """The distinct values whose first word has `low` to `high` characters."""
    n = F.length("w")
    rows = anagrams.groupBy("hash").agg(F.min("word").alias("w"))
    return rows.where((n >= low) & (n <= high)).select("hash")


def _focus(index: DataFrame, foci_hashes: DataFrame | None) -> DataFrame:
    """Pairs with an end in the foci; without foci all pairs. An empty foci table leaves none."""
    if foci_hashes is None:
        return index
    a = foci_hashes.select(F.col("hash").alias("f")).distinct()
    low = index.join(a, F.col("hash") == F.col("f"), "left_semi")
    high = index.join(a, F.col("hash") + F.col("kwc") == F.col("f"), "left_semi")
    return low.unionByName(high).distinct()


def index_by_confusion(keys: DataFrame, confusions: DataFrame, foci_hashes: DataFrame | None = None) -> DataFrame:
    """(kwc, hash): every confusion and lower value that lead to a value of the table. An equi-join: the keys are
    multiplied by the confusions inside the tasks and looked up among the keys."""
    c = [r.kwc for r in confusions.select("kwc").distinct().limit(MOST_CONFUSIONS + 1).collect()]
    if len(c) > MOST_CONFUSIONS:
        raise ValueError("too many confusions to multiply every key by; use index_by_difference or index_by_focus")
    k = keys.select("hash").distinct()
    ahead = k.select("hash", F.explode(X.literal(sorted(c), "array<bigint>")).alias("kwc")).withColumn("up", F.col("hash") + F.col("kwc"))
    return _focus(ahead.join(k.select(F.col("hash").alias("up")), "up", "left_semi").select("kwc", "hash"), foci_hashes)


def index_by_focus(keys: DataFrame, confusions: DataFrame, foci_hashes: DataFrame) -> DataFrame:
    """The same pairs found from the foci, for any confusions. Keys are cut into ranges by value; each range of foci meets
    each range of keys that the largest confusion reaches. There every confusion is added to and taken from the sorted foci
    and looked up among the keys, or, where that is less, the foci's differences to the keys among the confusions."""
    c = np.sort(confusions.select("kwc").where("kwc > 0").distinct().toArrow()["kwc"].to_numpy())
    spark = keys.sparkSession
    if not len(c):
        return keys.select(F.lit(0).cast("bigint").alias("kwc"), "hash").where("false")
    f = foci_hashes.select(F.col("hash").alias("f")).distinct()
    marked = keys.select("hash").where("hash is not null").distinct().join(f, F.col("hash") == F.col("f"), "left")
    marked = Scratch(spark, "foci").save(marked.select("hash", F.col("f").isNotNull().alias("focus")))
    ranges = max(spark.sparkContext.defaultParallelism, marked.count() // RANGE_KEYS)
    cuts = marked.approxQuantile("hash", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    starts, widest, shared = np.unique(np.array(cuts, dtype=np.int64)), c[-1], spark.sparkContext.broadcast(c)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each key for the ranges of foci within reach (as key), each focus for the ranges of keys."""
        ends = np.append(starts, np.iinfo(np.int64).max)  # those of range i are below ends[i]
        lows = np.insert(starts, 0, np.iinfo(np.int64).min)
        # Ranges are in order, so those within reach of range i are the ones from first[i] to last[i].
        first = np.array([np.searchsorted(starts, low - widest if i else low, "right") for i, low in enumerate(lows)])
        last = np.array([np.searchsorted(starts, end + widest - 1 if i < len(starts) else end, "right") for i, end in enumerate(ends)])
        for b in batches:
            v, focus = b["hash"].to_numpy(), b["focus"].to_numpy()
            at = np.searchsorted(starts, v, "right")
            for as_key in (True, False):
                w, own, is_focus = (v, at, focus) if as_key else (v[focus], at[focus], focus[focus])
                n = last[own] - first[own] + 1
                other = np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(own, n)
                yield pd.DataFrame({"k": own if as_key else other, "f": other if as_key else own, "hash": np.repeat(w, n), "focus": np.repeat(is_focus, n), "key": as_key})

    def looked_up(b: pd.DataFrame) -> pd.DataFrame:
        at = b["key"].to_numpy()
        v = b["hash"].to_numpy()
        order = np.argsort(v[at])
        found = _from_foci(v[at][order], b["focus"].to_numpy()[at][order], np.sort(v[~at]), shared.value)
        return pd.DataFrame({"kwc": found[0], "hash": found[1]})

    tasks = max(spark.sparkContext.defaultParallelism * 2, ranges)
    cells = marked.mapInPandas(dealt, "k bigint, f bigint, hash bigint, focus boolean, key boolean").repartition(tasks, "k", "f")
    return cells.groupBy("k", "f").applyInPandas(looked_up, "kwc bigint, hash bigint")


def _from_foci(keys: np.ndarray, is_focus: np.ndarray, foci: np.ndarray, confusions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kwc, lower value) of the pairs of a focus and a key; of two foci only from the lower. `keys`, `foci` and
    `confusions` are sorted, the latter positive."""
    none = np.empty(0, dtype=np.int64)
    if not len(keys) or not len(foci):
        return none, none
    least, most = keys[0], keys[-1]
    up = np.searchsorted(foci, least - confusions), np.searchsorted(foci, most - confusions, "right")
    down = np.searchsorted(foci, least + confusions), np.searchsorted(foci, most + confusions, "right")
    band = np.searchsorted(keys, foci - confusions[-1]), np.searchsorted(keys, foci + confusions[-1], "right")
    call = 2000  # what a call costs, in values
    by_confusion = sum(int((hi - lo).sum()) + call * int((hi > lo).sum()) for lo, hi in (up, down))
    by_key = int((band[1] - band[0]).sum()) + call * len(foci)
    table = keys if by_confusion <= by_key else confusions
    bits = max(10, int(16 * len(table)).bit_length())
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    slot = lambda x: (x.astype(np.uint64) * mix >> shift).astype(np.int64)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[slot(table)] = True

    def members(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x lies in the table, and where in the table."""
        near = np.flatnonzero(seen[slot(x)])
        at = np.minimum(np.searchsorted(table, x[near]), len(table) - 1)
        hit = table[at] == x[near]
        return near[hit], at[hit]

    kwcs, lows = [none], [none]
    if by_confusion <= by_key:
        for sign, (lo, hi) in ((1, up), (-1, down)):
            for i in np.flatnonzero(hi > lo).tolist():
                mine = foci[lo[i] : hi[i]]
                near, at = members(mine + sign * confusions[i])
                if sign < 0:
                    near = near[~is_focus[at]]
                lows.append(mine[near] if sign > 0 else mine[near] - confusions[i])
                kwcs.append(np.full(len(near), confusions[i]))
    else:
        for i in np.flatnonzero(band[1] > band[0]).tolist():
            mine, flags = keys[band[0][i] : band[1][i]], is_focus[band[0][i] : band[1][i]]
            apart = mine - foci[i]
            near, _ = members(np.abs(apart))
            near = near[(apart[near] > 0) | ~flags[near]]
            kwcs.append(np.abs(apart[near]))
            lows.append(np.minimum(mine[near], foci[i]))
    return np.concatenate(kwcs), np.concatenate(lows)


def index_by_difference(keys: DataFrame, values: list[tuple[str, int]], distance: int, foci_hashes: DataFrame | None = None) -> DataFrame:
    """The same pairs for the full set of confusions of a distance, met in the middle: values v < w belong together if
    v plus a string of up to `distance` symbols equals w plus another, so each key is only multiplied by the strings
    (861 for 40 symbols and distance 2) instead of the confusions (over 300,000).

    Up to SENT_KEYS keys (counted, 8 bytes each) are sent to the tasks, each of which makes the sums of one residue class
    and needs no shuffle; more are multiplied and joined by their sums."""
    sums = sorted({v for _, _, v in multisets(values, distance)})
    k = keys.select("hash").distinct()
    held = np.array([r.hash for r in k.limit(SENT_KEYS + 1).collect()], dtype=np.int64)
    if len(held) <= SENT_KEYS:
        return _focus(_met(keys.sparkSession, held, np.array(sums, dtype=np.int64)), foci_hashes)
    # The plan can't know how much explode makes of the keys, so it must be told to shuffle; once, for both sides.
    ahead = k.select("hash", F.explode(F.transform(X.literal(sums, "array<bigint>"), lambda x: F.col("hash") + x)).alias("m")).repartition("m")
    pairs = ahead.hint("merge").join(ahead.select(F.col("hash").alias("up"), "m").hint("merge"), "m").where("hash < up")
    return _focus(pairs.select((F.col("up") - F.col("hash")).alias("kwc"), "hash").distinct(), foci_hashes)


def _met(spark: SparkSession, keys: np.ndarray, sums: np.ndarray) -> DataFrame:
    """(kwc, hash) of the keys that meet, by residue classes of the sums."""
    classes = max(1, len(keys) * len(sums) // MEET_ROWS)
    keys = keys[np.argsort(keys % classes, kind="stable")]
    starts = np.searchsorted(keys % classes, np.arange(classes + 1))
    shared = spark.sparkContext.broadcast((keys, starts, sums))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, starts, sums = shared.value
        for b in batches:
            for r in b["id"]:
                residue = (r - sums) % classes
                mine = [keys[starts[x] : starts[x + 1]] for x in residue.tolist()]
                hashes = np.concatenate(mine)
                met = hashes + np.repeat(sums, [len(x) for x in mine])
                order = np.argsort(met)
                met, hashes = met[order], hashes[order]
                found, apart = [], 1
                while len(at := np.flatnonzero(met[apart:] == met[:-apart])):
                    low, high = np.minimum(hashes[at], hashes[at + apart]), np.maximum(hashes[at], hashes[at + apart])
                    found.append(np.stack([high - low, low], axis=1))
                    apart += 1
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
                yield pd.DataFrame({"kwc": pairs[:, 0], "hash": pairs[:, 1]})

    rows = spark.range(0, classes, 1, min(classes, 8 * spark.sparkContext.defaultParallelism))
    return rows.mapInPandas(run, "kwc bigint, hash bigint").distinct()


def build_index(keys: DataFrame, values: list[tuple[str, int]], distance: int, confusions: DataFrame, foci_hashes: DataFrame | None = None) -> DataFrame:
    """The index by the cheapest of the three ways, estimated from counts: probes of the keys times the confusions, of
    the foci times the confusions or the keys within the band, or of the keys times the strings."""
    n, c = keys.count(), confusions.count()
    strings = len({v for _, _, v in multisets(values, distance)})
    cost = {"confusion": n * c if c <= MOST_CONFUSIONS else float("inf"), "difference": 2 * n * strings}
    if foci_hashes is not None:
        span = keys.agg((F.max("hash") - F.min("hash")).alias("s")).first().s or 1
        widest = confusions.agg(F.max("kwc").alias("m")).first().m or 1
        cost["focus"] = foci_hashes.count() * min(2 * c, n * min(1.0, 2 * widest / max(span, 1)))
    way = min(cost, key=cost.get)
    if way == "focus":
        return index_by_focus(keys, confusions, foci_hashes)
    if way == "confusion":
        return index_by_confusion(keys, confusions, foci_hashes)
    return index_by_difference(keys, values, distance, foci_hashes)


def confusion_stats(index: DataFrame) -> DataFrame:
    """(kwc, n): lower values of each confusion."""
    return index.groupBy("kwc").agg(F.count(F.lit(1)).alias("n"))
