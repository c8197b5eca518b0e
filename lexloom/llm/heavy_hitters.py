"""Most frequent values of a column by exact prefix refinement.

Every value has a 64-bit hash. One SQL aggregation counts the rows under each hash prefix of `step_bits` bits. The
count of a prefix bounds the count of each value below it from above, so prefixes under the current lower bound are
dropped and the others are lengthened by another `step_bits` bits, until the values themselves are counted. No pass
holds more than 2**step_bits counters for each retained prefix, whatever the number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_ROWS, Scratch

#: Bits by which a prefix grows in each pass, and the length at which the values themselves are counted.
STEP_BITS = 12
FULL_BITS = 36


def _prefix(h, bits: int):
    return F.shiftrightunsigned(h, 64 - bits)


def _restrict(rows: DataFrame, kept: DataFrame, bits: int, n_kept: int) -> DataFrame:
    """Rows under a kept prefix; the kept prefixes are broadcast only while their counted number is small."""
    side = kept.select(F.col("p").alias("_kept"))
    side = F.broadcast(side) if n_kept <= BROADCAST_ROWS else side
    return rows.join(side, _prefix(F.col("_h"), bits) == F.col("_kept"), "left_semi")


def heavy_hitters(df: DataFrame, column: str, *, min_rows: int | None = None, k: int | None = None,
                  step_bits: int = STEP_BITS, full_bits: int = FULL_BITS) -> DataFrame:
    """(value, n): the values on at least `min_rows` rows, or the `k` most frequent ones; counts are exact.

    Nulls are no values. Among values of equal count at the end of the first `k` the smaller value goes first. An empty
    table gives no rows. Other columns of `df`, whatever their names, are not read.

    For `k`, the lower bound on the kth count comes from exact counts: in each pass every prefix names one value met
    under it (a row's value, so a frequent one is likely), and the next pass counts those values exactly; the kth
    largest of these counts can't exceed the true kth count.
    """
    if (min_rows is None) == (k is None):
        raise ValueError("give either min_rows or k")
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    spark = df.sparkSession
    rows = df.select(F.col(f"`{column}`").alias("value")).where(F.col("value").isNotNull())
    rows = rows.withColumn("_h", F.xxhash64("value"))
    scratch = Scratch(spark, "heavy")
    bound = max(1, min_rows or 1)
    kept, bits, n_kept = None, 0, 0
    while bits < full_bits:
        pool = rows if kept is None else _restrict(rows, kept, bits, n_kept)
        bits = min(bits + step_bits, full_bits)
        agg = [F.count(F.lit(1)).alias("n")]
        if k is not None:
            agg.append(F.first("_h").alias("h"))
        level = scratch.save(pool.groupBy(_prefix(F.col("_h"), bits).alias("p")).agg(*agg))
        if k is not None:
            # Exact counts of the values named by the fullest prefixes: 4k values at most, so this side is bounded.
            named = [r.h for r in level.orderBy(F.desc("n"), "p").limit(4 * k).select("h").collect()]
            seen = _count_named(rows, named)
            if len(seen) >= k:
                bound = max(bound, sorted(seen, reverse=True)[k - 1])
        kept = level.where(F.col("n") >= bound)
        n_kept = kept.count()
        if n_kept == 0:
            return spark.createDataFrame([], T.StructType([T.StructField("value", rows.schema["value"].dataType), T.StructField("n", T.LongType())]))
    out = _restrict(rows, kept, bits, n_kept).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound)
    if k is not None:
        out = out.orderBy(F.desc("n"), "value").limit(k)
    return out


def _count_named(rows: DataFrame, hashes: list[int]) -> list[int]:
    """Rows of each named hash; hashes with more than one value below them are no bound and are left out."""
    if not hashes:
        return []
    got = (rows.where(F.col("_h").isin(hashes)).groupBy("_h")
           .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("lo") == F.col("hi")).collect())
    return [r.n for r in got]
