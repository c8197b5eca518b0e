"""One ranking from several scores of different scales.

Each score is standardised by its median and median absolute deviation over all rows, squashed by the logistic function,
so that outliers stay within (0, 1), and the bounded values are joined by a weighted geometric mean. Medians are exact:
the range of each score's finite values is narrowed by histograms until the bin that holds the median holds one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Bins of a narrowing pass.
BINS = 1024
#: Makes the median absolute deviation of a normal distribution its standard deviation; the second is for the mean one.
MAD_SCALE, MEAN_SCALE = 1.4826, 1.2533


@dataclass(frozen=True)
class Score:
    """A score column; `weight` must be positive, `high` tells whether large values are good."""

    column: str
    weight: float = 1.0
    high: bool = True


def lower_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The lower median (the value of rank ceil(n / 2)) of each numeric column over its finite values; nulls, NaN and
    infinities don't count; null for a column without values. All columns are narrowed in the same passes; a pass sends at
    most BINS rows a column to the driver. The least and the greatest value of a range never share a bin, so ranges shrink
    until the median's bin holds one value."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    x = df.select(*[F.when(finite(c), F.col(c)).alias(c) for c in columns])
    first = x.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    out: dict[str, float | None] = {}
    todo = {}
    for c in columns:
        n, lo, hi = first[f"{c}_n"], first[f"{c}_lo"], first[f"{c}_hi"]
        if not n or lo == hi:
            out[c] = lo
        else:
            todo[c] = ((n + 1) // 2, lo, hi)
    while todo:
        # Halved, so that a range can't overflow.
        share = lambda c, lo, hi: (F.col(c) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        bin_ = lambda c, lo, hi: F.when(F.col(c) == hi, BINS - 1).when(F.col(c) == lo, 0).otherwise(F.least(F.greatest(F.floor(share(c, lo, hi) * BINS), F.lit(0)), F.lit(BINS - 1)))
        pairs = [F.struct(F.lit(c).alias("c"), F.when(F.col(c).between(lo, hi), bin_(c, lo, hi)).alias("b"), F.col(c).alias("v")) for c, (_, lo, hi) in todo.items()]
        got = x.select(F.explode(F.array(*pairs)).alias("p")).where("p.b is not null").groupBy("p.c", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi")).collect()
        for c in list(todo):
            rank = todo.pop(c)[0]
            for r in sorted((r for r in got if r.c == c), key=lambda r: r.b):
                if rank <= r.n:
                    # Two values are told apart by their rank: the smaller is the bin's least.
                    if r.lo == r.hi or r.n == 1 or rank == 1:
                        out[c] = r.lo
                    elif rank == r.n:
                        out[c] = r.hi
                    else:
                        todo[c] = (rank, r.lo, r.hi)
                    break
                rank -= r.n
    return out


def fused(df: DataFrame, scores: list[Score]) -> Column:
    """The fused score in (0, 1) as a column over `df`.

    A null or NaN score takes no part, the other weights count in full; a row without any score has null. A score that
    is the same in all rows gives one half. Infinite scores squash to the bounds; they don't count for the medians.
    """
    names = [s.column for s in scores]
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    mid = {c: v or 0.0 for c, v in lower_medians(x, names).items()}
    away = lower_medians(x.select(*[F.abs(F.col(c) - F.lit(mid[c])).alias(c) for c in names]), names)
    flat = [c for c in names if not away[c]]
    if flat:  # more than half of the rows have the median: the mean deviation tells the others apart
        finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
        mean = x.agg(*[F.avg(F.when(finite(c), F.abs(F.col(c) - F.lit(mid[c])))).alias(c) for c in flat]).first()
    terms, weights = [], []
    for s in scores:
        width = MAD_SCALE * away[s.column] if away[s.column] else MEAN_SCALE * (mean[s.column] or 0.0)
        v = F.col(f"`{s.column}`").cast("double")
        v = F.when(~F.isnan(v), v)
        z = F.when(F.abs(v) == F.lit(float("inf")), v).otherwise((v - mid[s.column]) / width if width else v * 0.0)
        # ln(1 / (1 + exp(-z))) without overflow; kept away from minus infinity.
        z = F.greatest(F.least(z if s.high else -z, F.lit(700.0)), F.lit(-700.0))
        terms.append(F.coalesce(-F.log1p(F.exp(-z)) * s.weight, F.lit(0.0)))
        weights.append(F.when(v.isNotNull(), F.lit(s.weight)).otherwise(F.lit(0.0)))
    if not terms:
        return F.lit(None).cast("double")
    total = sum(weights[1:], weights[0])
    return F.when(total > 0, F.exp(sum(terms[1:], terms[0]) / total))


def fused_ranking(df: DataFrame, group: str, item: str, scores: list[Score]) -> DataFrame:
    """(group, item, score, position): each group's distinct items by fused score descending, then item.

    Rows with a null group or item, and rows without any score, take no part in the order (they do in the medians). Of
    repeated items of a group the best score counts. Scores equal to 12 decimals tie. An empty table gives no rows;
    further columns are not read.

    A group may hold any share of the rows: the order is found by a range partition of (group, score, item), whose parts
    are numbered for themselves and then moved by the rows of the group in earlier parts.
    """
    spark = df.sparkSession
    value = F.round(fused(df, scores), 12)
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), value.alias("s")).where("g is not null and i is not null and s is not null")
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    # Written once: the borders of the range partition are then the same for all that follows.
    parts = Scratch(spark, "fusion").save(best.repartitionByRange("g", F.desc("s"), "i").withColumn("p", F.spark_partition_id()))
    sizes = parts.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("g").alias("_g"), F.col("p").alias("_p"), (F.sum("n").over(Window.partitionBy("g").orderBy("p")) - F.col("n")).alias("b"))
    # Only groups that reach into another part need moving; there is at most one such group for each border.
    before = before.where("b > 0")
    local = parts.withColumn("k", F.row_number().over(Window.partitionBy("g", "p").orderBy(F.desc("s"), "i")))
    moved = local.join(before, (F.col("g") == F.col("_g")) & (F.col("p") == F.col("_p")), "left")
    return moved.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias("score"), (F.col("k") + F.coalesce("b", F.lit(0))).alias("position"))
