"""The N first items of every group by secondary sort.

Rows are hash-partitioned by group, sorted inside the partition by score and identifier, and streamed as Arrow batches
that emit the first N items of each group; only the items already emitted for the group at hand are remembered. A group
with a large share of the rows is first split by a hash of the item, so that its parts are cut to N by many tasks, and
the survivors (N for each part) are streamed once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A group with more than 1/HOT_SHARE of the rows is split into SALT parts; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 64
SALT = 64


def _first_n(n: int, only_longer: bool):
    """Streams batches sorted by (g, score desc, item, id); items repeated in a group count once, by their first row."""
    take = n + 1 if only_longer else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None  # the first rows of the group that the last batch ended in, at most `take`

        def finish(part: pd.DataFrame) -> pd.DataFrame:
            if only_longer and len(part):
                size = part.groupby("g", sort=False)["i"].transform("size")
                part = part[size > n]
                part = part[part.groupby("g", sort=False).cumcount() < n]
            return part

        schema = None
        for batch in batches:
            schema = batch.schema
            part = batch.to_pandas()
            if held is not None:
                part = pd.concat([held, part], ignore_index=True)
            part = part[~part.duplicated(["g", "i"])]
            part = part[part.groupby("g", sort=False).cumcount() < take]
            if part.empty:
                continue
            last = (part["g"] == part["g"].iloc[-1]).to_numpy()
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held, part = part.iloc[cut:], finish(part.iloc[:cut])
            if len(part):
                yield pa.RecordBatch.from_pandas(part, schema=schema, preserve_index=False)
        if held is not None:
            part = finish(held)
            if len(part):
                yield pa.RecordBatch.from_pandas(part, schema=schema, preserve_index=False)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, row_id: str, n: int, *, only_longer: bool = False) -> DataFrame:
    """(group, item, score, row id) of the first `n` distinct items of each group by score descending, then item ascending.

    Rows with a null group, item, score or row id and NaN scores take no part. Of rows with the same group and item only
    the one of highest score, then lowest row id, takes part. `only_longer` keeps only groups with more than `n` items.
    Further columns of `df` are not read. An empty table gives no rows.
    """
    rows = (df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{row_id}`").alias("r"))
            .where("g is not null and i is not null and s is not null and r is not null and not isnan(s)"))
    order = [F.col("g"), F.desc("s"), F.col("i"), F.col("r")]
    total = rows.count()
    hot = [x.g for x in rows.groupBy("g").count().where(F.col("count") > max(10_000, total // HOT_SHARE)).collect()]
    schema = rows.schema
    cold = rows.where(~F.col("g").isin(hot)) if hot else rows
    out = cold.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_n(n, only_longer), schema)
    if hot:
        salted = rows.where(F.col("g").isin(hot)).withColumn("p", F.pmod(F.xxhash64("i"), F.lit(SALT)))
        # All rows of an item are in one part, so a part's first n + 1 items hold all of the group's first n + 1 that lie in it.
        part = salted.repartition("g", "p").sortWithinPartitions("g", "p", *order[1:])
        part = part.select("s", "i", "r", F.struct("g", "p").alias("k"))
        few = part.select(F.to_json("k").alias("g"), "i", "s", "r", F.col("k.g").alias("h"))
        few = few.mapInArrow(_first_n(n + 1, False), few.schema)
        few = few.select(F.col("h").alias("g"), "i", "s", "r")
        out = out.unionByName(few.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_n(n, only_longer), schema))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias(row_id))
