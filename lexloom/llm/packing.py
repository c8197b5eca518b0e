"""Filling containers of fixed capacity with texts measured in tokens.

1. Texts larger than a container are cut into full containers and a rest; everything else stays whole.
2. The items are spread over parts of bounded size, and each part is packed by best-fit decreasing.
3. Dual feasible functions bound the number of containers that any packing of a part needs from below. A part that meets
   its bound is certified and final.
4. In the other parts full containers stay, and the items of containers with room are exchanged between the parts and
   packed again by best-fit decreasing, in rounds, as long as that saves containers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Items of a part (the parts' sizes vary with the hash), and rounds of exchange.
PART_ITEMS, ROUNDS = 20_000, 5
#: Default rank file, of a public byte-level BPE, and its pattern of pieces (fixed value of the vocabulary).
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str | bytes):
    """The tokenizer of a rank file, or of its content."""
    import tiktoken

    if isinstance(ranks, str):
        with open(ranks, "rb") as f:
            ranks = f.read()
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have none. Whole texts are counted. `ranks` is a rank file
    that the driver can read (a megabyte); its content is sent to the executors."""
    kind = docs.schema[doc_id].dataType.simpleString()
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shared.value)
        for b in batches:
            yield pd.DataFrame({doc_id: b["i"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    return docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).mapInPandas(run, f"`{doc_id}` {kind}, tokens bigint")


def lower_bound(counts: np.ndarray) -> int:
    """Containers that any packing needs; counts[s] items of size s, capacity len(counts) - 1.

    The largest of the bounds by the dual feasible functions: the identity, the threshold functions (large items raised
    to the capacity, items under the threshold left out), and the rounding functions of 2 to 32 steps."""
    cap = len(counts) - 1
    size = np.arange(cap + 1)
    total = int((size * counts).sum())
    best = -(-total // cap)
    upto, mass = np.cumsum(counts), np.cumsum(size * counts)
    half = cap // 2
    for k in range(half + 1):
        huge = upto[cap] - upto[cap - k]
        large, large_mass = upto[cap - k] - upto[half], mass[cap - k] - mass[half]
        small_mass = mass[half] - (mass[k - 1] if k else 0)
        best = max(best, int(huge + large + max(0, -(-(small_mass - (large * cap - large_mass)) // cap))))
    for k in range(1, 32):
        scaled = size * (k + 1)
        exact = scaled % cap == 0
        # In units of 1 / (k * cap), so the sum is exact.
        value = np.where(exact, size * k, (scaled // cap) * cap)
        best = max(best, -(-int((value * counts).sum()) // (k * cap)))
    return best


def best_fit_decreasing(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item (0 < size <= cap) and each container's room left. Sizes must be in descending order."""
    rooms: list[list[int]] = [[] for _ in range(cap + 1)]
    open_, n = 0, 0  # bit r of open_: a container with room r exists
    at = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = open_ >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, b = cap, n
            n += 1
        left = room - s
        at[i] = b
        rooms[left].append(b)
        open_ |= 1 << left
    room_of = np.empty(n, dtype=np.int64)
    for r, bins in enumerate(rooms):
        room_of[bins] = r
    return at, room_of


def _pack(cap: int, round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "i", "k"], ascending=[False, True, True], kind="stable")
        at, room = best_fit_decreasing(pdf["s"].to_numpy(), cap)
        certified = len(room) == lower_bound(np.bincount(pdf["s"].to_numpy(), minlength=cap + 1))
        pdf["c"] = [f"{round_}-{p}-{b}" for p, b in zip(pdf["p"], at, strict=True)]
        pdf["open"] = (not certified) & (room[at] > 0)
        return pdf[["i", "k", "s", "c", "open"]]

    return run


def pack(sizes: DataFrame, item: str, size: str, capacity: int, *, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(item, piece, size, container): every item's pieces and their containers of `capacity`.

    An item larger than the capacity has its full pieces (numbered from 0) in containers of their own and the rest packed
    like other items; any other item is one piece, numbered 0. An item of size 0 or null has one piece of size 0 and a
    null container. Items must be unique and not null. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    kind = sizes.schema[item].dataType.simpleString()
    rows = sizes.select(F.col(f"`{item}`").alias("i"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("s"))
    full = F.floor(F.col("s") / capacity)
    cut = rows.where(f"s >= {capacity}").select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("k")).select("i", "k", F.lit(capacity).cast("bigint").alias("s"), F.concat(F.lit("full-"), F.col("i").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("c"))
    none = rows.where("s = 0").select("i", F.lit(0).cast("bigint").alias("k"), "s", F.lit(None).cast("string").alias("c"))
    rest = rows.select("i", full.alias("k"), F.expr(f"s % {capacity}").alias("s")).where("s > 0")
    schema = f"i {kind}, k bigint, s bigint, c string, open boolean"
    done = [cut, none]
    items, n, bins = rest, rest.count(), None
    for r in range(rounds + 1 if n else 0):
        parts = max(1, -(-n // part_items))
        placed = scratch.save(items.withColumn("p", F.pmod(F.xxhash64("i", "k", F.lit(r)), F.lit(parts))).select("i", "k", "s", "p").groupBy("p").applyInPandas(_pack(capacity, r), schema))
        total = placed.agg(F.countDistinct("c").alias("n")).first().n
        if bins is not None and total >= bins:
            break  # the exchange saved nothing: the packing before it stands
        if bins is not None:
            done.pop()
        done.append(placed.where("not open").drop("open"))
        items = placed.where("open")
        state = items.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c").alias("bins")).first()
        n, bins = state.n, state.bins
        if not n:
            break
        done.append(items.drop("open"))
        if parts == 1:
            break  # no other part to exchange with
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("i").alias(item), F.col("k").alias("piece"), F.col("s").alias(size), F.col("c").alias("container"))


def bound_of(sizes: DataFrame, size: str, capacity: int) -> int:
    """Containers that any packing of the whole table needs, from the counts of its sizes (at most `capacity` rows)."""
    s = F.col(f"`{size}`")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    full = 0
    for r in sizes.select(F.expr(f"`{size}` % {capacity}").alias("s"), F.floor(s / capacity).alias("f")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).collect():
        full += r.f or 0
        if r.s:
            counts[r.s] = r.n
    return full + lower_bound(counts)
