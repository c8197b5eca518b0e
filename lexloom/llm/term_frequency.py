"""Occurrence and record counts of every distinct term by burst-trie counting.

1. Routing. One SQL aggregation estimates the distinct terms under each prefix; a prefix with more than LEAF_TERMS terms
   bursts into longer prefixes, which are counted in turn. The burst prefixes are few (at each length one for LEAF_TERMS
   terms at most) and go to every task.
2. Accumulation. Each task adds its rows to a burst trie: the prefixes lead to containers, which hold the rest of each term
   with its two counters. Equal terms of an Arrow batch are added up before they go in. A hot term is a single entry of a
   task, so its rows never travel. A full trie is emitted as compact subtrees: the rests in sorted order, each as the length
   of the part shared with the one before and what follows, with the counters.
3. Merging. Subtrees of one prefix meet in one task and are merged one after another, like sizes with like; where many
   tasks bring subtrees, their merging is first spread over several tasks for each prefix. No task holds more than the
   terms of one prefix, which don't grow with the data.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: A prefix bursts when it holds more than this number of distinct terms, as estimated.
LEAF_TERMS = 50_000
#: Characters by which the routing looks ahead in one pass.
LOOK = 4
#: Distinct terms that a task's trie holds before it is emitted.
TRIE_TERMS = 400_000
#: Tasks whose subtrees of one prefix are merged by a single task.
FAN_IN = 64


def routing(terms: DataFrame, cap: int = LEAF_TERMS) -> list[str]:
    """The burst prefixes: those with more than `cap` distinct terms, all their shorter prefixes included."""
    total = terms.agg(F.approx_count_distinct("term").alias("n")).first().n or 0
    burst: list[str] = []
    front, depth = None, 0
    while total > cap:
        pool = terms.where(F.length("term") > depth)
        if front is not None:
            pool = pool.where(F.substring("term", 1, depth).isin(front))
        ends = pool.groupBy(F.substring("term", 1, depth + LOOK).alias("p")).agg(F.approx_count_distinct("term").alias("n"))
        # Each length's prefixes over the cap; at most total / cap for each length.
        sums = ends.select(F.explode(F.sequence(F.lit(depth + 1), F.lit(depth + LOOK))).alias("len"), "p", "n")
        full = (sums.where(F.col("len") <= F.length("p")).groupBy("len", F.expr("substring(p, 1, len)").alias("p")).agg(F.sum("n").alias("n")).where(F.col("n") > cap).collect())
        burst += [r.p for r in full]
        front = [r.p for r in full if r.len == depth + LOOK]
        depth += LOOK
        if not front:
            break
    return sorted(burst)


def leaf_of(term: str, burst: frozenset[str]) -> str:
    """The shortest prefix of the term that has not burst (the whole term where all have)."""
    n = 1
    while n < len(term) and term[:n] in burst:
        n += 1
    return term[:n]


def pack(terms: list[str], occ: list[int], rec: list[int]) -> bytes:
    """A compact trie: sorted terms as (length shared with the one before, rest), and their counters."""
    shared, rest, before = [], [], ""
    for t in terms:
        n, most = 0, min(len(t), len(before))
        while n < most and t[n] == before[n]:
            n += 1
        shared.append(n)
        rest.append(t[n:])
        before = t
    batch = pa.record_batch([pa.array(shared, pa.int32()), pa.array(rest, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["s", "t", "o", "r"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack(blob: bytes) -> tuple[list[str], list[int], list[int]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    table = pa.ipc.open_stream(data).read_all()
    terms, before = [], ""
    for n, t in zip(table["s"].to_pylist(), table["t"].to_pylist(), strict=True):
        before = before[:n] + t
        terms.append(before)
    return terms, table["o"].to_pylist(), table["r"].to_pylist()


def merge(a: tuple, b: tuple) -> tuple[list[str], list[int], list[int]]:
    """Two sorted subtrees into one; counters of equal terms are added."""
    terms, occ, rec = [], [], []
    for t, o, r in heapq.merge(zip(*a, strict=True), zip(*b, strict=True)):
        if terms and terms[-1] == t:
            occ[-1] += o
            rec[-1] += r
        else:
            terms.append(t)
            occ.append(o)
            rec.append(r)
    return terms, occ, rec


class BurstTrie:
    """Prefixes lead to containers of the rests of the terms, each with its occurrences and records."""

    def __init__(self, burst: frozenset[str]):
        self.burst = burst
        self.containers: dict[str, dict[str, list[int]]] = {}
        self.size = 0

    def add(self, terms: list[str], occ: list[int], rec: list[int]) -> None:
        burst, containers = self.burst, self.containers
        for term, o, r in zip(terms, occ, rec, strict=True):
            n, most = 1, len(term)
            while n < most and term[:n] in burst:
                n += 1
            held = containers.get(term[:n])
            if held is None:
                held = containers[term[:n]] = {}
            counters = held.get(term[n:])
            if counters is None:
                held[term[n:]] = [o, r]
                self.size += 1
            else:
                counters[0] += o
                counters[1] += r

    def subtrees(self) -> Iterator[tuple[str, bytes]]:
        """Each prefix with its packed subtree. The trie is empty afterwards."""
        for prefix, held in self.containers.items():
            rests = sorted(held)
            yield prefix, pack(rests, [held[x][0] for x in rests], [held[x][1] for x in rests])
        self.containers, self.size = {}, 0


def _accumulate(burst: list[str], most: int):
    inner = frozenset(burst)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(inner)
        task = TaskContext.get().partitionId()

        def emit() -> pa.RecordBatch:
            out = list(trie.subtrees())
            return pa.record_batch([pa.array([p for p, _ in out], pa.string()), pa.array([task] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["leaf", "task", "subtree"])

        for b in batches:
            t = pa.table({"term": b["term"].cast(pa.string()), "occ": pc.fill_null(b["occ"], 0), "rec": b["rec"]}).group_by("term").aggregate([("occ", "sum"), ("rec", "sum")])
            trie.add(t["term"].to_pylist(), t["occ_sum"].to_pylist(), t["rec_sum"].to_pylist())
            if trie.size >= most:
                yield emit()
        if trie.size:
            yield emit()

    return run


def _merge_leaves(packed: bool):
    """Merges the neighbouring subtrees of each prefix: into one packed subtree again, or into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, task, parts = None, 0, []

        def done() -> pa.RecordBatch:
            while len(parts) > 1:  # pairwise, smallest first
                parts.sort(key=lambda x: len(x[0]))
                parts.append(merge(parts.pop(0), parts.pop(0)))
            t, o, r = parts[0]
            if packed:
                return pa.record_batch([pa.array([leaf], pa.string()), pa.array([task], pa.int32()), pa.array([pack(t, o, r)], pa.binary())], ["leaf", "task", "subtree"])
            return pa.record_batch([pa.array([leaf + x for x in t], pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])

        for b in batches:
            for name, number, blob in zip(b["leaf"].to_pylist(), b["task"].to_pylist(), b["subtree"].to_pylist(), strict=True):
                if leaf is not None and name != leaf:
                    yield done()
                    parts = []
                leaf, task = name, number
                parts.append(unpack(blob))
                while len(parts) > 1 and 2 * len(parts[-1][0]) >= len(parts[-2][0]):  # like with like: each term is merged log times
                    parts.append(merge(parts.pop(), parts.pop()))
        if parts:
            yield done()

    return run


def term_frequency(counts: DataFrame, term: str, occurrences: str, *, leaf_terms: int = LEAF_TERMS, trie_terms: int = TRIE_TERMS) -> DataFrame:
    """(term, occurrences, records) from rows that are distinct records of a term: `records` counts the rows of a term,
    `occurrences` sums the column (null counts 0). Null terms are left out; the empty text is a term; an empty table
    gives no rows; further columns are not read."""
    rows = counts.select(F.col(f"`{term}`").alias("term"), F.col(f"`{occurrences}`").cast("bigint").alias("occ"), F.lit(1).cast("bigint").alias("rec")).where(F.col("term").isNotNull())
    burst = routing(rows.select("term"), leaf_terms)
    schema = "leaf string, task int, subtree binary"
    tries = rows.mapInArrow(_accumulate(burst, trie_terms), schema)
    fan = tries.rdd.getNumPartitions() // FAN_IN
    while fan > 1:
        tries = tries.withColumn("task", F.pmod("task", F.lit(fan))).repartition("leaf", "task").sortWithinPartitions("leaf", "task").mapInArrow(_merge_leaves(True), schema)
        fan //= FAN_IN
    return tries.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_merge_leaves(False), "term string, occurrences bigint, records bigint")


def marked_terms(lines: DataFrame, record: str, line: str, term: str, occurrences: str, *, rare: int = 2, common: float = 0.6, scratch=None) -> DataFrame:
    """(term, occurrences, records, mark): counts over records (lists) whose lines may have been loaded more than once.

    Rows with the same record and line count once (the smallest term and count of them, should they differ); a null
    term is left out, a null count is 0. Null records or lines are values of their own. `mark` is `rare` for at most
    `rare` occurrences, else `common` in at least the share `common` of all distinct records of the table, else null.
    """
    rows = lines.select(F.col(f"`{record}`").alias("rid"), F.col(f"`{line}`").alias("ln"), F.col(f"`{term}`").alias("term"), F.coalesce(F.col(f"`{occurrences}`").cast("bigint"), F.lit(0)).alias("occ"))
    total = rows.agg(F.countDistinct("rid").alias("n")).first().n
    once = rows.groupBy("rid", "ln").agg(F.min(F.struct("term", "occ")).alias("v")).where("v.term is not null")
    by_record = once.groupBy("rid", F.col("v.term").alias("term")).agg(F.sum("v.occ").alias("occ"))
    if scratch is not None:
        by_record = scratch.save(by_record.select("term", "occ"))
    counts = term_frequency(by_record, "term", "occ")
    mark = F.when(F.col("occurrences") <= rare, "rare").when(F.col("records") >= F.lit(math.ceil(common * total - 1e-9)), "common")
    return counts.withColumn("mark", mark)
