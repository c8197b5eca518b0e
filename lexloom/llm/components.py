"""Connected components of pairwise matches by deterministic Boruvka hooking.

In each round every component selects its smallest outgoing edge, the selected edges form trees, pointer doubling
collapses each tree onto its root, and the edges are relabelled by the roots and deduplicated. Every component that
still has an edge at least halves in number, so the rounds are logarithmic in the number of records.

Edges are ordered by (smaller end, larger end). The smallest outgoing edge of a component then leads to its smallest
neighbour, and the only cycles are mutual choices of two components, whose smaller one becomes the root. Along a path
of choices the label two steps ahead never grows, so the root is the smallest label of its tree; by induction the final
label of a group is its smallest record, with no further pass.

Hot records: choices are made by a partially aggregated minimum, and lookups go through `lookup`, which takes the keys
holding a large share of the rows out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.lookup import hot_keys, lookup as any_lookup  # noqa: F401
from ..session import Scratch

#: Pointer doubling and rounds are logarithmic; beyond this something is broken.
MAX_STEPS = 64


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """A lookup in a table of records, which is joined by merging: it grows with the data, so the planner is not to broadcast
    it while it happens to be small."""
    return any_lookup(left, key, right.hint("merge"), right_key)


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(group_id, member): one row for each distinct record in `pairs`; group_id is the group's smallest member.

    Rows with a null end are left out. A record that is only paired with itself forms its own group. Repeated and
    reversed pairs and further columns change nothing; an empty table gives no rows. Members keep the type of the columns.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    raw = pairs.select(a.alias("x"), b.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    base = scratch.save(raw.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    edges = base.where("x <> y")
    forests: list[DataFrame] = []
    for _ in range(MAX_STEPS):
        if edges.isEmpty():
            break
        roots = _collapse(scratch, _choose(edges))
        forests.append(roots)
        ends = _relabel(edges, roots)
        smaller = scratch.save(ends)
        scratch.drop(edges)
        edges = smaller
    else:
        raise RuntimeError("components did not settle")
    final = None
    for roots in reversed(forests):
        if final is None:
            final = roots
            continue
        up = final.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        final = scratch.save(lookup(roots, "root", up, "_n").select("node", F.coalesce("_r", "root").alias("root")))
    alone = base.where("x = y").select(F.col("x").alias("node"))
    if final is None:
        return alone.select(F.col("node").alias("group_id"), F.col("node").alias("member"))
    alone = alone.join(final.select("node"), "node", "left_anti")
    return final.select(F.col("root").alias("group_id"), F.col("node").alias("member")).unionByName(
        alone.select(F.col("node").alias("group_id"), F.col("node").alias("member")))


def _choose(edges: DataFrame) -> DataFrame:
    """(node, root): the end of each node's smallest outgoing edge; the smaller end of a mutual choice is a root.

    The smallest edge of a node leads to its smallest neighbour. A node without a smaller neighbour has a mutual choice
    exactly if its smallest neighbour has no smaller neighbour than the node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("to")), F.struct(F.col("y").alias("node"), F.col("x").alias("to")))).alias("e"))
    return ends.groupBy("e.node").agg(F.min("e.to").alias("root"))


def _collapse(scratch: Scratch, chosen: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its root; roots point at themselves."""
    at = scratch.save(chosen)
    # Cut each mutual choice at its smaller end.
    back = at.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    joined = lookup(at, "root", back, "_n")
    at2 = scratch.save(joined.select("node", F.when((F.col("_r") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node"))
                                     .when((F.col("_r") == F.col("node")), F.col("root")).otherwise(F.col("root")).alias("root"),
                                     (F.col("_r") == F.col("node")).alias("done")))
    scratch.drop(at)
    at = at2
    for _ in range(MAX_STEPS):
        if at.where("not done").isEmpty():
            return at.select("node", "root")
        back = at.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("done").alias("_d"))
        open_ = lookup(at.where("not done"), "root", back, "_n")
        # A pointer to a finished node takes that node's root and is finished too.
        step = open_.select("node", F.col("_r").alias("root"), F.col("_d").alias("done"))
        new = scratch.save(at.where("done").unionByName(step))
        scratch.drop(at)
        at = new
    raise RuntimeError("pointer doubling did not settle")


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    one = roots.select(F.col("node").alias("_n1"), F.col("root").alias("_r1"))
    two = roots.select(F.col("node").alias("_n2"), F.col("root").alias("_r2"))
    e = lookup(edges, "x", one, "_n1").select("_r1", "y")
    e = lookup(e, "y", two, "_n2").select(F.least("_r1", "_r2").alias("x"), F.greatest("_r1", "_r2").alias("y"))
    return e.where("x <> y").distinct()
