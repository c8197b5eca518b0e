"""Word vectors: nearest words, analogies, similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import Scratch
from .lookup import lookup

#: Query vectors and words of a block.
BLOCK, BATCH = 1024, 4096
#: Query vectors of up to so many bytes in all are sent to every task.
BROADCAST_BYTES = 32 << 20


def normalised(vectors: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    """(word, vec) of unit length, doubles; of a repeated word the first by value. Null words and vectors are left out."""
    v = vectors.select(F.col(word).alias("word"), F.col(vec).cast("array<double>").alias("vec")).where("word is not null and vec is not null and size(vec) > 0")
    return v.groupBy("word").agg(F.min("vec").alias("vec")).select("word", V.unit(F.col("vec")).alias("vec"))


def cosine_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine): null where a word is unknown."""
    v = normalised(vectors)
    out = pairs.select("a", "b").join(v.select(F.col("word").alias("a"), F.col("vec").alias("va")), "a", "left").join(v.select(F.col("word").alias("b"), F.col("vec").alias("vb")), "b", "left")
    return out.select("a", "b", V.dot(F.col("va"), F.col("vb")).alias("cosine"))


def pair_frequencies(pairs: DataFrame, freqs: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) with `freq_a` and `freq_b` from (word, freq[, pos]); 0 for a word that is not in the list. Of a
    repeated word the row of the largest `pos` counts, without `pos` the largest frequency."""
    last = F.max_by("freq", "pos") if "pos" in freqs.columns else F.max("freq")
    f = freqs.where("word is not null").groupBy("word").agg(last.alias("freq"))
    for c in ("a", "b"):
        pairs = lookup(pairs, c, f.select(F.col("word").alias("_w"), F.col("freq").alias(f"freq_{c}")), "_w").drop("_w")
    return pairs.na.fill(0, ["freq_a", "freq_b"])


def _query_vectors(vectors: DataFrame, queries: DataFrame, signs: list[int] | None) -> DataFrame:
    """(qid, words, q): the normalised signed sum of the words' vectors; queries with an unknown word are left out."""
    v = normalised(vectors)
    rows = queries.select("qid", "words", F.posexplode("words").alias("pos", "word")).join(v, "word")
    n = F.count(F.lit(1))
    if signs:
        factor = F.element_at(F.array(*[F.lit(float(s)) for s in signs]), F.col("pos") + 1)
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x * factor))
    g = rows.groupBy("qid", "words").agg(n.alias("n"), F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("vs")).where(F.col("n") == F.size("words"))
    total = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.col("vs")[0]["vec"], lambda acc, x: V.plus(acc, x["vec"]))
    return g.select("qid", "words", V.unit(total).alias("q"))


def _packed(rows: DataFrame, id_: str, vec: str, size: int, extra: list[str]) -> DataFrame:
    """Blocks of up to `size` rows: (block, ids, extra..., m), m being the vectors as the bytes of a matrix."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [id_, *extra]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), size):
                part = b.iloc[lo : lo + size]
                yield pd.DataFrame({**{c: [part[c].tolist()] for c in kinds}, "m": [np.vstack(part[vec].to_list()).tobytes()]})

    return rows.select(id_, *extra, vec).mapInPandas(run, ", ".join([*(f"{c} array<{k}>" for c, k in kinds.items()), "m binary"]))


def _top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, word, similarity, position) of the k most similar words above 0, the query's words excluded; at a tie of 9
    decimals the smaller word. Blocks of queries meet blocks of words by a join on the number of the query block (queries
    of up to BROADCAST_BYTES in all are sent to every task instead), and a matrix product sends on k words a query, which
    are few enough to sort by query. The plan is the same for any number of queries."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    v = scratch.save(normalised(vectors))
    asked = scratch.save(queries)
    kind, qkind = v.schema["word"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
    stats = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("cells")).first()
    blocks = -(-stats.n // BLOCK)
    if not blocks:
        return v.sparkSession.createDataFrame([], f"qid {qkind}, word {kind}, similarity double, position int")
    # As many partitions as blocks, so that few blocks are cut short.
    qs = scratch.save(_packed(asked.repartition(blocks), "qid", "q", BLOCK, ["words"]).withColumn("block", F.spark_partition_id()))
    words = _packed(v, "word", "vec", BATCH, []).select("word", F.col("m").alias("wm"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    qs = F.broadcast(qs) if 8 * stats.cells <= BROADCAST_BYTES else qs

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for names, wm, ids, own, m in zip(b["word"], b["wm"], b["qid"], b["words"], b["m"], strict=True):
                mine = np.frombuffer(wm).reshape(len(names), -1)
                sims = np.round(mine @ np.frombuffer(m).reshape(len(ids), -1).T, 12)
                out = []
                for j, qid in enumerate(ids):
                    s, apart = sims[:, j], set(own[j])
                    most = min(len(s), k + len(apart))
                    top = np.flatnonzero(s >= np.partition(s, -most)[-most])
                    out += [(qid, names[i], float(s[i])) for i in top.tolist() if s[i] > 0 and names[i] not in apart]
                yield pd.DataFrame(out, columns=["qid", "word", "similarity"])

    out = words.join(qs, "block").select("word", "wm", "qid", "words", "m").mapInPandas(near, f"qid {qkind}, word {kind}, similarity double")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "word")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest words of each query (qid, words): to the sum of its words' vectors."""
    return _top(vectors, _query_vectors(vectors, queries, None), k)


def analogies(vectors: DataFrame, queries: DataFrame, k: int = 40) -> DataFrame:
    """The k words nearest to b - a + c for each query of three words [a, b, c]; other queries give no rows."""
    return _top(vectors, _query_vectors(vectors, queries.where(F.size("words") == 3), [-1, 1, 1]), k)
