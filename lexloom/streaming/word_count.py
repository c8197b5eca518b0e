"""Word frequencies of a stream of texts: append-only sums, the same as the batch count of all texts so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def stream_word_count(texts: DataFrame, text: str, n: int = 1, *, lower: bool = False, separator: str = X.SEPARATOR) -> DataFrame:
    """(word, freq) of the n-grams of a streaming DataFrame's texts, for the output modes `complete` and `update`. State
    is one counter a distinct n-gram."""
    t = F.lower(text) if lower else F.col(text)
    return texts.select(F.explode(X.ngrams(X.tokens(t), n, separator)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def windowed_word_count(texts: DataFrame, text: str, time: str, *, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, word, freq) by event time; rows later than `late` behind the newest are dropped and windows before that
    are final, so state is bounded. For the output mode `append`."""
    rows = texts.select(time, text).withWatermark(time, late).select(F.col(time), F.explode(X.tokens(text)).alias("word"))
    return rows.groupBy(F.window(time, window), "word").agg(F.count(F.lit(1)).alias("freq")).select(F.col("window.start").alias("start"), "word", "freq")


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed counters to `path/batch=<number>`; a batch that is run again replaces its own folder, so
    nothing counts twice. `read_table` gives the newest counter of each word."""
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq): the counters that `to_table` wrote, as of the last whole batch."""
    rows = spark.read.schema("word string, freq bigint, batch bigint").parquet(path)
    return rows.groupBy("word").agg(F.max_by("freq", "batch").alias("freq"))
