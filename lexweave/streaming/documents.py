"""Documents as a stream: measures that need one row only run as they come, the rest per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.functions import text as T
from lexweave.operators import diversity as D


def basic_columns(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_types, ttr, rttr, cttr, msttr`` without state or shuffle."""
    t = stream.select(key, T.token_array(text).alias("t")).withColumn("n", F.size("t")).withColumn("v", F.size(F.array_distinct("t")))
    n, v = F.col("n").cast("double"), F.col("v").cast("double")
    size = F.least(F.lit(50), F.col("n"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.try_divide(F.col("n"), size)).cast("int") - 1)), lambda i: F.size(F.array_distinct(F.slice("t", i * size + 1, size))) / size)
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return t.filter("n > 0").select(key, F.col("n").cast("bigint").alias("n_tokens"), F.col("v").cast("bigint").alias("n_types"), (v / n).alias("ttr"), (v / F.sqrt(n)).alias("rttr"), (v / F.sqrt(2 * n)).alias("cttr"), mean.alias("msttr"))


def profile_stream(stream: DataFrame, out: str, checkpoint: str, profile: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Each micro-batch through the batch operators, appended to parquet under its batch number, so a repeated batch replaces itself."""
    profile = profile or (lambda docs: D.panel_a(T.tokens(docs, key, text), [key]))

    def write(batch: DataFrame, number: int) -> None:
        profile(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str = "ingested_at", late: str = "1 day", size: str = "7 days", group: str = "source", text: str = "text") -> DataFrame:
    """Documents, tokens per event-time window and group; rows later than the watermark are left out by Spark."""
    rows = stream.select(F.col(time).cast("timestamp").alias("at"), F.coalesce(F.lower(F.trim(group)), F.lit("(none)")).alias("group"), F.size(T.surfaces(text)).alias("n"))
    return rows.withWatermark("at", late).groupBy(F.window("at", size), "group").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
