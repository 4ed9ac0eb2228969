"""Exposure tables: frequency and contextual diversity of words in a reference corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import is_lookup_form
from lexweave.session import small_or_not

TOTAL = "[TOTAL]"


def from_tokens(tokens: DataFrame, context: str, channel: str, category: str) -> tuple[DataFrame, DataFrame]:
    """``word, count, videos, channels, category_counts`` and the one row of totals.

    Words are first counted per context, so a hot word is combined before it is shuffled.
    """
    per = tokens.groupBy(F.col("token").alias("word"), context, channel, category).agg(F.count("*").alias("c"))
    cat = per.groupBy("word", category).agg(F.sum("c").alias("c"))
    maps = cat.groupBy("word").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(category), F.col("c"))))).alias("category_counts"))
    base = per.groupBy("word").agg(F.sum("c").alias("count"), F.count_distinct(context).alias("videos"), F.count_distinct(channel).alias("channels"))
    table = base.join(maps, "word")
    totals = tokens.agg(F.count("*").alias("n_tokens"), F.count_distinct(context).alias("n_videos"), F.count_distinct(channel).alias("n_channels"), F.count_distinct("token").alias("vocabulary"))
    return table, totals


def from_records(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of valid exposure records of several feeds.

    A line delivered twice counts once; words of several lines or feeds add up; category maps
    are merged. Totals are those of the ``[TOTAL]`` lines; the vocabulary is counted before the
    filter of forms that can be looked up.
    """
    once = valid.groupBy("feed_id", "line_no", "word").agg(*(F.max(c).alias(c) for c in ("count", "videos", "channels")), F.max_by("category_counts", "line_id").alias("m"))
    words = once.filter(F.col("word") != TOTAL).withColumn("word", F.lower("word"))
    cat = words.select("word", F.explode("m").alias("k", "v")).groupBy("word", "k").agg(F.sum("v").alias("v"))
    maps = cat.groupBy("word").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("category_counts"))
    sums = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("count", "videos", "channels")))
    per_feed = once.filter(F.col("word") == TOTAL).groupBy("feed_id").agg(*(F.max(c).alias(c) for c in ("count", "videos", "channels")))
    totals = per_feed.agg(F.sum("count").alias("n_tokens"), F.sum("videos").alias("n_videos"), F.sum("channels").alias("n_channels")).crossJoin(F.broadcast(words.agg(F.count_distinct("word").alias("vocabulary"))))
    return sums.filter(is_lookup_form("word")).join(maps, "word"), totals


def filter_stats(table: DataFrame, word: str = "word") -> DataFrame:
    """What the lookup filter keeps: rows and mass."""
    ok = is_lookup_form(word)
    return table.agg(
        F.count("*").alias("rows"), F.count(F.when(ok, 1)).alias("retained"), F.count(F.when(~ok, 1)).alias("excluded"),
        F.try_divide(F.sum(F.when(ok, F.col("count")).otherwise(0)), F.sum("count")).alias("mass_ratio"),
    )


def checks(valid: DataFrame) -> DataFrame:
    """Per feed: words, repeated words, [TOTAL] lines, and whether the sums stay within the totals; one pass."""
    w = F.col("word") != TOTAL
    per = valid.groupBy("feed_id", "word").agg(F.count("*").alias("n"), F.sum("count").alias("count"), F.max("count").alias("top"))
    return per.groupBy("feed_id").agg(
        F.count(F.when(w, 1)).alias("words"), F.count(F.when(w & (F.col("n") > 1), 1)).alias("repeated_words"), F.coalesce(F.sum(F.when(~w, F.col("n"))), F.lit(0)).alias("total_lines"),
        (F.coalesce(F.sum(F.when(w, F.col("top"))), F.lit(0)) <= F.max(F.when(~w, F.col("top")))).alias("within_total"),
    )


def measures(table: DataFrame, totals: DataFrame) -> DataFrame:
    """``word`` with smoothed log frequency and log prevalence in videos and channels."""
    return table.crossJoin(F.broadcast(totals)).select(
        "word", F.log10(F.lit(1e9) * (F.col("count") + 1) / (F.col("n_tokens") + F.col("vocabulary"))).alias("zipf"),
        F.log10((F.col("videos") + 1) / (F.col("n_videos") + 2)).alias("video"), F.log10((F.col("channels") + 1) / (F.col("n_channels") + 2)).alias("channel"),
    )


def floors(totals: DataFrame) -> DataFrame:
    """The measures of a word that the table has not."""
    return totals.select(
        F.log10(F.lit(1e9) / (F.col("n_tokens") + F.col("vocabulary"))).alias("zipf_0"), F.log10(1 / (F.col("n_videos") + 2)).alias("video_0"), F.log10(1 / (F.col("n_channels") + 2)).alias("channel_0")
    )


def document_summary(tokens: DataFrame, table: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and token and type means per key; unseen words stay in the means at their floors."""
    counts = tokens.groupBy(*keys, F.col("token").alias("word")).agg(F.count("*").alias("c"))
    x = counts.join(small_or_not(measures(table, totals)), "word", "left").crossJoin(F.broadcast(floors(totals)))
    hit = F.col("zipf").isNotNull()
    out = [F.sum("c").alias("tokens"), F.count("*").alias("types"), (F.coalesce(F.sum(F.when(hit, F.col("c"))), F.lit(0)) / F.sum("c")).alias("token_coverage"), (F.count(F.when(hit, 1)) / F.count("*")).alias("type_coverage")]
    for m in ("zipf", "video", "channel"):
        v = F.coalesce(F.col(m), F.col(f"{m}_0"))
        out += [(F.sum(v * F.col("c")) / F.sum("c")).alias(f"{m}_token_mean"), F.avg(v).alias(f"{m}_type_mean")]
    return x.groupBy(*keys).agg(*out)
