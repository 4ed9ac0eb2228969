"""Dictionary-graph metrics: polysemy and hypernym depth.

``nodes(synset, pos)``, ``edges(child, parent)``, ``links(lemma, pos, synset)``. Parents that
are no node are ignored; links to unknown synsets are an error of the source (see
``missing_synsets``). Depth exists for nouns and verbs only; a root has depth 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize

DEPTH_POS = ("n", "v")


def missing_synsets(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(nodes.select("synset"), "synset", "left_anti")


def polysemy(links: DataFrame) -> DataFrame:
    return links.groupBy("lemma", "pos").agg(F.count_distinct("synset").alias("polysemy"))


def depths(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """``synset, depth``: longest way to a root.

    One join of the moving front with the edges per level; each level is written to the shared
    folder, so the plan stays flat and a lost executor costs one level. A front that still moves
    after ``most`` levels means a cycle.
    """
    own = nodes.filter(F.col("pos").isin(*DEPTH_POS)).select("synset").distinct()
    known = edges.select("child", "parent").distinct().join(own.withColumnRenamed("synset", "child"), "child", "left_semi").join(own.withColumnRenamed("synset", "parent"), "parent", "left_semi")
    known = materialize(known.select("child", "parent"), "edges")
    front = materialize(own.join(known.select(F.col("child").alias("synset")), "synset", "left_anti"), "front")
    found, level = front.withColumn("depth", F.lit(0)), 0
    while not front.isEmpty():
        level += 1
        if level > most:
            raise ValueError("the graph has a cycle or is deeper than allowed")
        front = materialize(known.join(front.select(F.col("synset").alias("parent")), "parent", "left_semi").select(F.col("child").alias("synset")).distinct(), "front")
        found = found.unionByName(front.withColumn("depth", F.lit(level)))
    reached = found.groupBy("synset").agg(F.max("depth").alias("depth"))
    if not own.join(reached, "synset", "left_anti").isEmpty():
        raise ValueError("the graph has a cycle without a root")
    return reached


def lemma_metrics(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """``lemma, pos, polysemy, depth_sense_count, depth_min, depth_mean, depth_max``."""
    senses = links.select("lemma", "pos", "synset").distinct().join(depths(nodes, edges), "synset", "left")
    d = F.when(F.col("pos").isin(*DEPTH_POS), F.col("depth"))
    return senses.groupBy("lemma", "pos").agg(
        F.count("*").alias("polysemy"), F.count(d).alias("depth_sense_count"), F.min(d).cast("double").alias("depth_min"), F.avg(d).alias("depth_mean"), F.max(d).cast("double").alias("depth_max")
    )


def any_pos(metrics: DataFrame) -> DataFrame:
    """Over parts of speech: polysemy adds up, mean depth weighted by senses."""
    return metrics.groupBy("lemma").agg(
        F.sum("polysemy").alias("polysemy"), F.sum("depth_sense_count").alias("depth_sense_count"), F.min("depth_min").alias("depth_min"),
        F.try_divide(F.sum(F.col("depth_mean") * F.col("depth_sense_count")), F.sum("depth_sense_count")).alias("depth_mean"), F.max("depth_max").alias("depth_max"),
    )


def of_pos(metrics: DataFrame, pos: str) -> DataFrame:
    return metrics.filter(F.col("pos") == pos).drop("pos")


def _mean(value: str, weight: Column) -> Column:
    return F.try_divide(F.sum(F.col(value) * weight), F.sum(F.when(F.col(value).isNotNull(), weight)))


def document_summary(tokens: DataFrame, metrics: DataFrame, keys: list[str], lemma: str = "token") -> DataFrame:
    """Coverage and conditional means per key; every lemma is looked up once per key, not per token."""
    counts = tokens.groupBy(*keys, lemma).agg(F.count("*").alias("c"))
    x = counts.join(metrics.withColumnRenamed("lemma", lemma), lemma, "left")
    one, hit, deep = F.lit(1), F.col("polysemy").isNotNull(), F.col("depth_mean").isNotNull()
    return x.groupBy(*keys).agg(
        F.sum("c").alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(hit, F.col("c"))), F.lit(0)).alias("covered_tokens"), F.count(F.when(hit, 1)).alias("covered_types"),
        (F.coalesce(F.sum(F.when(hit, F.col("c"))), F.lit(0)) / F.sum("c")).alias("token_coverage"), (F.count(F.when(hit, 1)) / F.count("*")).alias("type_coverage"),
        (F.coalesce(F.sum(F.when(deep, F.col("c"))), F.lit(0)) / F.sum("c")).alias("depth_token_coverage"), (F.count(F.when(deep, 1)) / F.count("*")).alias("depth_type_coverage"),
        _mean("polysemy", F.col("c")).alias("polysemy_token_mean"), _mean("polysemy", one).alias("polysemy_type_mean"),
        _mean("depth_mean", F.col("c")).alias("depth_token_mean"), _mean("depth_mean", one).alias("depth_type_mean"),
    )
