"""Diagnostics across documents: reliability, off-list words, vocabulary overlap, profile scores, flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import diversity as D
from lexweave.operators.ordered import running

MAX_GROUPS = 2000
CAUSES = (
    "acronym or initialism", "contraction or possessive", "proper noun or sentence-initial capitalization", "derived or inflected form",
    "short token or abbreviation", "specialized term, name, or possible spelling issue",
)


def reliability(wide: DataFrame, keys: list[str], **settings) -> DataFrame:
    """Per key and index: available, undefined or too short, with a note."""
    have = [i for i in D.INDICES if i in wide.columns]
    rows = wide.unpivot([*keys, "n_tokens"], have, "index_key", "value")
    need = F.create_map(*(F.lit(x) for i in have for x in (i, D.required_tokens(i, **settings))))[F.col("index_key")]
    rows = rows.withColumn("required_tokens", need)
    none, short = F.col("value").isNull() | F.isnan("value"), F.col("n_tokens") < F.col("required_tokens")
    return rows.select(
        *keys, "index_key", "n_tokens", "required_tokens", T.clean_double("value").alias("value"),
        F.when(none & short, "too short").when(none, "undefined").otherwise("available").alias("status"), F.when(none & short, 0).when(none, 1).otherwise(2).alias("status_code"),
        F.when(none & short, F.concat(F.lit("N="), F.col("n_tokens").cast("string"), F.lit(" < "), F.col("required_tokens").cast("string"))).when(none, "undefined for this text").otherwise("").alias("note"),
    )


def _first(forms: Column, test) -> Column:
    return F.get(F.filter(forms, test), F.lit(0))


def off_list(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and off-list head: count, forms, and the first cause that its spellings show."""
    forms = mapped.filter("rank is null").groupBy(*keys, "head", "surface").agg(F.count("*").alias("c"))
    agg = forms.groupBy(*keys, "head").agg(F.sum("c").alias("count"), F.count("*").alias("n_forms"), F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col("surface").alias("f")))).alias("o"))
    o = F.transform("o", lambda x: x["f"])
    x = agg.withColumn("f", o)
    upper, apostrophe, capital = _first(F.col("f"), T.is_uppercase), _first(F.col("f"), lambda s: s.contains("'")), _first(F.col("f"), T.is_capitalized)
    suffix = F.get(F.filter(F.transform(F.concat(F.array(F.col("head")), F.col("f")), T.suffix_of), lambda s: s.isNotNull()), F.lit(0))
    short = F.length("head") <= 2
    tests = ((upper.isNotNull(), F.concat(F.lit("uppercase form: "), upper)), (apostrophe.isNotNull(), F.concat(F.lit("apostrophe form: "), apostrophe)), (capital.isNotNull(), F.concat(F.lit("capitalized form: "), capital)), (suffix.isNotNull(), F.concat(F.lit("suffix: -"), suffix)), (short, F.concat(F.lit("short head: "), "head")))
    cause, evidence = F.lit(CAUSES[5]), F.lit("no surface cue")
    for (test, said), name in reversed(list(zip(tests, CAUSES))):
        cause, evidence = F.when(test, name).otherwise(cause), F.when(test, said).otherwise(evidence)
    summary = F.array_join(F.transform(F.slice("o", 1, 8), lambda v: F.concat(v["f"], F.lit(" ("), (-v["c"]).cast("string"), F.lit(")"))), ", ")
    return x.select(*keys, "head", "count", "n_forms", summary.alias("forms"), cause.alias("cause"), evidence.alias("evidence"))


def off_list_top(rows: DataFrame, n: int = 25) -> DataFrame:
    """The n most frequent off-list heads over all keys."""
    return rows.groupBy("head").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "head").limit(n)


def overlap(tokens: DataFrame, group: str, ordered_pairs: bool = True, zeros: bool = False) -> DataFrame:
    """Shared vocabulary of every two groups, with itself and in both orders, or each pair once.

    Words are made distinct per group first; unions follow from counts. Groups without a common word are left out, so
    that any number of groups can be compared; ``zeros`` adds those pairs, the whole matrix, which is refused over
    ``MAX_GROUPS`` groups, as its square does not follow the data.
    """
    types = tokens.select(group, "token").distinct()
    sizes = types.groupBy(group).agg(F.count("*").alias("k"))
    a, b = types.select(F.col(group).alias("a"), "token"), types.select(F.col(group).alias("b"), "token")
    cond = F.col("a") <= F.col("b")
    shared = a.join(b, "token").filter(cond).groupBy("a", "b").agg(F.count("*").alias("shared"))
    ka, kb = sizes.select(F.col(group).alias("a"), F.col("k").alias("ka")), sizes.select(F.col(group).alias("b"), F.col("k").alias("kb"))
    if zeros:
        if sizes.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups: leave out the pairs without a common word")
        half = F.broadcast(ka).join(F.broadcast(kb), cond).join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    else:
        half = shared.join(ka, "a").join(kb, "b")
    union = F.col("ka") + F.col("kb") - F.col("shared")
    if not ordered_pairs:
        return half.filter("a < b").select(
            F.col("a").alias("document_a"), F.col("b").alias("document_b"), F.col("shared").alias("shared_types"), (F.col("ka") - F.col("shared")).alias("a_only_types"),
            (F.col("kb") - F.col("shared")).alias("b_only_types"), union.alias("union_types"), F.try_divide(F.col("shared"), union).alias("jaccard"),
        )
    one = half.select("a", "b", "shared", union.alias("u"))
    both = one.unionByName(one.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "u"))
    return both.select(F.col("a").alias("document_a"), F.col("b").alias("document_b"), F.col("shared").alias("shared_types"), F.col("u").alias("union_types"), F.try_divide(F.col("shared"), F.col("u")).alias("jaccard"))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def _when(x: Column) -> Column:
    """Null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), _clamp(x))


def _mean(*parts: Column) -> Column:
    """Mean of the parts that are there."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), n)


def profile_scores(wide: DataFrame, keys: list[str], max_rank: int) -> DataFrame:
    """Seven display scores of 0 .. 100 per key from the wide indices (and vocd, null if absent)."""
    c = lambda n: F.col(n) if n in wide.columns else F.lit(None).cast("double")
    cap = lambda n, m: _when(100 * c(n) / m)
    inverse = lambda n, m: F.when(c(n).isNotNull(), _clamp(100 * (1 - F.least(c(n), F.lit(float(m))) / m)))
    rows = {
        "MATTR": _when(100 * c("mattr")), "HD-D": _when(100 * c("hdd")), "MTLD": cap("mtld", 150), "vocd-D": cap("vocd", 100), "Low repetition": _mean(inverse("maas", 0.2), inverse("yule_k", 1000)),
        "Sophistication": _mean(cap("advanced_guiraud", 5), _when(c("pct_beyond_k")), _when(100 * c("mean_log_rank") / math.log(max_rank))), "In-list coverage": _when(100 - c("pct_off_list")),
    }
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("dimension"), F.round(v, 1).alias("score")) for k, v in rows.items())))
    return wide.select(*keys, each)


def flags(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Codes of the cautions that apply to a document."""
    c = lambda n: F.col(n) if n in wide.columns else F.lit(None)
    low = max(D.required_tokens(i) for i in D.INDICES)
    cover = lambda p: (F.least(c(f"{p}_token_coverage"), c(f"{p}_type_coverage")) < 0.9)
    made = [
        F.when(F.col("n_tokens") < low, "panel_a_below_recommended_minimum"), F.when(c("pct_off_list") > 10, "panel_b_off_list_over_10pct"),
        F.when((c("exposure_tokens") < 50) | (c("exposure_types") < 20), "exposure_short_profile"), F.when(cover("exposure"), "exposure_coverage_below_90pct"), F.when(cover("semantic"), "semantic_coverage_below_90pct"),
    ]
    return wide.select(*keys, F.filter(F.array(*made), lambda x: x.isNotNull()).alias("flags"))


def pivot(rows: DataFrame, keys: list[str], column: str, value: str, values: list) -> DataFrame:
    """First value per key and column value; the column values are given, so no pass looks for them."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.first(value))


def ordinal_labels(df: DataFrame, order: str) -> DataFrame:
    """``Document 001`` .. by ``order``, which is unique; the name is dropped."""
    numbered = running(df, [order], F.lit(1), "_before_it")
    return numbered.withColumn("document", F.format_string("Document %03d", F.col("_before_it") + 1)).drop("_before_it")
