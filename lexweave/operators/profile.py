"""Frequency-list profiles of ordered tokens (Panel B).

A list is a frame ``form, head, rank``; ``mapped`` is the token frame with ``head, rank,
level`` (null where off-list). All measures return one row per key unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions.text import level_of
from lexweave.operators import diversity as D
from lexweave.session import small_or_not

S_RANKS = (500, 1000, 1500, 2000, 2500, 3000)
S_MIN, S_MAX = 200, 30000


def lookup_table(ranks: DataFrame, normalized: DataFrame | None = None) -> DataFrame:
    """``token, head, rank, level``: list forms, then forms whose normalized head is in the list, then off-list heads."""
    listed = ranks.select(F.col("form").alias("token"), "head", "rank", level_of(F.col("rank")).alias("level"))
    if normalized is None:
        return listed
    rest = normalized.filter("token <> head").join(listed.select("token"), "token", "left_anti")
    found = rest.join(listed.select(F.col("token").alias("head"), F.col("head").alias("h2"), "rank", "level"), "head", "left")
    return listed.unionByName(found.select("token", F.coalesce("h2", "head").alias("head"), "rank", "level"))


def map_tokens(tokens: DataFrame, ranks: DataFrame, normalize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``head, rank, level``: one left join of the tokens with a lookup over distinct forms."""
    normalized = normalize(tokens.select("token").distinct()) if normalize else None
    known = small_or_not(lookup_table(ranks, normalized))
    return tokens.join(known, "token", "left").withColumn("head", F.coalesce("head", "token"))


def lexical_profile(mapped: DataFrame, keys: list[str], n_levels: int) -> DataFrame:
    """Per key and level (1 .. n_levels, then off-list, zero-filled): tokens, heads, coverage and cumulative percent."""
    per = mapped.filter((F.col("level") <= n_levels) | F.col("level").isNull()).groupBy(*keys, "level").agg(F.count("*").alias("tokens"), F.count_distinct("head").alias("heads"))
    total = mapped.groupBy(*keys).agg(F.count("*").alias("n"))
    cells = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("level", F.lit(0)), F.struct("tokens", "heads")))).alias("m"))
    spine = total.join(cells, keys, "left").select(*keys, "n", "m", F.posexplode(F.array(*(F.lit(i) for i in [*range(1, n_levels + 1), 0]))).alias("ord", "level"))
    none = F.lit(0).cast("bigint")
    cell = F.try_element_at("m", F.col("level"))
    rows = spine.select(*keys, "n", "ord", "level", F.coalesce(cell["tokens"], none).alias("tokens"), F.coalesce(cell["heads"], none).alias("heads"))
    upto = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = F.sum(F.when(F.col("level") > 0, F.col("tokens")).otherwise(0)).over(upto)
    return rows.select(
        *keys, F.when(F.col("level") > 0, F.concat(F.lit("K"), "level")).otherwise("off-list").alias("level"), "tokens", "heads",
        (100 * F.col("tokens") / F.col("n")).alias("coverage_pct"), (100 * cum / F.col("n")).alias("cumulative_pct"),
    )


def coverage_thresholds(mapped: DataFrame, keys: list[str], n_levels: int, thresholds: tuple[int, ...] = (90, 95, 98)) -> DataFrame:
    """Per key and threshold the first level whose cumulative coverage of all tokens reaches it, else null."""
    per = mapped.groupBy(*keys, "level").agg(F.count("*").alias("t"))
    n = F.sum("t").over(W.partitionBy(*keys))
    cum = F.sum(F.when(F.col("level") <= n_levels, F.col("t")).otherwise(0)).over(W.partitionBy(*keys).orderBy(F.col("level").asc_nulls_last()))
    # a level without tokens reaches nothing that the level before it had not
    wide = per.select(*keys, "level", n.alias("n"), cum.alias("cum")).groupBy(*keys).agg(
        *(F.min(F.when((100 * F.col("cum") >= t * F.col("n")) & (F.col("level") <= n_levels), F.col("level"))).alias(f"t{t}") for t in thresholds)
    )
    rows = F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("level")) for t in thresholds)))
    return wide.select(*keys, rows)


def sophistication(mapped: DataFrame, keys: list[str], cutoff: int = 2) -> DataFrame:
    """Advanced Guiraud, percent of heads beyond the cutoff, mean rank and mean log rank, percent off-list."""
    hard = (F.col("level") > cutoff) | F.col("level").isNull()
    heads = mapped.groupBy(*keys, "head").agg(F.count("*").alias("t"), F.max(hard).alias("hard"), F.sum("rank").alias("r"), F.sum(F.ln("rank")).alias("lr"), F.count("rank").alias("in"))
    agg = heads.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("hard"), 1)).alias("adv"), F.sum("r").alias("r"), F.sum("lr").alias("lr"), F.sum("in").alias("in")
    )
    return agg.select(
        *keys, (F.col("adv") / F.sqrt("n")).alias("advanced_guiraud"), (100 * F.col("adv") / F.col("v")).alias("pct_beyond_k"),
        F.try_divide(F.col("r"), F.col("in")).alias("mean_rank"), F.try_divide(F.col("lr"), F.col("in")).alias("mean_log_rank"),
        (100 * (F.col("n") - F.col("in")) / F.col("n")).alias("pct_off_list"),
    )


def _factorial(k: int) -> int:
    out = 1
    for i in range(2, k + 1):
        out *= i
    return out


def hard_histogram(mapped: DataFrame, keys: list[str], segment: int = 10, above: int = 1) -> DataFrame:
    """``keys, n_segments, hist``: how many whole segments have 0 .. segment hard tokens."""
    hard = F.when(F.col("level").isNull() | (F.col("level") > above), 1).otherwise(0)
    seg = mapped.groupBy(*keys, F.floor((F.col("pos") - 1) / segment).alias("seg")).agg(F.count("*").alias("n"), F.sum(hard).alias("hard"))
    whole = F.col("n") == segment
    hist = F.array(*(F.count(F.when(whole & (F.col("hard") == k), 1)) for k in range(segment + 1)))
    return seg.groupBy(*keys).agg(F.count(F.when(whole, 1)).alias("n_segments"), hist.alias("hist"))


def p_lex(mapped: DataFrame, keys: list[str], segment: int = 10, above: int = 1) -> DataFrame:
    """Poisson rate fitted to the distribution of hard words per segment.

    The grid search runs once per distinct histogram (many short texts share one), as a product of
    the histograms with the distribution at all grid points.
    """
    per = hard_histogram(mapped, keys, segment, above)
    distinct = per.filter("n_segments > 0").select("n_segments", "hist").distinct()

    grid = np.arange(100 * segment + 1) * 0.01
    factorials = np.array([float(_factorial(k)) for k in range(segment + 1)])

    def poisson(x: np.ndarray) -> np.ndarray:
        return np.exp(-x)[..., None] * x[..., None] ** np.arange(segment + 1) / factorials

    def fit_batches(batches):
        coarse = poisson(grid)
        for b in batches:
            n = b.column(0).to_numpy().astype(float)
            hist = np.array(b.column(1).to_pylist(), float).reshape(len(n), segment + 1)
            seen = hist / n[:, None]
            best = np.empty(len(n))
            for s in range(0, len(n), 2000):  # errors of 2,000 histograms at every grid point at once
                o = seen[s : s + 2000]
                error = (coarse**2).sum(axis=1) - 2 * o @ coarse.T
                best[s : s + 2000] = grid[error.argmin(axis=1)]
            near = best[:, None] - 0.01 + 0.0005 * np.arange(41)
            near = np.concatenate([best[:, None], np.clip(near, 0, segment)], axis=1)
            error = ((poisson(near) - seen[:, None, :]) ** 2).sum(axis=2)
            found = near[np.arange(len(n)), error.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["n_segments", "hist", "lambda"])

    fit = distinct.mapInArrow(fit_batches, "n_segments bigint, hist array<bigint>, lambda double")
    mean = sum((F.col("hist")[k] * k for k in range(segment + 1)), F.lit(0)) / F.col("n_segments")
    fitted = F.transform(F.sequence(F.lit(0), F.lit(segment)), lambda k: F.exp(-F.col("lambda")) * F.pow("lambda", k) / F.factorial(k))
    fit = fit.select("n_segments", "hist", "lambda", mean.alias("mean_hard"), fitted.alias("fitted"))
    return per.join(fit, ["n_segments", "hist"], "left").select(*keys, "n_segments", "lambda", "mean_hard", "hist", "fitted")


def p_lex_distribution(fit: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and number of hard words: observed and fitted share."""
    some = fit.filter("n_segments > 0")
    each = some.select(*keys, "n_segments", F.posexplode(F.arrays_zip("hist", "fitted")).alias("k", "z"))
    return each.select(*keys, "k", (F.col("z.hist") / F.col("n_segments")).alias("observed"), F.col("z.fitted").alias("fitted"))


def s_index(mapped: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Rank at which coverage is expected to be complete; the least-squares integer in closed form.

    Each token is in as many wrap-around windows as any other, so the mean window coverage is
    plain coverage; the squared error is unimodal, so the best integer is a neighbour of the
    real optimum. Texts under ``least`` tokens have null.
    """
    import math

    cov = mapped.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count(F.when(F.col("rank") <= x, 1)).alias(f"c{x}") for x in S_RANKS))
    emp = {x: 100 * F.col(f"c{x}") / F.col("n") for x in S_RANKS}
    logs = {x: math.log(x) for x in S_RANKS}
    u = sum((emp[x] * logs[x] for x in S_RANKS), F.lit(0.0)) / (100 * sum(v * v for v in logs.values()))

    def error(s: Column) -> Column:
        return sum((F.pow(emp[x] - 100 * logs[x] / F.ln(s), F.lit(2)) for x in S_RANKS), F.lit(0.0))

    capped = F.col("u") <= 1 / math.log(S_MAX)
    real = F.when(capped, F.lit(float(S_MAX))).otherwise(F.exp(1 / F.when(F.col("u") > 0, F.col("u"))))
    low = F.greatest(F.lit(float(S_MIN)), F.least(F.lit(float(S_MAX)), F.floor("real"))).cast("double")
    high = F.least(F.lit(float(S_MAX)), low + 1)
    best = F.when(capped, F.lit(float(S_MAX))).when(error(high) < error(low), high).otherwise(low)
    long = F.col("n") >= least
    step = cov.withColumn("u", u).withColumn("real", real).withColumn("best", best)
    return step.select(*keys, F.when(long, F.col("best")).alias("s"), F.when(long, F.col("best") >= S_MAX).alias("capped"), *(F.when(long, emp[x]).alias(f"cov_{x}") for x in S_RANKS))


def bands(mapped: DataFrame, keys: list[str], n_levels: int) -> DataFrame:
    """The heads of each band (0: off-list), numbered anew in text order."""
    lev = F.coalesce("level", F.lit(0)).alias("level")
    one = mapped.select(*keys, "pos", "head", lev).filter(F.col("level") <= n_levels)
    return one.withColumn("pos", F.row_number().over(W.partitionBy(*keys, "level").orderBy("pos")).cast("bigint"))


def band_wise_mtld(mapped: DataFrame, keys: list[str], n_levels: int) -> DataFrame:
    """The MTLD of each band alone: nothing else of ``band_wise`` is worked out and joined."""
    k = [*keys, "level"]
    return D.mtld(bands(mapped, keys, n_levels), k, "head").select(*k, "mtld")


def band_wise(mapped: DataFrame, keys: list[str], n_levels: int, min_tokens: int = 50) -> DataFrame:
    """Diversity of the heads of each band (0: off-list), in text order."""
    k = [*keys, "level"]
    one = bands(mapped, keys, n_levels)
    base = one.groupBy(*k).agg(F.count("*").alias("tokens"), F.count_distinct("head").alias("types"))
    out = base
    for part in (D.mtld(one, k, "head").select(*k, "mtld"), D.mattr(one, k, "head"), D.hdd(one, k, "head")):
        out = out.join(part, k, "left")
    need = max(D.required_tokens(i, override=min_tokens) for i in ("mtld", "mattr", "hdd"))
    return out.withColumn("min_n", F.lit(need))


def form_summary(count: str, form: str, limit: int = 8, more: bool = True) -> Column:
    """Aggregate: the most frequent forms with their counts (above one), then how many more."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("c"), F.col(form).alias("f"))))
    shown = F.transform(F.slice(ordered, 1, limit), lambda x: F.when((x["c"] < -1) if more else F.lit(True), F.concat(x["f"], F.lit(" ("), (-x["c"]).cast("string"), F.lit(")"))).otherwise(x["f"]))
    text = F.array_join(shown, ", ")
    if not more:
        return text
    return F.when(F.size(ordered) > limit, F.concat(text, F.lit(", +"), (F.size(ordered) - limit).cast("string"), F.lit(" more"))).otherwise(text)


def lookup_profile(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, head and rank: tokens, coverage and the forms it stands for."""
    forms = mapped.groupBy(*keys, "head", "rank", "level", "token").agg(F.count("*").alias("c"))
    rows = forms.groupBy(*keys, "head", "rank", "level").agg(F.sum("c").alias("tokens"), form_summary("c", "token").alias("token_forms"))
    total = F.sum("tokens").over(W.partitionBy(*keys))
    return rows.select(*keys, "head", "rank", "level", "tokens", (100 * F.col("tokens") / total).alias("coverage_pct"), "token_forms")
