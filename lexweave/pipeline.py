"""The whole analysis of a document table: one call, a dict of result frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.config import AnalysisConfig
from lexweave.functions import text as T
from lexweave.operators import batch as B
from lexweave.operators import diversity as D
from lexweave.operators import export as E
from lexweave.operators import exposure as X
from lexweave.operators import network as G
from lexweave.operators import profile as P
from lexweave.session import materialize

SUMMARY = ("ttr", "mattr", "mtld", "hdd", "advanced_guiraud", "pct_beyond_k", "pct_off_list", "lambda", "s")


def analyze(
    docs: DataFrame, config: AnalysisConfig = AnalysisConfig(), ranks: DataFrame | None = None, normalize: Callable[[DataFrame], DataFrame] | None = None,
    metrics: DataFrame | None = None, exposure: tuple[DataFrame, DataFrame] | None = None, key: str = "doc_id", text: str = "text", skip_below: tuple[int, int] = (1, 1),
) -> dict[str, DataFrame]:
    """Result frames of all documents with enough tokens and types (``skip_below``), and ``skipped`` for the others.

    Tokens are made once and written to the shared folder, as every part reads them.
    """
    keys = [key]
    sizes = docs.select(key, F.size(T.surfaces(text)).alias("n"), F.size(F.array_distinct(T.token_array(text))).alias("v"))
    few = (F.col("n") < skip_below[0]) | (F.col("v") < skip_below[1])
    skipped = sizes.filter(few).select(key, F.when(F.col("n") == 0, "No tokens found.").otherwise("Too few tokens or types.").alias("error"))
    kept = docs.join(sizes.filter(~few).select(key), key, "left_semi") if skip_below != (1, 1) else docs
    tokens = materialize(T.tokens(kept, key, text), "tokens")
    a = D.panel_a(tokens, keys, segment=config.segment, window=config.window, sample=config.hdd_sample, threshold=config.mtld_threshold)
    out, wide = {"skipped": skipped}, a
    if ranks is not None:
        mapped = materialize(P.map_tokens(tokens, ranks, normalize), "mapped")
        p, s = P.p_lex(mapped, keys), P.s_index(mapped, keys)
        out |= {
            "lfp": P.lexical_profile(mapped, keys, config.n_levels), "thresholds": E.threshold_rows(P.coverage_thresholds(mapped, keys, config.n_levels, config.thresholds), keys),
            "p_lex_s": E.fit_rows(p, s, keys), "p_lex_dist": P.p_lex_distribution(p, keys), "s_empirical": s, "band_wise": P.band_wise(mapped, keys, config.n_levels, config.min_tokens),
            "off_list": B.off_list(mapped, keys), "lookup_profile": P.lookup_profile(mapped, keys),
        }
        wide = wide.join(P.sophistication(mapped, keys, config.cutoff), keys, "left").join(p.select(key, "lambda"), keys, "left").join(s.select(key, "s", "capped"), keys, "left")
    if metrics is not None:
        part = G.document_summary(tokens, metrics, keys)
        out["semantic"] = part
        wide = wide.join(part.select(key, *(F.col(c).alias(f"semantic_{c}") for c in part.columns if c != key)), keys, "left")
    if exposure is not None:
        part = X.document_summary(tokens, *exposure, keys)
        out["exposure"] = part
        wide = wide.join(part.select(key, *(F.col(c).alias(f"exposure_{c}") for c in part.columns if c != key)), keys, "left")
    wide = materialize(wide, "summary")
    out |= {
        "summary": wide, "panel_a": D.long_form(wide, keys), "reliability": B.reliability(wide, keys, segment=config.segment, window=config.window, hdd_sample=config.hdd_sample),
        "descriptives": E.descriptives(wide, [c for c, t in wide.dtypes if c != key and t in ("double", "bigint")]), "flags": B.flags(wide, keys), "metadata": E.metadata(wide.select(key), config), "json": E.payload(wide, keys),
    }
    return out
