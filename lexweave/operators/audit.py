"""Audits of a graded text table, duplicate checks, and held-out-group regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import materialize

SPLITS = ("train", "validation", "test")
SCORES = ("overall", "cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions")
MAX_GROUPS = 10_000


def split_name(c: str = "set_name") -> Column:
    return F.lower(F.trim(c))


def on_scale(c: str) -> Column:
    """1.0 to 5.0 in half points."""
    return F.col(c).between(1, 5) & (F.col(c) * 2 == F.floor(F.col(c) * 2))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def split_audit(essays: DataFrame) -> DataFrame:
    """Per split: rows, repeated ids, blank required fields, bad tasks, scores off the scale, prompts; one pass."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    bad = sum((F.when(F.col(c).isNotNull() & ~on_scale(c), 1).otherwise(0) for c in SCORES), F.lit(0))
    null = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in SCORES), F.lit(0))
    return essays.groupBy(split_name().alias("split")).agg(
        F.count("*").alias("rows"), (F.count("text_id_kaggle") - F.count_distinct("text_id_kaggle")).alias("repeated_ids"), F.count(F.when(blank("full_text"), 1)).alias("blank_texts"),
        F.count(F.when(blank("prompt"), 1)).alias("blank_prompts"), F.count(F.when(F.col("task").isNull() | ~F.lower(F.trim("task")).isin("independent", "integrated", "text dependent"), 1)).alias("bad_tasks"),
        F.sum(null).alias("missing_scores"), F.sum(bad).alias("scores_off_scale"), F.count_distinct(F.lower(F.trim("prompt"))).alias("prompts"),
        F.min(F.when(on_scale("overall"), F.col("overall"))).alias("least_overall"), F.max(F.when(on_scale("overall"), F.col("overall"))).alias("most_overall"),
    ).withColumn("known_split", F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def combined_audit(essays: DataFrame) -> DataFrame:
    """One row per pair of splits: shared ids, exactly shared texts (by hash), shared prompts and whether the prompt sets are equal."""
    keyed = essays.select(split_name().alias("split"), F.lower(F.trim("text_id_kaggle")).alias("id"), F.sha2("full_text", 256).alias("text"), F.lower(F.trim("prompt")).alias("prompt")).filter(F.col("split").isin(*SPLITS))
    long = keyed.select("split", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.col(k).alias("value")) for k in ("id", "text", "prompt")))).alias("e")).select("split", "e.what", "e.value").filter("value is not null and value <> ''")
    per = long.groupBy("what", "value").agg(*(F.max(F.col("split") == s).alias(s) for s in SPLITS))
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    agg = per.agg(*(F.count(F.when((F.col("what") == w) & F.col(a) & F.col(b), 1)).alias(f"{a}_{b}_{w}") for a, b in pairs for w in ("id", "text", "prompt")), *(F.count(F.when((F.col("what") == "prompt") & (F.col(a) != F.col(b)), 1)).alias(f"{a}_{b}_odd") for a, b in pairs))
    return agg.select(F.inline(F.array(*(F.struct(
        F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}_id").alias("shared_ids"), F.col(f"{a}_{b}_text").alias("shared_texts"), F.col(f"{a}_{b}_prompt").alias("shared_prompts"), (F.col(f"{a}_{b}_odd") == 0).alias("same_prompts"),
    ) for a, b in pairs))))


#: Unicode whitespace, as Python splits at it.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normal_text(c: str = "text", spaces: str = SPACES) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), spaces, " "))


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", unicode: bool = True) -> DataFrame:
    """``key, class_id, n_copies`` by hash of the text in composed form (NFC), lower case and with single spaces for
    Unicode whitespace; null and blank texts have no class.

    Without ``unicode`` texts are not composed and only ASCII whitespace counts, as in the SQL of the older queries.
    """
    docs = T.composed_texts(docs.select(key, text), text) if unicode else docs
    h = docs.select(key, normal_text(text, SPACES if unicode else r"\s+").alias("n")).filter("n <> ''").select(key, F.sha2("n", 256).alias("h"))
    c = h.groupBy("h").agg(F.min(key).alias("class_id"), F.count("*").alias("n_copies"))
    return h.join(c, "h").select(key, "class_id", "n_copies")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, size: int = 5, key: str = "doc_id", text: str = "text", unicode: bool = True) -> DataFrame:
    """Pairs of class representatives ``doc_a, doc_b, shared, united, resemblance`` by word shingles; with
    ``exact_classes`` of the same ``unicode`` as membership this covers all copies.

    Prefix filter: two sets of the resemblance share one of each other's rarest shingles, so only
    as many of those as the threshold can spare (and one) are joined; common shingles never meet.
    """
    docs = T.composed_texts(docs.select(key, text), text) if unicode else docs
    classes = exact_classes(docs, key, text, unicode)
    reps = docs.join(classes.filter(F.col(key) == F.col("class_id")).select(key), key, "left_semi").dropDuplicates([key])
    words = reps.select(key, T.token_array(text).alias("t")).filter(F.size("t") >= size)
    sh = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("t") - size), lambda i: F.xxhash64(F.slice("t", i + 1, F.lit(size)))))
    sets = materialize(words.select(key, sh.alias("sh")).withColumn("n", F.size("sh")), "shingles")
    each = sets.select(key, "n", F.explode("sh").alias("s"))
    rare = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # a shingle of one text only comes first in the order and joins nothing: it only uses up places
    ranked = each.join(rare, "s").withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("df", "s")) + F.col("n") - F.count("*").over(W.partitionBy(key)))
    prefix = ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select(key, "n", "s")
    a, b = (prefix.select(F.col(key).alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), "s") for x in "ab")
    cand = a.join(b, "s").filter((F.col("doc_a") < F.col("doc_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("doc_a", "doc_b").distinct()
    full = cand.join(sets.select(F.col(key).alias("doc_a"), F.col("sh").alias("sa")), "doc_a").join(sets.select(F.col(key).alias("doc_b"), F.col("sh").alias("sb")), "doc_b")
    shared = F.size(F.array_intersect("sa", "sb"))
    pairs = full.select("doc_a", "doc_b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("united"))
    return pairs.withColumn("resemblance", F.col("shared") / F.col("united")).filter(F.col("shared") >= threshold * F.col("united") - 1e-9)


def holm(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values of a small family of tests."""
    one = W.partitionBy(F.lit(1))
    up, m = one.orderBy(p, name), F.count("*").over(one)
    r = F.row_number().over(up)
    x = tests.withColumn("i", r).withColumn("m", m)
    raw = x.withColumn("h", (F.col("m") - F.col("i") + 1) * F.col(p)).withColumn("b", F.col("m") * F.col(p) / F.col("i"))
    return raw.select(
        name, p, F.least(F.lit(1.0), F.max("h").over(up.rowsBetween(W.unboundedPreceding, 0))).alias("holm"),
        F.least(F.lit(1.0), F.min("b").over(one.orderBy(F.desc(p), F.desc(name)).rowsBetween(W.unboundedPreceding, 0))).alias("benjamini_hochberg"),
    )


def _spline(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural cubic spline basis with three columns: two inner and two boundary knots."""
    x = np.asarray(x, float)
    low, high = knots[0], knots[-1]
    scale = (high - low) or 1.0

    def d(k: int) -> np.ndarray:
        return (np.maximum(x - knots[k], 0) ** 3 - np.maximum(x - high, 0) ** 3) / ((high - knots[k]) or 1.0) / scale**2

    return np.stack([(x - low) / scale, d(0) - d(2), d(1) - d(2)], axis=1)


def leave_group_out(df: DataFrame, group: str, outcome: str, length: str, base: list[str], extra: list[str], rounds: int = 10_000, seed: int = 20260723) -> tuple[DataFrame, dict[str, float]]:
    """Held-out errors of two least-squares models per group, and the bootstrap interval of their difference.

    Knots and scaling come from each training fold only. A fold's normal equations are sums, so
    one pass gives all of them: each batch adds its rows to every fold but its own group's. What
    is sent to the driver is one small matrix per fold and partition, never rows. The groups are
    bounded (``MAX_GROUPS``, checked).
    """
    cols = [length, *base, *extra]
    data = df.select(F.col(group).cast("string").alias("g"), F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).dropna().filter("x0 > 0").withColumn("x0", F.ln("x0"))
    data = materialize(data, "regression")
    stats = data.groupBy("g").agg(F.count("*").alias("n"), *(f(F.col(f"x{i}") * F.col(f"x{i}") if p else F.col(f"x{i}")).alias(f"{'q' if p else 's'}{i}") for i in range(len(cols)) for p, f in ((0, F.sum), (1, F.sum)))).orderBy("g").limit(MAX_GROUPS + 1).toPandas()
    if len(stats) > MAX_GROUPS:
        raise ValueError("too many groups")
    if len(stats) < 2:
        return df.sparkSession.createDataFrame([], "g string, n bigint, mae_0 double, mae_1 double, rmse_0 double, rmse_1 double"), {}
    # distinct lengths per group give the quantiles of every training fold
    hist = data.groupBy("g", F.round("x0", 3).alias("x")).agg(F.count("*").alias("n")).toPandas().sort_values("x")
    groups = stats["g"].tolist()
    plans = {}
    for k, g in enumerate(groups):
        h = hist[hist["g"] != g]
        cum = h["n"].cumsum().to_numpy() / h["n"].sum()
        knots = np.array([h["x"].iloc[0], *(h["x"].iloc[min(int(np.searchsorted(cum, q)), len(h) - 1)] for q in (1 / 3, 2 / 3)), h["x"].iloc[-1]])
        n = stats["n"].sum() - stats["n"][k]
        mean = np.array([(stats[f"s{i}"].sum() - stats[f"s{i}"][k]) / n for i in range(1, len(cols))])
        var = np.array([(stats[f"q{i}"].sum() - stats[f"q{i}"][k]) / n for i in range(1, len(cols))]) - mean**2
        plans[g] = (knots, mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-12)), 1.0))
    nb = len(base)

    def design(x: np.ndarray, plan) -> np.ndarray:
        knots, mean, sd = plan
        return np.concatenate([np.ones((len(x), 1)), _spline(x[:, 0], knots), (x[:, 1:] - mean) / sd], axis=1)

    p = 4 + nb + len(extra)

    def gather(batches):
        sums = {g: np.zeros((p, p + 1)) for g in groups}
        for b in batches:
            gs = np.array(b.column(0).to_pylist(), object)
            y = b.column(1).to_numpy()
            x = np.stack([b.column(2 + i).to_numpy() for i in range(len(cols))], axis=1)
            for g in groups:
                keep = gs != g
                X = design(x[keep], plans[g])
                sums[g] += X.T @ np.concatenate([X, y[keep][:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array([sums[g].ravel().tolist() for g in groups], pa.list_(pa.float64()))], names=["g", "m"])

    parts = data.mapInArrow(gather, "g string, m array<double>").select("g", F.posexplode("m").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas()
    fits = {}
    for g, m in parts.groupby("g"):
        M = np.zeros(p * (p + 1))
        M[m["i"].to_numpy()] = m["v"].to_numpy()
        M = M.reshape(p, p + 1)
        small = 4 + nb
        fits[g] = tuple(np.linalg.lstsq(M[:q, :q], M[:q, p], rcond=None)[0] for q in (small, p))

    def errors(batches):
        for b in batches:
            gs = np.array(b.column(0).to_pylist(), object)
            y = b.column(1).to_numpy()
            x = np.stack([b.column(2 + i).to_numpy() for i in range(len(cols))], axis=1)
            for g in set(gs.tolist()):
                keep = gs == g
                X = design(x[keep], plans[g])
                e = [y[keep] - X[:, : len(w)] @ w for w in fits[g]]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(e[0])), pa.array(e[0]), pa.array(e[1])], names=["g", "e0", "e1"])

    err = data.mapInArrow(errors, "g string, e0 double, e1 double").groupBy("g").agg(
        F.count("*").alias("n"), *(F.avg(F.abs(f"e{k}")).alias(f"mae_{k}") for k in (0, 1)), *(F.sqrt(F.avg(F.col(f"e{k}") * F.col(f"e{k}"))).alias(f"rmse_{k}") for k in (0, 1))
    )
    err = materialize(err, "fold-errors")
    d = err.select("mae_0", "mae_1").orderBy("g").toPandas()
    delta = (d["mae_0"] - d["mae_1"]).to_numpy()
    boot = delta[np.random.default_rng(seed).integers(0, len(delta), (rounds, len(delta)))].mean(axis=1)
    return err, {"delta_macro_mae": float(delta.mean()), "low": float(np.percentile(boot, 2.5)), "high": float(np.percentile(boot, 97.5)), "groups": float(len(delta))}


def upload_budget(files: DataFrame, key: str, order: str, size: str, per_file: int, total: int, most: int) -> DataFrame:
    """Which files of a request are taken: too large ones and ones that would break the total or the number are passed over, later ones may still fit."""
    from lexweave.operators.ordered import fold

    rows = files.select(F.col(key).cast("string").alias("request"), F.col(order).cast("bigint").alias("file"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("bytes"))

    def step(state, r):
        used, n = state
        said = "too_large" if r["bytes"] > per_file else "over_total" if used + r["bytes"] > total else "over_number" if n >= most else "taken"
        if said == "taken":
            used, n = used + r["bytes"], n + 1
        return (used, n), {"request": r["request"], "file": r["file"], "bytes": r["bytes"], "status": said, "used": used}

    return fold(rows, "request", ["file"], lambda: (0, 0), step, "request string, file bigint, bytes bigint, status string, used bigint")

