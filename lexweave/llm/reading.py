"""Reading level of documents (problem 4).

The method: a linear pairwise ranker is learned from pairs of graded documents over syntax
and vocabulary features (logistic loss on the difference of their scores, weighted by the
distance of the grades), and its scores are calibrated into levels 1 to 6 by isotonic
regression. Grades are the median of a document's distinct ratings.

The classifier is fitted on at most ``FIT_DOCS`` graded documents (a hash order decides, the
bound is a parameter); every document of the corpus is scored over its whole text.

Defined results (``status``)
----------------------------
* ``no_text``: null text; ``no_words``: no word of letters; ``other_language``: its function
  words are mostly those of another language (or, without any evidence, it is labelled so);
  these have null score and level. ``ok``: all others.
* repeated documents or ratings: ratings count once per document, rater and band; repeated
  documents are scored each; ties in score share a level; empty tables give empty results;
  with fewer than two grades among the labels all levels are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.arrays import Words, map_texts, record_batch
from lexweave.llm.canonical import canonical
from lexweave.session import materialize, small_or_not

FIT_DOCS = 20_000
PARTNERS = 24
LEVELS = 6
MAX_RANKS = 2_000_000

# Function words by language, and words that open a subordinate clause.
ENGLISH = "the of and to in that it was for on with as at by this from but not are is be my our each his her one a".split()
FOREIGN = {
    "de": "der die das und ist nicht ein mit aber auch auf für geht immer schön wie von den dem zu im".split(),
    "fr": "le la les des est une dans pour avec mais très pas toujours sur été qui du et au petit".split(),
    "es": "el los las que una por con para pero más muy siempre como en un de la su calle y".split(),
}
CLAUSE = "although because whereas which while until after before since unless though if when that who whose whom where despite regardless".split()
LINKS = "however moreover therefore consequently nevertheless furthermore contrast respect accordance virtue lieu behalf token addition hence thus".split()

PREPOSITIONS = "of in to for with on at by from about into through during against between among within without under over toward across beyond despite concerning".split()
PRONOUNS = "i you he she it we they me him them us my your his its our their this these those".split()
BE = "is are was were be been being am".split()

FEATURES = (
    "mean_letters", "long_share", "longest_share", "rare_share", "unknown_share", "mean_log_rank", "first_band", "high_band", "types", "hapax",
    "sentence_words", "clause_rate", "link_rate", "comma_rate", "semicolon_rate", "function_share", "of_rate", "long_unknown", "suffix_rate", "letters_sd",
    "passive_rate", "preposition_rate", "pronoun_rate", "participle_rate", "phrase_words", "opening_clause", "clauses_a_sentence",
)


def word_hashes(words: list[str]) -> np.ndarray:
    return Words([" ".join(words)]).hash


class Lexicon:
    """Ranks of the common vocabulary by word hash; small and held in every task."""

    def __init__(self, forms: list[str], ranks: list[int]):
        keep = [(f, r) for f, r in zip(forms, ranks) if f and f.isascii() and f.isalpha() and r is not None]
        h = word_hashes([f.lower() for f, _ in keep])
        order = np.argsort(h)
        self.hash, self.rank = h[order], np.array([r for _, r in keep], np.float64)[order]
        self.top = float(self.rank.max()) if len(self.rank) else 1.0
        self.sets = {name: np.sort(word_hashes(words)) for name, words in (("en", ENGLISH), ("clause", CLAUSE), ("link", LINKS), ("of", ["of"]), ("prep", PREPOSITIONS), ("pron", PRONOUNS), ("be", BE))}

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.rank[at], np.nan)

    def member(self, name: str, h: np.ndarray) -> np.ndarray:
        s = self.sets[name]
        at = np.minimum(np.searchsorted(s, h), len(s) - 1)
        return s[at] == h


_OTHER_WORDS = [frozenset(w) for w in FOREIGN.values()]
_ENGLISH = frozenset(ENGLISH)


def foreign(text: str, lang: str | None) -> bool:
    """Is the text mostly in another language? Judged by function words, then letters, then the label."""
    words = [w.strip(".,;:!?\"'()[]«»“”") for w in text.lower().split()]
    en = sum(w in _ENGLISH for w in words)
    other = max(sum(w in s for w in words) for s in _OTHER_WORDS)
    if en + other >= 3 or other > en:
        return other > en
    letters = sum(c.isalpha() for c in text)
    latin = sum(c.isalpha() and c < "ɐ" for c in text)
    if letters and latin < 0.5 * letters:
        return True
    return en == 0 and lang is not None and not lang.strip().lower().startswith(("en", "und"))


def features(texts: list[str], lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(word counts, feature rows) of texts in consistent form; a text without sentence marks has no sentence length (NaN)."""
    low = [t.lower() for t in texts]
    w = Words(low)
    n_docs, doc, h = len(texts), w.doc, w.hash
    n = np.bincount(doc, minlength=n_docs).astype(np.float64)
    safe = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc, mask.astype(np.float64), n_docs) / safe

    size = (w.end - w.start).astype(np.float64)
    rank = lex.ranks(h)
    unknown = np.isnan(rank)
    known = np.maximum(np.bincount(doc, (~unknown).astype(np.float64), n_docs), 1)
    raw = w.raw
    last3 = raw[np.maximum(w.end - 3, 0)].astype(np.int64) << 16 | raw[np.maximum(w.end - 2, 0)].astype(np.int64) << 8 | raw[w.end - 1] if len(h) else np.zeros(0, np.int64)
    suffixes = np.array([int.from_bytes(s.encode(), "big") for s in ("ion", "ity", "ive", "ism", "ous", "ent", "nce", "ate", "ise", "ics")])
    pair = np.sort(doc.astype(np.uint64) << np.uint64(44) | (h >> np.uint64(20)))
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
    once = new & np.concatenate([new[1:], [True]]) if len(pair) else new
    owner = (pair >> np.uint64(44)).astype(np.int64)
    types, hapax = (np.bincount(owner, m.astype(np.float64), n_docs) for m in (new, once))

    def signs(*chars: int) -> np.ndarray:
        mark = np.zeros(256, bool)
        mark[list(chars)] = True
        return np.bincount(np.searchsorted(w.bounds, np.flatnonzero(mark[raw]), side="right") - 1, minlength=n_docs)[:n_docs].astype(np.float64)

    stops, commas, semis = signs(46, 33, 63), signs(44), signs(59, 58)
    mean = np.bincount(doc, size, n_docs) / safe
    square = np.bincount(doc, size * size, n_docs) / safe
    clause = lex.member("clause", h)
    cols = [
        mean, share(size >= 7), share(size >= 11), share(unknown | (rank > 0.5 * lex.top)), share(unknown),
        np.bincount(doc, np.where(unknown, 0, np.log(np.where(unknown, 1, rank))), n_docs) / known, share(rank <= 1000), share(rank > 2000),
        np.log1p(types) - 0.7 * np.log1p(n), hapax / np.maximum(types, 1),
        np.where(stops >= np.maximum(1, n / 80), np.log(safe / np.maximum(stops, 1)), np.nan), share(clause), share(lex.member("link", h)),
        commas / safe, semis / safe, share(lex.member("en", h)), share(lex.member("of", h)), share(unknown & (size >= 9)), share(np.isin(last3, suffixes) & (size >= 6)),
        np.sqrt(np.maximum(square - mean * mean, 0)),
    ]
    # word order: forms of be before a participle, lengths of the stretches between function words, clauses that open a sentence
    known_sign = lex.member("en", h) | lex.member("prep", h) | lex.member("pron", h) | clause
    last2 = last3 & 0xFFFF
    participle = (size >= 5) & np.isin(last2, [int.from_bytes(s, "big") for s in (b"ed", b"en")])
    before = lambda mask: np.concatenate([[False], mask[:-1] & (doc[1:] == doc[:-1])]) if len(mask) else mask
    gap = raw[np.maximum(w.start - 2, 0)] if len(h) else np.zeros(0, np.uint8)
    opening = clause & (np.isin(gap, [33, 46, 63]) | (w.start == w.bounds[doc])) if len(h) else clause
    cols += [
        share(participle & before(lex.member("be", h))), share(lex.member("prep", h)), share(lex.member("pron", h)), share(participle | ((size >= 6) & (last3 == int.from_bytes(b"ing", "big")))),
        safe / np.maximum(np.bincount(doc, known_sign, n_docs), 1), share(opening), np.where(stops > 0, np.bincount(doc, clause, n_docs) / np.maximum(stops, 1), np.nan),
    ]
    return n, np.stack(cols, axis=1)


class Ranker:
    """Linear scores of standardized features and their isotonic levels."""

    def __init__(self, mean, sd, weights, knots_x, knots_y):
        self.mean, self.sd, self.weights, self.knots_x, self.knots_y = mean, sd, weights, knots_x, knots_y

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return np.where(np.isnan(z), 0, np.clip(z, -5, 5)) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        if not len(self.knots_x):
            return np.full(len(score), np.nan)
        return np.interp(score, self.knots_x, self.knots_y)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing block means of y over sorted x, as knots at block centres."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # sum y, sum x, count
    for a, b in zip(x, y):
        blocks.append([b, a, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            for k in range(3):
                blocks[-1][k] += last[k]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def _standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = (x - mean) / sd
    return np.where(np.isnan(z), 0, np.clip(z, -5, 5))


def _rank_weights(x: np.ndarray, grade: np.ndarray, seed: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, deviation and weights (scores of unit deviation): pairs of different grades, ``PARTNERS`` for each document; Newton steps
    on the weighted logistic loss. None where all grades are equal."""
    mean, sd = np.nan_to_num(np.nanmean(x, axis=0)), np.nan_to_num(np.nanstd(x, axis=0))
    sd = np.where(sd > 1e-9, sd, 1.0)
    z = _standard(x, mean, sd)
    rng = np.random.default_rng(seed)
    i = np.repeat(np.arange(len(z)), PARTNERS)
    j = rng.integers(0, len(z), len(i))
    ok = grade[i] != grade[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    swap = grade[i] < grade[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    d, weight = z[i] - z[j], grade[i] - grade[j]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (weight * (1 - p)) / len(i) - ridge * w
        H = (d * (weight * p * (1 - p))[:, None]).T @ d / len(i) + ridge * np.eye(len(w))
        step = np.linalg.solve(H, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, sd, w / max(float((z @ w).std()), 1e-9)


def fit(x: np.ndarray, grade: np.ndarray, seed: int = 5, ridge: float = 1e-3, folds: int = 5) -> Ranker:
    """The pairwise ranker, and levels by isotonic regression on scores of documents that a ranker was not fitted on."""
    whole = _rank_weights(x, grade, seed, ridge) if len(x) else None
    if whole is None:
        return Ranker(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), np.zeros(0), np.zeros(0))
    fold = np.random.default_rng(seed).permutation(len(x)) % folds
    score = _standard(x, *whole[:2]) @ whole[2]
    for k in range(folds):
        rest, here = fold != k, fold == k
        if here.any() and rest.sum() > folds and (part := _rank_weights(x[rest], grade[rest], seed, ridge)) is not None:
            score[here] = _standard(x[here], *part[:2]) @ part[2]
    return Ranker(*whole, *isotonic(score, grade))


def lexicon(ranks: DataFrame) -> Lexicon:
    rows = ranks.select("form", "rank_no").limit(MAX_RANKS + 1).collect()
    if len(rows) > MAX_RANKS:
        raise ValueError(f"more than {MAX_RANKS} ranked forms")
    return Lexicon([r.form for r in rows], [r.rank_no for r in rows])


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: the median of a document's distinct ratings within 1 .. LEVELS."""
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "rater_id", F.col("reading_band").cast("int").alias("band")).filter(f"band between 1 and {LEVELS}").distinct()
    return one.groupBy("doc_id").agg(F.percentile("band", 0.5).alias("grade"))


def _features_of(docs: DataFrame, lex: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    names = "".join(f", {f} double" for f in FEATURES)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("foreign", pa.bool_()), *((f, pa.float64()) for f in FEATURES)])

    def fn(ids, texts):
        texts = [canonical(t) for t in texts]
        n, x = features(texts, shared.value)
        yield record_batch(schema, [[i["doc_id"] for i in ids], n.astype(np.int64), [foreign(t, i["lang"]) for i, t in zip(ids, texts)], *x.T])

    rows = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")), F.col("text").cast("string"))
    return map_texts(rows, fn, "doc_id bigint, n_words bigint, foreign boolean" + names)


def graded_features(docs: DataFrame, labels: DataFrame, lex: Lexicon, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Features of the graded documents that can be read, at most ``fit_docs`` of them in hash order."""
    g = materialize(grades(labels), "grades")
    sample = g.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    chosen = docs.join(small_or_not(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return _features_of(chosen, lex).filter("n_words > 0 and not foreign").join(small_or_not(sample), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, lex: Lexicon, fit_docs: int = FIT_DOCS) -> Ranker:
    rows = graded_features(docs, labels, lex, fit_docs).orderBy("doc_id").toPandas()
    if rows.empty:
        k = len(FEATURES)
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), np.zeros(0), np.zeros(0))
    return fit(rows[list(FEATURES)].to_numpy(float), rows["grade"].to_numpy(float))


_OUT = pa.schema([("doc_id", pa.int64()), ("status", pa.string()), ("n_words", pa.int64()), ("score", pa.float64()), ("level", pa.float64()), ("band", pa.int32())])
_OUT_SQL = "doc_id bigint, status string, n_words bigint, score double, level double, band int"


def levels(docs: DataFrame, ranker: Ranker, lex: Lexicon) -> DataFrame:
    """``doc_id, status, n_words, score, level, band`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast((ranker, lex))

    def fn(ids, texts):
        ranker, lex = shared.value
        texts = [canonical(t) for t in texts]
        n, x = features(texts, lex)
        score = ranker.score(x)
        level = ranker.level(score)
        rows = []
        for k, (i, t) in enumerate(zip(ids, texts)):
            if n[k] == 0 and not any(c.isalpha() for c in t):
                rows.append((i["doc_id"], "no_words", 0, None, None, None))
            elif n[k] == 0 or foreign(t, i["lang"]):
                rows.append((i["doc_id"], "other_language", int(n[k]), None, None, None))
            else:
                lv = None if math.isnan(level[k]) else float(level[k])
                rows.append((i["doc_id"], "ok", int(n[k]), float(score[k]), lv, None if lv is None else int(min(LEVELS, max(1, round(lv))))))
        yield record_batch(_OUT, list(zip(*rows)))

    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    scored = map_texts(docs.select(key, F.col("text").cast("string")), fn, _OUT_SQL)
    none = docs.filter("text is null").select(
        F.col("doc_id").cast("bigint"), F.lit("no_text").alias("status"), F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("int").alias("band"),
    )
    return scored.unionByName(none)


def held_out(docs: DataFrame, labels: DataFrame, lex: Lexicon) -> dict[str, float]:
    """Fit on four fifths of the graded documents; rank agreement on the rest."""
    rows = graded_features(docs, labels, lex).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))).orderBy("doc_id").toPandas()
    x, g, test = rows[list(FEATURES)].to_numpy(float), rows["grade"].to_numpy(float), rows["fold"].to_numpy() == 0
    r = fit(x[~test], g[~test])
    s = r.score(x[test])
    i, j = np.triu_indices(int(test.sum()), 1)
    y = g[test]
    ok = y[i] != y[j]
    right = (s[i] > s[j]) == (y[i] > y[j])

    def ranks(v):
        u, inv, cnt = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(cnt) - (cnt - 1) / 2)[inv]

    return {
        "n_fit": int((~test).sum()), "n_test": int(test.sum()), "pair_accuracy": float(right[ok].mean()),
        "spearman": float(np.corrcoef(ranks(s), ranks(y))[0, 1]), "mean_abs_error": float(np.abs(r.level(s) - y).mean()),
    }
