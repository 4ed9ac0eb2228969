"""Queries of n-grams and dispersion over ``documents`` (parts: source; registers: genre)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import corpus as C
from lexweave.plans.diversity_queries import rounded, toks
from lexweave.plans.registry import TOKS, Registry, with_toks
from lexweave.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
PARTS = 20


def parted(spark, sf):
    """Tokens with their part and register; both columns ride along with the texts."""
    docs = table(spark, sf, "documents").filter("text is not null").select(
        "doc_id", "text", F.coalesce(F.lower(F.trim("source")), F.lit("(none)")).alias("part"), F.coalesce("genre_id", F.lit("(none)")).alias("register")
    )
    each = docs.repartition("doc_id").select("doc_id", "part", "register", F.posexplode(T.surfaces("text")).alias("at", "surface"))
    return each.select("doc_id", "part", "register", (F.col("at") + 1).cast("bigint").alias("pos"), F.lower("surface").alias("token"))


def psql(body):
    return with_toks(f"WITH p AS (SELECT t.*, coalesce(lower(trim(source)), '(none)') AS part, coalesce(genre_id, '(none)') AS register FROM toks t JOIN documents USING (doc_id)), {body}")


@R.query(with_toks("SELECT token, count(*)::BIGINT AS frequency, count(DISTINCT doc_id)::BIGINT AS document_frequency FROM toks GROUP BY token"))
def unigram_df(spark, sf):
    return C.unigrams(toks(spark, sf))


@R.query(with_toks("SELECT a.token AS w1, b.token AS w2, count(*)::BIGINT AS frequency FROM toks a JOIN toks b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 GROUP BY ALL"))
def bigrams(spark, sf):
    return C.ngrams(toks(spark, sf), 2)


@R.query(with_toks("SELECT a.token AS w1, b.token AS w2, c.token AS w3, count(*)::BIGINT AS frequency FROM toks a JOIN toks b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN toks c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 GROUP BY ALL"))
def trigrams(spark, sf):
    return C.ngrams(toks(spark, sf), 3)


@R.query(f"""WITH {TOKS}, c AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY 1)
 SELECT count(*)::BIGINT AS documents, count(*) FILTER (coalesce(n, 0) = 0)::BIGINT AS empty_documents, sum(n)::BIGINT AS tokens, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS bytes FROM documents LEFT JOIN c USING (doc_id)""")
def corpus_stats(spark, sf):
    return C.corpus_stats(table(spark, sf, "documents"), F.size(T.surfaces("text")).cast("bigint"))


@R.query(with_toks("""WITH bi AS (SELECT a.token AS w1, b.token AS w2, count(*)::DOUBLE AS a FROM toks a JOIN toks b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 GROUP BY ALL),
 m AS (SELECT *, (sum(a) OVER (PARTITION BY w1))::DOUBLE AS f1, (sum(a) OVER (PARTITION BY w2))::DOUBLE AS f2, (sum(a) OVER ())::DOUBLE AS n FROM bi), e AS (SELECT *, f1 - a AS b, f2 - a AS c, n - f1 - f2 + a AS d, f1 * f2 / n AS ex FROM m WHERE a >= 2)
 SELECT w1, w2, a::BIGINT AS frequency, round(log2(a / ex), 6) AS mi, round(log2(a * a * a / ex), 6) AS mi3, round((a - ex) / sqrt(a), 6) AS t_score,
 round(2 * (a * ln(a / ex) + CASE WHEN b > 0 THEN b * ln(b / (f1 * (n - f2) / n)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / ((n - f1) * f2 / n)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / ((n - f1) * (n - f2) / n)) ELSE 0 END), 4) AS log_likelihood,
 round(a / f1 - c / nullif(n - f1, 0), 6) AS delta_p_21, round(a / f2 - b / nullif(n - f2, 0), 6) AS delta_p_12 FROM e"""))
def ngram_association(spark, sf):
    out = C.association(toks(spark, sf))
    return out.select("w1", "w2", "frequency", *(F.round(c, 4 if c == "log_likelihood" else 6).alias(c) for c in out.columns[3:]))


@R.query(psql("""s AS (SELECT part, count(*)::DOUBLE AS c FROM p GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n, sum(c) AS big FROM s),
 g AS (SELECT w.token, s.part, s.c, s.c / n.big AS s, n.n, coalesce(v.v, 0)::DOUBLE AS v, w.f FROM (SELECT token, count(*)::DOUBLE AS f FROM p GROUP BY 1) w CROSS JOIN s CROSS JOIN n LEFT JOIN (SELECT token, part, count(*) AS v FROM p GROUP BY ALL) v ON v.token = w.token AND v.part = s.part)
 SELECT token, max(f)::BIGINT AS frequency, count(*) FILTER (v > 0)::BIGINT AS range, round(100 * count(*) FILTER (v > 0) / max(n), 6) AS range_pct,
 round(greatest(0, 1 - stddev_pop(v / c) / avg(v / c) / sqrt(max(n) - 1)), 6) AS juilland_d, round(sum(CASE WHEN v > 0 THEN -(v / f) * log2(v / f) ELSE 0 END) / log2(max(n)), 6) AS carroll_d2,
 round(sum(abs(v / f - s)) / 2, 6) AS dp, round(sum(CASE WHEN v > 0 THEN v / f * log2(v / f / s) ELSE 0 END), 6) AS dkl, round(pow(sum(sqrt(s * v)), 2) / max(f), 6) AS rosengren_s FROM g GROUP BY token"""))
def dispersion(spark, sf):
    return rounded(C.dispersion(parted(spark, sf), "part"))


_PLACE = "pl AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM toks), big AS (SELECT count(*)::DOUBLE AS n FROM toks)"


@R.query(with_toks(f"""WITH {_PLACE}, g AS (SELECT token, place, count(*) OVER w AS f, coalesce(lead(place) OVER (PARTITION BY token ORDER BY place), min(place) OVER w + n) - place AS gap, n FROM pl, big WINDOW w AS (PARTITION BY token))
 SELECT token, max(f)::BIGINT AS frequency, round(sum(least(gap, n / f)) / max(n / f), 6) AS arf FROM g GROUP BY token"""))
def arf(spark, sf):
    return rounded(C.reduced_frequency(toks(spark, sf)))


@R.query(with_toks(f"WITH {_PLACE} SELECT token, least(floor(place * {PARTS} / n), {PARTS - 1})::INT AS part, count(*)::BIGINT AS v FROM pl, big GROUP BY ALL"))
def parts_from_positions(spark, sf):
    return C.equal_parts(toks(spark, sf), PARTS)


@R.query(with_toks(f"""WITH {_PLACE}, g AS (SELECT token, count(*)::DOUBLE AS f, count(DISTINCT least(floor(place * {PARTS} / n), {PARTS - 1}))::DOUBLE AS r, max(n / {PARTS}) AS l, max(n) AS n FROM pl, big GROUP BY 1)
 SELECT token, f::BIGINT AS frequency, r::BIGINT AS range, round(100 * r / {PARTS}, 6) AS range_pct, round(100 * (1 - exp(-f * l / n)), 6) AS expected_range_pct, round(100 * r / {PARTS} / (100 * (1 - exp(-f * l / n))), 6) AS range_ratio,
 round(CASE WHEN least(f, {PARTS}) = ceil(f / l) THEN 1 ELSE (r - ceil(f / l)) / (least(f, {PARTS}) - ceil(f / l)) END, 6) AS fa_range FROM g"""))
def range_measures(spark, sf):
    return rounded(C.range_measures(toks(spark, sf), PARTS))


@R.query(with_toks("""WITH d AS (SELECT token, count(DISTINCT doc_id)::DOUBLE AS s, bool_or(token IN (SELECT form FROM rank_list)) AS y FROM toks GROUP BY 1), r AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS k FROM d)
 SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, round((k - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(k) FILTER (y) AS k FROM r)"""))
def auc(spark, sf):
    words = C.unigrams(toks(spark, sf)).join(table(spark, sf, "rank_list").select(F.col("form").alias("token"), F.lit(True).alias("y")), "token", "left")
    return rounded(C.auc(words.select("document_frequency", F.coalesce("y", F.lit(False)).alias("y")), "document_frequency", "y"))


@R.query(psql("""v AS (SELECT token, register, count(*)::DOUBLE AS v FROM p GROUP BY ALL), f AS (SELECT token, count(*)::DOUBLE AS f, count(DISTINCT doc_id) AS d FROM p GROUP BY 1)
 SELECT token, max(f)::BIGINT AS frequency, max(d)::BIGINT AS contexts, count(*)::BIGINT AS registers, round(sum(-(v / f) * log2(v / f)) / log2((SELECT count(DISTINCT register) FROM p)), 6) AS register_entropy FROM v JOIN f USING (token) GROUP BY token"""))
def contextual_diversity(spark, sf):
    return rounded(C.contextual_diversity(parted(spark, sf), "register"))


@R.query()
def bootstrap_ci(spark, sf):
    """All words of the rank list."""
    words = table(spark, sf, "rank_list").select(F.col("form").alias("token"))
    return rounded(C.bootstrap(parted(spark, sf), words, "register"))
