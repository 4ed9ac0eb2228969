"""Queries of normalizers and frequency profiles: ``documents`` against ``rank_list``.

The normalizer of the registered profile is the static map of ``flemma_forms`` (its first
head, the last entry of a form wins).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import normalizers as N
from lexweave.functions.text import flemma_form
from lexweave.operators import profile as P
from lexweave.plans.diversity_queries import KEYS, rounded, toks
from lexweave.plans.registry import Registry, with_toks
from lexweave.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
LEVELS = 7


def ranks(spark, sf):
    return table(spark, sf, "rank_list").select("form", "head", F.col("rank_no").alias("rank"))


def mapped(spark, sf):
    pairs = table(spark, sf, "flemma_forms").filter("form is not null and size(heads) > 0").select("form", F.col("heads")[0].alias("head"), "entry_id").filter("head is not null")
    return P.map_tokens(toks(spark, sf), ranks(spark, sf), lambda v: N.static_map(v, pairs, "entry_id"))


MAPPED = """norm AS (SELECT lower(form) AS token, max_by(heads[1], entry_id) AS to_head FROM flemma_forms WHERE form IS NOT NULL AND len(heads) > 0 AND heads[1] IS NOT NULL GROUP BY 1),
 mapped AS (SELECT t.doc_id, t.pos, t.surface, t.token, coalesce(a.head, b.head, n.to_head, t.token) AS head, coalesce(a.rank_no, b.rank_no)::INT AS rank, ((coalesce(a.rank_no, b.rank_no) - 1) // 1000 + 1)::INT AS level
 FROM toks t LEFT JOIN rank_list a ON a.form = t.token LEFT JOIN norm n ON n.token = t.token AND a.form IS NULL LEFT JOIN rank_list b ON b.form = n.to_head)"""


def sql(body: str) -> str:
    return with_toks(f"WITH {MAPPED}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().lstrip('+')}")


@R.query("SELECT form, head, rank_no AS rank, ((rank_no - 1) // 1000 + 1)::INT AS level FROM rank_list")
def rank_list(spark, sf):
    return ranks(spark, sf).select("form", "head", "rank", F.expr("int((rank - 1) div 1000) + 1").alias("level"))


@R.query("SELECT head, count(*)::BIGINT AS n_forms, min(rank_no)::INT AS rank, string_agg(form, ' ' ORDER BY form) AS forms FROM rank_list GROUP BY head")
def family_list(spark, sf):
    return ranks(spark, sf).groupBy("head").agg(F.count("*").alias("n_forms"), F.min("rank").alias("rank"), F.array_join(F.sort_array(F.collect_list("form")), " ").alias("forms"))


@R.query(sql("SELECT doc_id, pos, token, head, rank, level FROM mapped"))
def map_tokens(spark, sf):
    return mapped(spark, sf).select("doc_id", "pos", "token", "head", "rank", "level")


@R.query(sql(f"""+ n AS (SELECT doc_id, count(*) AS n FROM mapped GROUP BY 1), spine AS (SELECT doc_id, n, k FROM n, range(1, {LEVELS + 2}) r(k)),
 c AS (SELECT s.doc_id, s.n, s.k, count(m.pos) AS tokens, count(DISTINCT m.head) AS heads FROM spine s LEFT JOIN mapped m ON m.doc_id = s.doc_id AND coalesce(m.level, {LEVELS + 1}) = s.k GROUP BY ALL)
 SELECT doc_id, CASE WHEN k <= {LEVELS} THEN 'K' || k ELSE 'off-list' END AS level, tokens::BIGINT AS tokens, heads::BIGINT AS heads, round(100 * tokens / n, 6) AS coverage_pct,
 round(100 * sum(CASE WHEN k <= {LEVELS} THEN tokens ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) / n, 6) AS cumulative_pct FROM c"""))
def lfp(spark, sf):
    return rounded(P.lexical_profile(mapped(spark, sf), KEYS, LEVELS))


@R.query(sql(f"""SELECT d.doc_id, t.t::INT AS threshold, (SELECT min(k) FROM range(1, {LEVELS + 1}) r(k) WHERE 100 * list_count(list_filter(d.l, lambda x: x <= k)) >= t.t * d.n)::INT AS level
 FROM (SELECT doc_id, count(*) AS n, list(level) FILTER (level IS NOT NULL) AS l FROM mapped GROUP BY 1) d, (VALUES (90), (95), (98)) t(t)"""))
def coverage_threshold(spark, sf):
    return P.coverage_thresholds(mapped(spark, sf), KEYS, LEVELS)


@R.query(sql("""SELECT doc_id, round(count(DISTINCT head) FILTER (level > 2 OR level IS NULL) / sqrt(count(*)), 6) AS advanced_guiraud,
 round(100.0::DOUBLE * count(DISTINCT head) FILTER (level > 2 OR level IS NULL) / count(DISTINCT head), 6) AS pct_beyond_k, round(avg(rank), 6) AS mean_rank, round(avg(ln(rank)), 6) AS mean_log_rank,
 round(100.0::DOUBLE * count(*) FILTER (rank IS NULL) / count(*), 6) AS pct_off_list FROM mapped GROUP BY doc_id"""))
def sophistication(spark, sf):
    return rounded(P.sophistication(mapped(spark, sf), KEYS))


@R.query(sql("SELECT doc_id, round(count(DISTINCT head) FILTER (level > 2 OR level IS NULL) / sqrt(count(*)), 6) AS advanced_guiraud FROM mapped GROUP BY doc_id"))
def advanced_guiraud(spark, sf):
    return rounded(P.sophistication(mapped(spark, sf), KEYS).select("doc_id", "advanced_guiraud"))


@R.query(sql("SELECT doc_id, round(100.0::DOUBLE * count(DISTINCT head) FILTER (level > 2 OR level IS NULL) / count(DISTINCT head), 6) AS pct_beyond_k FROM mapped GROUP BY doc_id"))
def pct_beyond_k(spark, sf):
    return rounded(P.sophistication(mapped(spark, sf), KEYS).select("doc_id", "pct_beyond_k"))


@R.query(sql("SELECT doc_id, round(avg(rank), 6) AS mean_rank, round(avg(ln(rank)), 6) AS mean_log_rank, round(100.0::DOUBLE * count(*) FILTER (rank IS NULL) / count(*), 6) AS pct_off_list FROM mapped GROUP BY doc_id"))
def mean_rank(spark, sf):
    return rounded(P.sophistication(mapped(spark, sf), KEYS).select("doc_id", "mean_rank", "mean_log_rank", "pct_off_list"))


_SEG = """seg AS (SELECT doc_id, (pos - 1) // 10 AS s, count(*) AS n, count(*) FILTER (level > 1 OR level IS NULL) AS hard FROM mapped GROUP BY ALL),
 h AS (SELECT doc_id, hard AS k, count(*) AS c FROM seg WHERE n = 10 GROUP BY ALL), t AS (SELECT doc_id, sum(c) AS n, sum(k * c) / sum(c) AS mean_hard FROM h GROUP BY 1),
 o AS (SELECT t.doc_id, list(coalesce(h.c, 0) / t.n ORDER BY r.k) AS obs FROM t CROSS JOIN range(0, 11) r(k) LEFT JOIN h ON h.doc_id = t.doc_id AND h.k = r.k GROUP BY 1),
 hist AS (SELECT DISTINCT obs FROM o)"""
_ERR = "list_sum(list_transform(range(0, 11), lambda k: pow(obs[k + 1] - exp(-x) * pow(x, k) / gamma(k + 1), 2)))"
_FIT = f"""{_SEG}, g AS (SELECT obs, min(struct_pack(e := {_ERR}, x := x)).x AS b FROM (SELECT obs, i * 0.01::DOUBLE AS x FROM hist, range(0, 1001) r(i)) GROUP BY obs),
 fit AS (SELECT obs, min(struct_pack(e := {_ERR}, x := x)).x AS lam FROM (SELECT obs, b AS x FROM g UNION ALL SELECT obs, b - 0.01::DOUBLE + i * 0.0005::DOUBLE AS x FROM g, range(0, 41) r(i)) WHERE x BETWEEN 0 AND 10 GROUP BY obs)"""


@R.query(sql(f"+ {_FIT} SELECT a.doc_id, coalesce(t.n, 0)::BIGINT AS n_segments, round(lam, 4) AS \"lambda\", round(t.mean_hard, 6) AS mean_hard FROM (SELECT DISTINCT doc_id FROM mapped) a LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN fit USING (obs)"))
def p_lex(spark, sf):
    fit = P.p_lex(mapped(spark, sf), KEYS)
    return fit.select("doc_id", "n_segments", F.round("lambda", 4).alias("lambda"), F.round("mean_hard", 6).alias("mean_hard"))


@R.query(sql(f"+ {_FIT} SELECT doc_id, r.k::INT AS k, round(obs[r.k + 1], 6) AS observed, round(exp(-lam) * pow(lam, r.k) / gamma(r.k + 1), 4) AS fitted FROM o JOIN fit USING (obs), range(0, 11) r(k)"))
def p_lex_dist(spark, sf):
    rows = P.p_lex_distribution(P.p_lex(mapped(spark, sf), KEYS), KEYS)
    return rows.select("doc_id", "k", F.round("observed", 6).alias("observed"), F.round("fitted", 4).alias("fitted"))


_COV = "cov AS (SELECT doc_id, count(*) AS n, " + ", ".join(f"100.0::DOUBLE * count(*) FILTER (rank <= {x}) / count(*) AS c{x}" for x in P.S_RANKS) + " FROM mapped GROUP BY doc_id)"
_SSE = " + ".join(f"pow(c{x} - 100 * ln({x}) / ln(s), 2)" for x in P.S_RANKS)


@R.query(sql(f"""+ {_COV}, a AS (SELECT doc_id, min(struct_pack(e := {_SSE}, s := s)).s AS b FROM cov, range(200, 30001, 50) r(s) WHERE n >= 50 GROUP BY 1),
 b AS (SELECT doc_id, min(struct_pack(e := {_SSE}, s := s)).s AS s FROM cov JOIN a USING (doc_id), range(-50, 51) r(d), LATERAL (SELECT b + d AS s) WHERE b + d BETWEEN 200 AND 30000 GROUP BY 1)
 SELECT cov.doc_id, b.s::DOUBLE AS s, (b.s >= 30000) AS capped FROM cov LEFT JOIN b USING (doc_id)"""))
def s_index(spark, sf):
    return P.s_index(mapped(spark, sf), KEYS).select("doc_id", "s", "capped")


@R.query(sql(f"+ {_COV} SELECT doc_id, x::INT AS rank, round(c, 2) AS coverage_pct FROM (" + " UNION ALL ".join(f"SELECT doc_id, {x} AS x, c{x} AS c FROM cov WHERE n >= 50" for x in P.S_RANKS) + ")"))
def s_empirical(spark, sf):
    wide = P.s_index(mapped(spark, sf), KEYS).filter("s is not null")
    return wide.select("doc_id", F.inline(F.array(*(F.struct(F.lit(x).alias("rank"), F.round(f"cov_{x}", 2).alias("coverage_pct")) for x in P.S_RANKS))))


@R.query(sql(f"""+ bt AS (SELECT doc_id, coalesce(level, 0) AS level, head, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS p, count(*) OVER (PARTITION BY doc_id, level) AS n FROM mapped WHERE level IS NULL OR level <= {LEVELS}),
 base AS (SELECT doc_id, level, count(*) AS tokens, count(DISTINCT head) AS types FROM bt GROUP BY ALL),
 ma AS (SELECT doc_id, level, sum(v) / (any_value(w) * count(*)) AS mattr FROM (SELECT doc_id, level, p, n, least(50, n) AS w, (count(DISTINCT head) OVER (PARTITION BY doc_id, level ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))::DOUBLE AS v FROM bt) WHERE p <= n - w + 1 GROUP BY ALL),
 hd AS (SELECT doc_id, level, least(1, sum((1 - CASE WHEN n - c < s THEN 0 ELSE exp(lgamma(n - c + 1) - lgamma(n - c - s + 1) - lgamma(n + 1) + lgamma(n - s + 1)) END) / s)) AS hdd
  FROM (SELECT doc_id, level, c, n, least(42, n) AS s FROM (SELECT doc_id, level, count(*)::DOUBLE AS c, (sum(count(*)) OVER (PARTITION BY doc_id, level))::DOUBLE AS n FROM bt GROUP BY doc_id, level, head)) GROUP BY ALL)
 SELECT doc_id, level::INT AS level, tokens::BIGINT AS tokens, types::BIGINT AS types, round(mattr, 6) AS mattr, round(hdd, 6) AS hdd, 50 AS min_n FROM base JOIN ma USING (doc_id, level) JOIN hd USING (doc_id, level)"""))
def band_wise(spark, sf):
    return rounded(P.band_wise(mapped(spark, sf), KEYS, LEVELS)).drop("mtld")


@R.query()
def band_wise_mtld(spark, sf):
    return rounded(P.band_wise_mtld(mapped(spark, sf), KEYS, LEVELS))


@R.query(sql("""+ f AS (SELECT doc_id, head, rank, level, token, count(*) AS c FROM mapped GROUP BY ALL), g AS (SELECT doc_id, head, rank, level, sum(c)::BIGINT AS tokens, count(*) AS k,
 list(CASE WHEN c > 1 THEN token || ' (' || c || ')' ELSE token END ORDER BY c DESC, token) AS l FROM f GROUP BY ALL)
 SELECT doc_id, head, rank, level, tokens, round(100.0::DOUBLE * tokens / sum(tokens) OVER (PARTITION BY doc_id), 6) AS coverage_pct,
 array_to_string(l[1:8], ', ') || CASE WHEN k > 8 THEN ', +' || (k - 8) || ' more' ELSE '' END AS token_forms FROM g"""))
def lookup_profile(spark, sf):
    return rounded(P.lookup_profile(mapped(spark, sf), KEYS))


@R.query("""SELECT form, array_to_string(list_sort(list_distinct(list(h))), '|') AS heads FROM (
 SELECT translate(lower(trim(form)), '’ʼ', '''''') AS form, translate(lower(trim(x)), '’ʼ', '''''') AS h FROM (SELECT form, unnest(heads) AS x FROM flemma_forms)) WHERE form <> '' AND h <> '' GROUP BY form""")
def flemma_lexicon(spark, sf):
    return N.lexicon(table(spark, sf, "flemma_forms")).select("form", F.array_join("heads", "|").alias("heads"))


def _cut(k, add=""):
    return f"w[:-{k + 1}]" + (f" || '{add}'" if add else "")


def _undouble(k):
    return f"CASE WHEN len(w) - {k} >= 4 AND w[-{k + 1}] = w[-{k + 2}] AND w[-{k + 1}] NOT IN ('a', 'e', 'i', 'o', 'u') THEN {_cut(k + 1)} END"


_RULES = [
    ("ies", 4, [_cut(3, "y"), _cut(1)]), ("ves", 4, [_cut(3, "f"), _cut(3, "fe"), _cut(1)]), ("es", 3, [_cut(2), _cut(1)]), ("s", 3, [_cut(1)]), ("ied", 4, [_cut(3, "y")]),
    ("ed", 4, [_cut(2), _cut(1), _undouble(2)]), ("ying", 5, [_cut(4, "ie")]), ("ing", 5, [_cut(3), _cut(3, "e"), _undouble(3)]), ("ier", 4, [_cut(3, "y")]),
    ("iest", 5, [_cut(4, "y")]), ("er", 4, [_undouble(2), _cut(2, "e")]), ("est", 5, [_undouble(3), _cut(3, "e")]),
]
_ALSO = " AND NOT regexp_matches(w, '(ss|us|is)$') AND w NOT IN ('" + "','".join(N.SINGULAR_S) + "')"
_CASES = ", ".join(f"CASE WHEN ends_with(w, '{s}') AND len(w) > {n}{_ALSO if s == 's' else ''} THEN {c} END" for s, n, cs in _RULES for c in cs)
# the order of first occurrence
_CAND = f"CASE WHEN len(w) < 3 OR contains(w, '''') THEN []::VARCHAR[] ELSE list_filter(list_transform(list_zip(l, range(1, len(l) + 1)), lambda z: CASE WHEN list_position(l, z[1]) = z[2] THEN z[1] END), lambda x: x IS NOT NULL AND len(x) >= 2) END"


@R.query(with_toks(f"WITH v AS (SELECT DISTINCT token AS w FROM toks), r AS (SELECT w, [{_CASES}] AS l FROM v) SELECT w AS token, array_to_string({_CAND}, ' ') AS candidates FROM r"))
def inflection_candidates(spark, sf):
    return toks(spark, sf).select("token").distinct().select("token", F.array_join(N.candidates("token"), " ").alias("candidates"))


_IRR = ", ".join(f"('{f}','{h}')" for f, h in N.irregular_pairs())
_RESOLVE = "CASE WHEN i.h IS NOT NULL THEN i.h WHEN x.heads IS NOT NULL THEN CASE WHEN len(x.heads) = 1 THEN x.heads[1] ELSE v.w END WHEN k.head IS NOT NULL THEN v.w ELSE coalesce(o.one, v.w) END"


@R.query(with_toks(f"""WITH irr(w, h) AS (VALUES {_IRR}), lex AS (SELECT form, list_sort(list_distinct(list(h))) AS heads FROM (SELECT translate(lower(trim(form)), '’ʼ', '''''') AS form, translate(lower(trim(x)), '’ʼ', '''''') AS h FROM (SELECT form, unnest(heads) AS x FROM flemma_forms)) WHERE form <> '' AND h <> '' GROUP BY form),
 known AS (SELECT DISTINCT unnest(heads) AS head FROM lex UNION SELECT DISTINCT head FROM rank_list),
 voc AS (SELECT DISTINCT token AS w FROM toks), inner_v AS (SELECT w FROM voc UNION SELECT w[:-2] FROM voc WHERE ends_with(w, 's''') AND len(w) > 3),
 cand AS (SELECT DISTINCT w, unnest(l) AS c FROM (SELECT w, [{_CASES}] AS l FROM inner_v WHERE len(w) >= 3 AND NOT contains(w, ''''))),
 poss AS (SELECT w, w[:-3] AS c FROM inner_v WHERE ends_with(w, '''s') AND len(w) > 3 AND w[:-3] NOT IN ('{"','".join(N.CONTRACTED)}')),
 valid AS (SELECT DISTINCT w, c FROM (SELECT * FROM cand WHERE len(c) >= 2 UNION SELECT * FROM poss) WHERE c IN (SELECT head FROM known)),
 o AS (SELECT w, min(c) AS one FROM valid GROUP BY w HAVING count(*) = 1),
 n1 AS (SELECT v.w, {_RESOLVE} AS head FROM inner_v v LEFT JOIN irr i ON i.w = v.w LEFT JOIN lex x ON x.form = v.w LEFT JOIN known k ON k.head = v.w LEFT JOIN o ON o.w = v.w),
 p2 AS (SELECT voc.w, n1.head AS one FROM voc JOIN n1 ON n1.w = voc.w[:-2] WHERE ends_with(voc.w, 's''') AND len(voc.w) > 3 AND (n1.head <> n1.w OR n1.head IN (SELECT head FROM known)))
 SELECT v.w AS token, {_RESOLVE.replace('o.one', 'p2.one, o.one')} AS head FROM voc v LEFT JOIN irr i ON i.w = v.w LEFT JOIN lex x ON x.form = v.w LEFT JOIN known k ON k.head = v.w LEFT JOIN o ON o.w = v.w LEFT JOIN p2 ON p2.w = v.w"""))
def flemma_normalize(spark, sf):
    vocab = toks(spark, sf).select("token").distinct()
    return N.flemma(vocab, table(spark, sf, "flemma_forms"), table(spark, sf, "rank_list").select("head").distinct())
