"""Queries of tokens and lexical diversity over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import diversity as D
from lexweave.plans.registry import Registry, with_toks
from lexweave.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
KEYS = ["doc_id"]


def toks(spark, sf):
    return T.tokens(table(spark, sf, "documents"))


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@R.query("""SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_tokens, coalesce(len(list_distinct(list_transform(l, lambda x: lower(x)))), 0)::BIGINT AS n_types
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS l FROM documents)""")
def tokenize_counts(spark, sf):
    arr = T.token_array("text")
    return table(spark, sf, "documents").select("doc_id", F.size(arr).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(arr)).cast("bigint").alias("n_types"))


@R.query(with_toks("SELECT doc_id, pos, surface, token FROM toks"))
def tokens(spark, sf):
    return toks(spark, sf)


@R.query("""SELECT d.doc_id, k.k::INT AS k, array_to_string(list_transform(l[1:k.k], lambda x: lower(x)), ' ') AS prefix
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS l FROM documents WHERE text IS NOT NULL) d, (VALUES (100), (150), (200)) k(k) WHERE len(l) >= k.k""")
def token_prefix(spark, sf):
    arr = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.token_array("text").alias("l"))
    each = arr.select("doc_id", "l", F.explode(F.array(F.lit(100), F.lit(150), F.lit(200))).alias("k")).filter(F.size("l") >= F.col("k"))
    return each.select("doc_id", "k", F.array_join(F.expr("slice(l, 1, k)"), " ").alias("prefix"))


@R.query("""SELECT doc_id, n::BIGINT AS n_words, (n BETWEEN 225 AND 275) AS in_range FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)?')) AS n FROM documents WHERE text IS NOT NULL)""")
def word_count_check(spark, sf):
    n = F.regexp_count("text", F.lit(T.WORD_COUNT)).cast("bigint")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", n.alias("n_words"), n.between(225, 275).alias("in_range"))


@R.query()
def treebank_tokens(spark, sf):
    docs = T.compatible_texts(table(spark, sf, "documents").select("doc_id", "text").filter("text is not null"))
    return docs.select("doc_id", F.posexplode(T.word_split("text")).alias("pos", "token"))


_BASIC = with_toks("""SELECT doc_id, n_tokens, n_types, round(v/n, 6) AS ttr, round(v/sqrt(n), 6) AS rttr, round(v/sqrt(2*n), 6) AS cttr,
 CASE WHEN n > 1 THEN round(ln(v)/ln(n), 6) END AS herdan, CASE WHEN n > 1 THEN round((ln(n)-ln(v))/pow(ln(n), 2), 6) END AS maas,
 round(1e4*(m2-n)/(n*n), 6) AS yule_k, round(v*v/nullif(m2-v, 0), 6) AS yule_i
FROM (SELECT doc_id, sum(c)::BIGINT AS n_tokens, count(*)::BIGINT AS n_types, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, sum(c*c)::DOUBLE AS m2
 FROM (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY ALL) GROUP BY doc_id)""")


@R.query(_BASIC)
def panel_a_basic(spark, sf):
    return rounded(D.basic(toks(spark, sf), KEYS))


@R.query(with_toks("SELECT doc_id, c::BIGINT AS freq, count(*)::BIGINT AS n_types FROM (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY ALL) GROUP BY ALL"))
def frequency_spectrum(spark, sf):
    return D.spectrum(toks(spark, sf), KEYS)


_MSTTR = """SELECT doc_id, round(avg(v / l), 6) AS msttr FROM (SELECT doc_id, (pos - 1) // l AS seg, l, count(*) AS n, count(DISTINCT token)::DOUBLE AS v
 FROM (SELECT *, least(50, count(*) OVER (PARTITION BY doc_id)) AS l FROM toks) GROUP BY ALL) WHERE n = l GROUP BY doc_id"""


@R.query(with_toks(_MSTTR))
def msttr(spark, sf):
    return rounded(D.msttr(toks(spark, sf), KEYS))


_MATTR = """SELECT doc_id, round(sum(v) / (any_value(w) * count(*)), 6) AS mattr FROM (
 SELECT doc_id, pos, n, least(50, n) AS w, (count(DISTINCT token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))::DOUBLE AS v
 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM toks)) WHERE pos <= n - w + 1 GROUP BY doc_id"""


@R.query(with_toks(_MATTR))
def mattr(spark, sf):
    return rounded(D.mattr(toks(spark, sf), KEYS))


_STATE = "{'s': 1::BIGINT, 't': 0::BIGINT, 'c': 0::BIGINT, 'f': 0::DOUBLE, 'p': 0::BIGINT, 'q': 0::BIGINT}"
_FOLD = f"""list_reduce(list({{'s': 1::BIGINT, 't': 0::BIGINT, 'c': 0::BIGINT, 'f': 0::DOUBLE, 'p': p::BIGINT, 'q': q::BIGINT}} ORDER BY p),
 lambda a, x: CASE WHEN (a.t + CASE WHEN x.q < a.s THEN 1 ELSE 0 END)::DOUBLE / (a.c + 1) <= 0.72::DOUBLE AND a.c + 1 >= 10
  THEN {{'s': x.p + 1, 't': 0::BIGINT, 'c': 0::BIGINT, 'f': a.f + 1, 'p': x.p, 'q': x.q}}
  ELSE {{'s': a.s, 't': a.t + CASE WHEN x.q < a.s THEN 1 ELSE 0 END, 'c': a.c + 1, 'f': a.f, 'p': x.p, 'q': x.q}} END, {_STATE})"""
_MTLD = f"""link AS (SELECT doc_id, pos, coalesce(lag(pos) OVER s, 0) AS prev, lead(pos) OVER s AS nxt, count(*) OVER (PARTITION BY doc_id) AS n FROM toks WINDOW s AS (PARTITION BY doc_id, token ORDER BY pos)),
 f AS (SELECT doc_id, count(*) AS n, {_FOLD} AS e FROM (SELECT doc_id, pos AS p, prev AS q FROM link) GROUP BY doc_id),
 b AS (SELECT doc_id, {_FOLD} AS e FROM (SELECT doc_id, n + 1 - pos AS p, coalesce(n + 1 - nxt, 0) AS q FROM link) GROUP BY doc_id),
 r AS (SELECT f.doc_id, n / nullif(f.e.f + CASE WHEN f.e.c > 0 THEN (1 - f.e.t::DOUBLE / f.e.c) / (1 - 0.72::DOUBLE) ELSE 0 END, 0) AS x,
  n / nullif(b.e.f + CASE WHEN b.e.c > 0 THEN (1 - b.e.t::DOUBLE / b.e.c) / (1 - 0.72::DOUBLE) ELSE 0 END, 0) AS y FROM f JOIN b USING (doc_id))"""


@R.query(with_toks(f"WITH {_MTLD} SELECT doc_id, round(x, 6) AS mtld_forward, round(y, 6) AS mtld_backward, round(coalesce((x + y) / 2, x, y), 6) AS mtld FROM r"))
def mtld(spark, sf):
    return rounded(D.mtld(toks(spark, sf), KEYS))


_HDD = """SELECT doc_id, round(least(1, sum((1 - CASE WHEN n - c < s THEN 0 ELSE exp(lgamma(n - c + 1) - lgamma(n - c - s + 1) - lgamma(n + 1) + lgamma(n - s + 1)) END) / s)), 6) AS hdd
 FROM (SELECT doc_id, c, n, least(42, n) AS s FROM (SELECT doc_id, count(*)::DOUBLE AS c, (sum(count(*)) OVER (PARTITION BY doc_id))::DOUBLE AS n FROM toks GROUP BY doc_id, token)) GROUP BY doc_id"""


@R.query(with_toks(_HDD))
def hdd(spark, sf):
    return rounded(D.hdd(toks(spark, sf), KEYS))


@R.query()
def vocd(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.token_array("text").alias("tokens")).filter(F.size("tokens") > 0)
    return rounded(D.vocd(docs, KEYS))


@R.query()
def vocd_expected(spark, sf):
    return rounded(D.vocd_expected(toks(spark, sf), KEYS))


@R.query(with_toks("SELECT doc_id, index_key, (CASE WHEN f.floor > 1 THEN greatest(f.floor, f.setting) ELSE f.floor END)::INT AS required, n >= (CASE WHEN f.floor > 1 THEN greatest(f.floor, f.setting) ELSE f.floor END) AS enough "
                   "FROM (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id), (VALUES ('ttr',1,0),('rttr',1,0),('cttr',1,0),('herdan',2,0),('maas',2,0),('msttr',50,50),('mattr',50,80),('mtld',50,0),('hdd',42,60),('vocd',50,50),('yule_k',100,0),('yule_i',100,0)) f(index_key, floor, setting)"))
def effective_min_tokens(spark, sf):
    counts = table(spark, sf, "documents").select("doc_id", F.size(T.surfaces("text")).alias("n")).filter("n > 0")
    need = F.array(*(F.struct(F.lit(k).alias("index_key"), F.lit(D.required_tokens(k, window=80, hdd_sample=60)).alias("required")) for k in D.INDICES))
    return counts.select("doc_id", "n", F.inline(need)).select("doc_id", "index_key", "required", (F.col("n") >= F.col("required")).alias("enough"))


@R.query(with_toks(f"""WITH {_MTLD}, ba AS ({_BASIC.removeprefix(with_toks('').rstrip())}), ms AS ({_MSTTR}), ma AS ({_MATTR}), hd AS ({_HDD})
 SELECT ba.*, msttr, mattr, round(coalesce((x + y) / 2, x, y), 6) AS mtld, hdd FROM ba LEFT JOIN ms USING (doc_id) LEFT JOIN ma USING (doc_id) LEFT JOIN hd USING (doc_id) LEFT JOIN r USING (doc_id)"""))
def panel_a(spark, sf):
    return rounded(D.panel_a(toks(spark, sf), KEYS))


@R.query(with_toks("""SELECT DISTINCT surface, (regexp_full_match(surface, '[A-Z'']+') AND len(replace(surface, '''', '')) > 1) AS uppercase,
 (surface[1] BETWEEN 'A' AND 'Z' AND len(replace(surface, '''', '')) > 1 AND NOT regexp_full_match(surface, '[A-Z'']+')) AS capitalized,
 CASE WHEN len(surface) >= 5 THEN (SELECT min_by(s, o) FROM (SELECT unnest(sx) AS s, unnest(range(len(sx))) AS o FROM (SELECT string_split('""" + " ".join(T.SUFFIXES) + """', ' ') AS sx)) WHERE ends_with(lower(surface), s)) END AS suffix FROM toks"""))
def surface_classes(spark, sf):
    forms = toks(spark, sf).select("surface").distinct()
    return forms.select("surface", T.is_uppercase("surface").alias("uppercase"), T.is_capitalized("surface").alias("capitalized"), T.suffix_of("surface").alias("suffix"))
