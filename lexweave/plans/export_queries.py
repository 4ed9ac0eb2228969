"""Queries of result tables: the wide summary and what is derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.config import AnalysisConfig
from lexweave.functions import text as T
from lexweave.operators import batch as B
from lexweave.operators import diversity as D
from lexweave.operators import export as E
from lexweave.operators import profile as P
from lexweave.plans.diversity_queries import _BASIC, KEYS, rounded, toks
from lexweave.plans.profile_queries import LEVELS, mapped, sql
from lexweave.plans.registry import Registry, with_toks
from lexweave.session import table
from lexweave.streaming import documents as S

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _summary(spark, sf):
    m = mapped(spark, sf)
    return E.summary(D.panel_a(toks(spark, sf), KEYS), P.sophistication(m, KEYS), P.p_lex(m, KEYS).select("doc_id", "lambda"), P.s_index(m, KEYS).select("doc_id", "s", "capped"), keys=KEYS)


@R.query()
def summary(spark, sf):
    return rounded(_summary(spark, sf))


_M = ("ttr", "rttr", "cttr", "herdan", "maas", "yule_k", "yule_i")
_RAW = with_toks("""WITH b AS (SELECT doc_id, n, v, v/n AS ttr, v/sqrt(n) AS rttr, v/sqrt(2*n) AS cttr, CASE WHEN n > 1 THEN ln(v)/ln(n) END AS herdan, CASE WHEN n > 1 THEN (ln(n)-ln(v))/pow(ln(n), 2) END AS maas, 1e4*(m2-n)/(n*n) AS yule_k, v*v/nullif(m2-v, 0) AS yule_i
 FROM (SELECT doc_id, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, sum(c*c)::DOUBLE AS m2 FROM (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY ALL) GROUP BY doc_id))""")


@R.query(_RAW + ", l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, {m} AS x FROM b" for m in _M) + """) SELECT measure, count(x)::BIGINT AS n, (count(*) - count(x))::BIGINT AS missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS min,
 round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max FROM l GROUP BY measure""")
def descriptives(spark, sf):
    return rounded(E.descriptives(D.basic(toks(spark, sf), KEYS), list(_M)))


@R.query(_RAW + ", l AS (" + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS index_key, '{D.PRETTY[m].replace(chr(39), chr(39) * 2)}' AS index, {m} AS value, '{'lower' if m in D.LOWER_IS_DIVERSE else 'higher'}' AS direction FROM b" for m in _M) + ") SELECT doc_id, index_key, index, round(value, 6) AS value, direction FROM l")
def panel_a_long(spark, sf):
    return rounded(D.long_form(D.basic(toks(spark, sf), KEYS), KEYS))


@R.query(sql(f"""SELECT d.doc_id, t.t::INT AS threshold, coalesce('K' || (SELECT min(k) FROM range(1, {LEVELS + 1}) r(k) WHERE 100 * list_count(list_filter(d.l, lambda x: x <= k)) >= t.t * d.n), 'not reached by selected list') AS reached
 FROM (SELECT doc_id, count(*) AS n, list(level) FILTER (level IS NOT NULL) AS l FROM mapped GROUP BY 1) d, (VALUES (90), (95), (98)) t(t)"""))
def threshold_rows(spark, sf):
    return E.threshold_rows(P.coverage_thresholds(mapped(spark, sf), KEYS, LEVELS), KEYS)


@R.query()
def p_lex_s_rows(spark, sf):
    m = mapped(spark, sf)
    return rounded(E.fit_rows(P.p_lex(m, KEYS), P.s_index(m, KEYS), KEYS), 4)


@R.query("""SELECT doc_id, e.n AS name, e.v AS value FROM (SELECT doc_id, unnest([""" + ", ".join("{'n': '%s', 'v': '%s'}" % (k, v.replace("'", "''")) for k, v in [("version", '"1"'), *((k, __import__("json").dumps(v)) for k, v in AnalysisConfig().items()), *((f"note_{i + 1}", __import__("json").dumps(n)) for i, n in enumerate(AnalysisConfig().notes()))]) + "]) AS e FROM documents)")
def metadata(spark, sf):
    return E.metadata(table(spark, sf, "documents").select("doc_id"), AnalysisConfig())


@R.query()
def json_payload(spark, sf):
    return E.payload(D.basic(toks(spark, sf), KEYS), KEYS)


@R.query()
def content_fingerprint(spark, sf):
    return E.fingerprint(table(spark, sf, "rank_list"))


@R.query(f"SELECT doc_id, n_tokens, n_types, ttr, rttr, cttr FROM ({_BASIC})")
def stream_basic(spark, sf):
    """The stateless stream columns on a table."""
    return rounded(S.basic_columns(table(spark, sf, "documents"))).drop("msttr")


@R.query("SELECT d.doc_id, format('Document {:03d}', row_number() OVER (ORDER BY doc_id)) AS document FROM documents d")
def document_labels(spark, sf):
    """Labels by order of id: ordinals from counts per range of ids, so no single task orders all rows."""
    ids = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("order"))
    return B.ordinal_labels(ids, "order").select("doc_id", "document")


@R.query()
def surface_keys(spark, sf):
    """Normal forms of lexicon entries for graph lookups."""
    f = table(spark, sf, "flemma_forms").select("entry_id", "form").filter("form is not null")
    return f.select("entry_id", T.lemma_key("form").alias("lemma_key"), T.flemma_form("form").alias("flemma_form"), T.is_lookup_form("form").alias("lookup"))
