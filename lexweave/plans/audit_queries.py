"""Queries of audits, duplicate checks, request budgets and held-out-group regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import audit as A
from lexweave.operators import guard as U
from lexweave.plans.diversity_queries import rounded
from lexweave.plans.registry import Registry, with_toks
from lexweave.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_S = A.SCORES
_OK = lambda c: f"({c} BETWEEN 1 AND 5 AND {c} * 2 = floor({c} * 2))"


@R.query(f"""SELECT lower(trim(set_name)) AS split, count(*)::BIGINT AS rows, (count(text_id_kaggle) - count(DISTINCT text_id_kaggle))::BIGINT AS repeated_ids, count(*) FILTER (full_text IS NULL OR trim(full_text) = '')::BIGINT AS blank_texts,
 count(*) FILTER (prompt IS NULL OR trim(prompt) = '')::BIGINT AS blank_prompts, count(*) FILTER (task IS NULL OR lower(trim(task)) NOT IN ('independent', 'integrated', 'text dependent'))::BIGINT AS bad_tasks,
 sum({' + '.join(f'({c} IS NULL)::INT' for c in _S)})::BIGINT AS missing_scores, sum({' + '.join(f'coalesce((NOT {_OK(c)})::INT, 0)' for c in _S)})::BIGINT AS scores_off_scale, count(DISTINCT lower(trim(prompt)))::BIGINT AS prompts,
 min(overall) FILTER ({_OK('overall')}) AS least_overall, max(overall) FILTER ({_OK('overall')}) AS most_overall, coalesce(lower(trim(set_name)) IN ('train', 'validation', 'test'), false) AS known_split FROM essays GROUP BY 1""")
def audit_split(spark, sf):
    return A.split_audit(table(spark, sf, "essays"))


@R.query("""WITH k AS (SELECT lower(trim(set_name)) AS s, lower(trim(text_id_kaggle)) AS id, full_text AS t, lower(trim(prompt)) AS p FROM essays), pr(a, b) AS (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test'))
 SELECT a AS split_a, b AS split_b, (SELECT count(*) FROM (SELECT id FROM k WHERE s = a AND id <> '' INTERSECT SELECT id FROM k WHERE s = b))::BIGINT AS shared_ids, (SELECT count(*) FROM (SELECT t FROM k WHERE s = a AND t IS NOT NULL INTERSECT SELECT t FROM k WHERE s = b))::BIGINT AS shared_texts,
 (SELECT count(*) FROM (SELECT p FROM k WHERE s = a AND p <> '' INTERSECT SELECT p FROM k WHERE s = b))::BIGINT AS shared_prompts,
 NOT EXISTS ((SELECT p FROM k WHERE s = a AND p <> '' EXCEPT SELECT p FROM k WHERE s = b) UNION ALL (SELECT p FROM k WHERE s = b AND p <> '' EXCEPT SELECT p FROM k WHERE s = a)) AS same_prompts FROM pr""")
def audit_combined(spark, sf):
    return A.combined_audit(table(spark, sf, "essays"))


_CLASS = "cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS class_id, count(*) OVER (PARTITION BY n) AS n_copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS n FROM documents) WHERE n <> '')"


@R.query(f"WITH {_CLASS} SELECT doc_id, class_id, n_copies::BIGINT AS n_copies FROM cl")
def exact_duplicates(spark, sf):
    return A.exact_classes(table(spark, sf, "documents"), unicode=False)


_NEAR = with_toks(f"""WITH {_CLASS}, sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, pos, token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w || ' ' || lead(token, 3) OVER w || ' ' || lead(token, 4) OVER w AS s
  FROM toks WHERE doc_id IN (SELECT class_id FROM cl) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE s IS NOT NULL), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT doc_a, doc_b, shared::INT AS shared, (x.n + y.n - shared)::INT AS united, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS resemblance FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE shared >= 0.85 * (x.n + y.n - shared)""")


@R.query(_NEAR)
def near_duplicates_5gram(spark, sf):
    return rounded(A.near_duplicates(table(spark, sf, "documents"), unicode=False))


_ESSAYS = "WITH es AS (SELECT essay_row AS doc_id, full_text AS text FROM essays), " + _NEAR.removeprefix("WITH ").replace("documents", "es")


def _essay_texts(spark, sf):
    return table(spark, sf, "essays").select(F.col("essay_row").alias("doc_id"), F.col("full_text").alias("text"))


@R.query(_ESSAYS)
def near_duplicate_essays(spark, sf):
    return rounded(A.near_duplicates(_essay_texts(spark, sf), unicode=False))


@R.query("WITH es AS (SELECT essay_row AS doc_id, full_text AS text FROM essays), " + _CLASS.replace("documents", "es") + " SELECT doc_id, class_id, n_copies::BIGINT AS n_copies FROM cl")
def exact_duplicate_essays(spark, sf):
    """The class of every essay; its representatives are those of ``near_duplicate_essays``."""
    return A.exact_classes(_essay_texts(spark, sf), unicode=False)


# The same on texts in composed form (NFC) with Unicode whitespace collapsed.
_NFC_CLASS = "cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS class_id, count(*) OVER (PARTITION BY n) AS n_copies FROM (SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '" + A.SPACES + "', ' ', 'g')) AS n FROM documents) WHERE n <> '')"
_NFC_NEAR = _NEAR.replace(_CLASS, _NFC_CLASS).replace("regexp_extract_all(text,", "regexp_extract_all(nfc_normalize(text),")
_of_essays = lambda sql: "WITH es AS (SELECT essay_row AS doc_id, full_text AS text FROM essays), " + sql.removeprefix("WITH ").replace("documents", "es")


@R.query(f"WITH {_NFC_CLASS} SELECT doc_id, class_id, n_copies::BIGINT AS n_copies FROM cl")
def exact_duplicates_nfc(spark, sf):
    return A.exact_classes(table(spark, sf, "documents"))


@R.query(_NFC_NEAR)
def near_duplicates_5gram_nfc(spark, sf):
    return rounded(A.near_duplicates(table(spark, sf, "documents")))


@R.query(_of_essays(f"WITH {_NFC_CLASS} SELECT doc_id, class_id, n_copies::BIGINT AS n_copies FROM cl"))
def exact_duplicate_essays_nfc(spark, sf):
    """The class of every essay; its representatives are those of ``near_duplicate_essays_nfc``."""
    return A.exact_classes(_essay_texts(spark, sf))


@R.query(_of_essays(_NFC_NEAR))
def near_duplicate_essays_nfc(spark, sf):
    return rounded(A.near_duplicates(_essay_texts(spark, sf)))


# The schedule of a session as a fold: clock, full_at, rest_until, counts, and what was said so far (o).
_NOW, _LATE = "greatest(a.clk, x.t)", "(greatest(0, a.fu - greatest(a.clk, x.t)) + 30000000 * greatest(x.d, 20))"
_RUN = "CASE x.r WHEN 1 THEN 0 WHEN 0 THEN a.f + 1 ELSE a.f END"


def _state(clk="a.clk", fu="a.fu", re="a.re", n="a.n", ok="a.ok", f="a.f", said="", wait="0"):
    out = f"{{'id': x.id, 'said': '{said}', 'wait': ({wait})::BIGINT, 'owed': greatest(0, ({fu}) - ({clk}))::BIGINT, 'n': {n}, 'ok': {ok}, 'f': {f}}}"
    return f"{{'clk': {clk}, 'fu': {fu}, 're': {re}, 'n': {n}, 'ok': {ok}, 'f': {f}, 'id': x.id, 't': x.t, 'd': x.d, 'r': x.r, 'o': list_append(a.o, {out})}}"


_ZERO = "{'clk': -4000000000000000000::BIGINT, 'fu': -4000000000000000000::BIGINT, 're': 0::BIGINT, 'n': 0, 'ok': 0, 'f': 0, 'id': %s::BIGINT, 't': %s::BIGINT, 'd': %s::INT, 'r': %s, 'o': []::STRUCT(id BIGINT, said VARCHAR, wait BIGINT, owed BIGINT, n INT, ok INT, f INT)[]}"
_FOLDED = f"""WITH one AS (SELECT session_key, ts, documents, success, min(request_id) AS id FROM guard_requests GROUP BY ALL),
 q AS (SELECT session_key, list({_ZERO % ('id', 'coalesce(epoch_us(ts), 0)', 'documents', 'CASE WHEN success THEN 1 WHEN NOT success THEN 0 ELSE 2 END')} ORDER BY coalesce(epoch_us(ts), 0), id) AS l FROM one WHERE session_key IS NOT NULL GROUP BY 1),
 z AS (SELECT session_key, unnest(list_reduce(l, lambda a, x: CASE WHEN coalesce(x.d, 0) < 1 THEN {_state(said='invalid')} WHEN x.d > 200 THEN {_state(said='over_capacity')}
  WHEN x.t < a.re THEN {_state(clk=_NOW, said='cooldown', wait='greatest(1, (a.re - x.t + 999999) // 1000000)')}
  WHEN {_LATE} > 6000000000 THEN {_state(clk=_NOW, said='budget', wait=f'greatest(1, ({_LATE} - 6000000000 + 999999) // 1000000)')}
  ELSE {_state(clk=_NOW, fu=f'{_NOW} + {_LATE}', re=f'CASE WHEN x.r = 0 AND a.f + 1 >= 3 THEN greatest(a.re, x.t + 120000000) ELSE a.re END', n='a.n + 1', ok='a.ok + (x.r = 1)::INT', f=_RUN, said='allowed')} END, {_ZERO % (0, 0, 0, 0)}).o) AS e FROM q)"""


@R.query(_FOLDED + """ SELECT session_key, max(e.n)::INT AS attempts, max(e.ok)::INT AS successes, count(*) FILTER (e.said = 'budget')::BIGINT AS over_budget, count(*) FILTER (e.said = 'cooldown')::BIGINT AS in_cooldown
 FROM z WHERE e.said NOT IN ('invalid', 'over_capacity') GROUP BY 1""")
def query_guard(spark, sf):
    d = U.decisions(U.once(table(spark, sf, "guard_requests"))).filter("session_key is not null and decision not in ('invalid', 'over_capacity')")
    return d.groupBy("session_key").agg(F.max("attempts").alias("attempts"), F.max("successes").alias("successes"), F.count(F.when(F.col("decision") == "budget", 1)).alias("over_budget"), F.count(F.when(F.col("decision") == "cooldown", 1)).alias("in_cooldown"))


@R.query(_FOLDED + """ SELECT e.id AS request_id, session_key, e.said AS decision, e.wait::INT AS retry_after, round(200 - e.owed / 3e7, 6) AS credits, e.n::INT AS attempts, e.ok::INT AS successes, e.f::INT AS failed FROM z
 UNION ALL SELECT id, NULL, 'no_session', 0, 200.0, 0, 0, 0 FROM one WHERE session_key IS NULL""")
def guard_decisions(spark, sf):
    return rounded(U.decisions(U.once(table(spark, sf, "guard_requests"))).drop("at", "too_short"))


_FILE = "{'f': %s, 'b': %s, 'u': %s, 'n': %s, 'o': %s}"
_SAID = "CASE WHEN x.b > 20000 THEN 'too_large' WHEN a.u + x.b > 500000 THEN 'over_total' WHEN a.n >= 200 THEN 'over_number' ELSE 'taken' END"
_USED = f"a.u + CASE WHEN {_SAID} = 'taken' THEN x.b ELSE 0 END"
_NONE = "[]::STRUCT(file BIGINT, bytes BIGINT, status VARCHAR, used BIGINT)[]"


@R.query(f"""WITH q AS (SELECT coalesce(topic_id, '(none)') AS request, list({_FILE % ('doc_id', 'coalesce(strlen(text), 0)::BIGINT', '0::BIGINT', '0::BIGINT', _NONE)} ORDER BY doc_id) AS l FROM documents GROUP BY 1),
 z AS (SELECT request, unnest(list_reduce(l, lambda a, x: {_FILE % ('x.f', 'x.b', _USED, f"a.n + CASE WHEN {_SAID} = 'taken' THEN 1 ELSE 0 END", f"list_append(a.o, {{'file': x.f, 'bytes': x.b, 'status': {_SAID}, 'used': {_USED}}})")}, {_FILE % ('0::BIGINT', '0::BIGINT', '0::BIGINT', '0::BIGINT', _NONE)}).o) AS e FROM q)
 SELECT request, e.file AS file, e.bytes AS bytes, e.status AS status, e.used AS used FROM z""")
def upload_budget(spark, sf):
    """Each topic stands for a request."""
    docs = table(spark, sf, "documents").select(F.coalesce("topic_id", F.lit("(none)")).alias("topic"), "doc_id", F.octet_length("text").alias("bytes"))
    return A.upload_budget(docs, "topic", "doc_id", "bytes", per_file=20_000, total=500_000, most=200)


def _essays(spark, sf):
    e = table(spark, sf, "essays").filter(A.on_scale("vocabulary") & F.col("prompt").isNotNull())
    return e.withColumn("prompt", F.regexp_replace(F.lower(F.trim("prompt")), r"\s+", " "))


@R.query()
def logo_ols(spark, sf):
    err, _ = A.leave_group_out(_essays(spark, sf), "prompt", "vocabulary", "n_token", ["mtld", "ttr"], ["num_sent", "num_word_div_para"])
    return rounded(err)


@R.query()
def logo_interval(spark, sf):
    _, got = A.leave_group_out(_essays(spark, sf), "prompt", "vocabulary", "n_token", ["mtld", "ttr"], ["num_sent", "num_word_div_para"])
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))


@R.query("""WITH t AS (SELECT source AS test, 1.0::DOUBLE / count(*) AS p FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM t)
 SELECT test, round(p, 6) AS p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY i)), 6) AS holm, round(least(1, min(m * p / i) OVER (ORDER BY i DESC)), 6) AS benjamini_hochberg FROM r""")
def adjusted_p(spark, sf):
    """One over the size of each source stands for a p-value."""
    t = table(spark, sf, "documents").filter("source is not null").groupBy(F.col("source").alias("test")).agg((1 / F.count("*")).alias("p"))
    return rounded(A.holm(t))
