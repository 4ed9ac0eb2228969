"""Queries of dictionary graphs, exposure tables and cross-document diagnostics.

Graph: synsets are the heads of ``flemma_forms``, links its form-to-head pairs, and the parent
of a synset is the longest proper prefix that is a synset too. Exposure: ``documents`` (contexts
are documents, channels sources, categories genres) looked up by ``essays``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import normalizers as N
from lexweave.functions import text as T
from lexweave.operators import batch as B
from lexweave.operators import diversity as D
from lexweave.operators import exposure as X
from lexweave.operators import network as G
from lexweave.operators import profile as P
from lexweave.plans.corpus_queries import parted
from lexweave.plans.diversity_queries import KEYS, rounded, toks
from lexweave.plans.profile_queries import LEVELS, mapped, sql
from lexweave.plans.registry import TOKS, Registry, with_toks
from lexweave.session import table
from lexweave.sources import records

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def graph(spark, sf):
    links = N.lexicon(table(spark, sf, "flemma_forms")).select(F.col("form").alias("lemma"), F.lit("n").alias("pos"), F.explode("heads").alias("synset"))
    nodes = links.select("synset", "pos").distinct()
    prefixes = nodes.filter("length(synset) > 1").select(F.col("synset").alias("child"), F.explode(F.sequence(F.lit(1), F.length("synset") - 1)).alias("k"))
    hits = prefixes.withColumn("parent", F.expr("substring(child, 1, k)")).join(nodes.select(F.col("synset").alias("parent")), "parent")
    return nodes, hits.groupBy("child").agg(F.max_by("parent", "k").alias("parent")), links


_GRAPH = """links AS (SELECT DISTINCT form AS lemma, h AS synset FROM (SELECT translate(lower(trim(form)), '’ʼ', '''''') AS form, translate(lower(trim(x)), '’ʼ', '''''') AS h FROM (SELECT form, unnest(heads) AS x FROM flemma_forms)) WHERE form <> '' AND h <> ''),
 nodes AS (SELECT DISTINCT synset FROM links), edges AS (SELECT c.synset AS child, max_by(p.synset, len(p.synset)) AS parent FROM nodes c JOIN nodes p ON starts_with(c.synset, p.synset) AND len(p.synset) < len(c.synset) GROUP BY 1),
 walk AS (SELECT synset, 0 AS depth FROM nodes WHERE synset NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.synset),
 dep AS (SELECT synset, max(depth) AS depth FROM walk GROUP BY 1), met AS (SELECT lemma, count(*) AS polysemy, count(depth) AS k, min(depth) AS dmin, avg(depth) AS dmean, max(depth) AS dmax FROM links LEFT JOIN dep USING (synset) GROUP BY 1)"""


@R.query(f"WITH RECURSIVE {_GRAPH} SELECT lemma, 'n' AS pos, count(DISTINCT synset)::BIGINT AS polysemy FROM links GROUP BY lemma")
def polysemy(spark, sf):
    return G.polysemy(graph(spark, sf)[2])


@R.query(f"WITH RECURSIVE {_GRAPH} SELECT synset, depth::INT AS depth FROM dep")
def hypernym_depth(spark, sf):
    nodes, edges, _ = graph(spark, sf)
    return G.depths(nodes, edges)


@R.query(f"WITH RECURSIVE {_GRAPH} SELECT lemma, polysemy::BIGINT AS polysemy, k::BIGINT AS depth_sense_count, dmin::DOUBLE AS depth_min, round(dmean, 6) AS depth_mean, dmax::DOUBLE AS depth_max FROM met")
def lemma_rollup(spark, sf):
    return rounded(G.any_pos(G.lemma_metrics(*graph(spark, sf))))


@R.query(f"""WITH RECURSIVE {TOKS}, {_GRAPH}, c AS (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY ALL)
 SELECT doc_id, sum(c)::BIGINT AS tokens, count(*)::BIGINT AS types, coalesce(sum(c) FILTER (polysemy IS NOT NULL), 0)::BIGINT AS covered_tokens, count(polysemy)::BIGINT AS covered_types,
 round(coalesce(sum(c) FILTER (polysemy IS NOT NULL), 0)::DOUBLE / sum(c), 6) AS token_coverage, round(count(polysemy)::DOUBLE / count(*), 6) AS type_coverage,
 round(coalesce(sum(c) FILTER (dmean IS NOT NULL), 0)::DOUBLE / sum(c), 6) AS depth_token_coverage, round(count(dmean)::DOUBLE / count(*), 6) AS depth_type_coverage,
 round(sum(polysemy * c)::DOUBLE / sum(c) FILTER (polysemy IS NOT NULL), 6) AS polysemy_token_mean, round(avg(polysemy), 6) AS polysemy_type_mean,
 round(sum(dmean * c) / sum(c) FILTER (dmean IS NOT NULL), 6) AS depth_token_mean, round(avg(dmean), 6) AS depth_type_mean FROM c LEFT JOIN met ON lemma = token GROUP BY doc_id""")
def semantic_summary(spark, sf):
    return rounded(G.document_summary(toks(spark, sf), G.any_pos(G.lemma_metrics(*graph(spark, sf))), KEYS))


def exposure(spark, sf):
    return X.from_tokens(parted(spark, sf), "doc_id", "part", "register")


_EXPO = f"""{TOKS}, p AS (SELECT t.*, coalesce(lower(trim(source)), '(none)') AS part, coalesce(genre_id, '(none)') AS register FROM toks t JOIN documents USING (doc_id)),
 ex AS (SELECT token AS word, count(*) AS c, count(DISTINCT doc_id) AS v, count(DISTINCT part) AS q FROM p GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT doc_id) AS dv, count(DISTINCT part) AS dc, count(DISTINCT token) AS voc FROM p)"""


@R.query(f"""WITH {_EXPO}, k AS (SELECT token AS word, string_agg(register || '=' || c, ' ' ORDER BY register) AS categories FROM (SELECT token, register, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1)
 SELECT word, c::BIGINT AS count, v::BIGINT AS videos, q::BIGINT AS channels, categories FROM ex JOIN k USING (word)""")
def exposure_build(spark, sf):
    cats = F.array_join(F.transform(F.array_sort(F.map_entries("category_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return exposure(spark, sf)[0].select("word", "count", "videos", "channels", cats.alias("categories"))


@R.query(f"""WITH {_EXPO}, et AS (SELECT essay_row, lower(s) AS word, count(*) AS c FROM (SELECT essay_row, unnest(regexp_extract_all(full_text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS s FROM essays) GROUP BY ALL),
 x AS (SELECT et.*, ex.word AS hit, log10(1e9 * (coalesce(ex.c, 0) + 1) / (n + voc)) AS z, log10((coalesce(v, 0) + 1)::DOUBLE / (dv + 2)) AS vi, log10((coalesce(q, 0) + 1)::DOUBLE / (dc + 2)) AS ch FROM et LEFT JOIN ex USING (word) CROSS JOIN tot)
 SELECT essay_row, sum(c)::BIGINT AS tokens, count(*)::BIGINT AS types, round(coalesce(sum(c) FILTER (hit IS NOT NULL), 0)::DOUBLE / sum(c), 6) AS token_coverage, round(count(hit)::DOUBLE / count(*), 6) AS type_coverage,
 round(sum(z * c) / sum(c), 6) AS zipf_token_mean, round(avg(z), 6) AS zipf_type_mean, round(sum(vi * c) / sum(c), 6) AS video_token_mean, round(avg(vi), 6) AS video_type_mean,
 round(sum(ch * c) / sum(c), 6) AS channel_token_mean, round(avg(ch), 6) AS channel_type_mean FROM x GROUP BY essay_row""")
def exposure_summary(spark, sf):
    words = T.tokens(table(spark, sf, "essays"), "essay_row", "full_text")
    return rounded(X.document_summary(words, *exposure(spark, sf), ["essay_row"]))


@R.query(f"WITH {_EXPO} SELECT count(*)::BIGINT AS rows, count(*) FILTER (ok)::BIGINT AS retained, count(*) FILTER (NOT ok)::BIGINT AS excluded, round(sum(c) FILTER (ok)::DOUBLE / sum(c), 6) AS mass_ratio FROM (SELECT c, regexp_full_match(word, '''?[a-z]+(?:[''-][a-z]+)*') AND len(word) <= 64 AS ok FROM ex)")
def exposure_filter(spark, sf):
    return rounded(X.filter_stats(exposure(spark, sf)[0]))


def _lines(spark, sf):
    return records.valid_records(records.parse_lines(table(spark, sf, "tubelex_lines"), table(spark, sf, "tubelex_feeds")))


@R.query()
def exposure_from_lines(spark, sf):
    return rounded(X.measures(*X.from_records(_lines(spark, sf))))


@R.query()
def exposure_checks(spark, sf):
    return X.checks(_lines(spark, sf))


def _wide(spark, sf):
    t = toks(spark, sf)
    return D.panel_a(t, KEYS).join(P.sophistication(mapped(spark, sf), KEYS), KEYS, "left")


@R.query(with_toks("""WITH b AS (SELECT doc_id, count(*) AS n, count(DISTINCT token)::DOUBLE AS v FROM toks GROUP BY 1), m2 AS (SELECT doc_id, sum(c * c) AS m2 FROM (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY ALL) GROUP BY 1),
 r AS (SELECT doc_id, n, unnest([{'k': 'ttr', 'x': v / n, 'q': 1}, {'k': 'herdan', 'x': CASE WHEN n > 1 THEN ln(v) / ln(n) END, 'q': 2}, {'k': 'maas', 'x': CASE WHEN n > 1 THEN (ln(n) - ln(v)) / pow(ln(n), 2) END, 'q': 2}, {'k': 'yule_i', 'x': v * v / nullif(m2 - v, 0), 'q': 100}]) AS e FROM b JOIN m2 USING (doc_id))
 SELECT doc_id, e.k AS index_key, n::BIGINT AS n_tokens, e.q::INT AS required_tokens, round(e.x, 6) AS value, CASE WHEN e.x IS NOT NULL THEN 'available' WHEN n < e.q THEN 'too short' ELSE 'undefined' END AS status,
 (CASE WHEN e.x IS NOT NULL THEN 2 WHEN n < e.q THEN 0 ELSE 1 END)::INT AS status_code, CASE WHEN e.x IS NOT NULL THEN '' WHEN n < e.q THEN 'N=' || n || ' < ' || e.q ELSE 'undefined for this text' END AS note FROM r"""))
def reliability(spark, sf):
    return rounded(B.reliability(D.basic(toks(spark, sf), KEYS).select("doc_id", "n_tokens", "ttr", "herdan", "maas", "yule_i"), KEYS))


_SX = "', '".join(T.SUFFIXES)
_OFF = f"""f AS (SELECT doc_id, head, surface AS s, count(*) AS c FROM mapped WHERE rank IS NULL GROUP BY ALL), o AS (SELECT doc_id, head, sum(c)::BIGINT AS count, count(*)::BIGINT AS n_forms, list(s ORDER BY c DESC, s) AS l, list(s || ' (' || c || ')' ORDER BY c DESC, s) AS sh FROM f GROUP BY ALL),
 e AS (SELECT *, list_filter(l, lambda s: regexp_full_match(s, '[A-Z'']+') AND len(replace(s, '''', '')) > 1)[1] AS up, list_filter(l, lambda s: contains(s, ''''))[1] AS ap,
  list_filter(l, lambda s: s[1] BETWEEN 'A' AND 'Z' AND len(replace(s, '''', '')) > 1 AND NOT regexp_full_match(s, '[A-Z'']+'))[1] AS ca,
  list_filter(list_transform(list_concat([head], l), lambda s: CASE WHEN len(s) >= 5 THEN list_filter(['{_SX}'], lambda x: ends_with(lower(s), x))[1] END), lambda x: x IS NOT NULL)[1] AS su FROM o)"""
_CAUSE = f"CASE WHEN up IS NOT NULL THEN '{B.CAUSES[0]}' WHEN ap IS NOT NULL THEN '{B.CAUSES[1]}' WHEN ca IS NOT NULL THEN '{B.CAUSES[2]}' WHEN su IS NOT NULL THEN '{B.CAUSES[3]}' WHEN len(head) <= 2 THEN '{B.CAUSES[4]}' ELSE '{B.CAUSES[5]}' END"
_EVID = "CASE WHEN up IS NOT NULL THEN 'uppercase form: ' || up WHEN ap IS NOT NULL THEN 'apostrophe form: ' || ap WHEN ca IS NOT NULL THEN 'capitalized form: ' || ca WHEN su IS NOT NULL THEN 'suffix: -' || su WHEN len(head) <= 2 THEN 'short head: ' || head ELSE 'no surface cue' END"


@R.query(sql(f"+ {_OFF} SELECT doc_id, head, count, n_forms, array_to_string(sh[1:8], ', ') AS forms, {_CAUSE} AS cause, {_EVID} AS evidence FROM e"))
def offlist_rows(spark, sf):
    return B.off_list(mapped(spark, sf), KEYS)


@R.query(sql(f"+ {_OFF} SELECT {_CAUSE} AS cause, sum(count)::BIGINT AS count FROM e GROUP BY 1"))
def offlist_cause(spark, sf):
    return B.off_list(mapped(spark, sf), KEYS).groupBy("cause").agg(F.sum("count").alias("count"))


@R.query(sql("SELECT head, count(*)::BIGINT AS count FROM mapped WHERE rank IS NULL GROUP BY head ORDER BY 2 DESC, 1 LIMIT 25"))
def offlist_topk(spark, sf):
    return B.off_list_top(mapped(spark, sf).filter("rank is null").groupBy("head").agg(F.count("*").alias("count")))


_TYPES = with_toks("WITH ty AS (SELECT DISTINCT coalesce(lower(trim(source)), '(none)') AS part, token FROM toks JOIN documents USING (doc_id)), k AS (SELECT part, count(*) AS k FROM ty GROUP BY 1), sh AS (SELECT a.part AS a, b.part AS b, count(*) AS s FROM ty a JOIN ty b USING (token) GROUP BY ALL)")


@R.query(_TYPES + " SELECT x.part AS document_a, y.part AS document_b, coalesce(s, 0)::BIGINT AS shared_types, (x.k + y.k - coalesce(s, 0))::BIGINT AS union_types, round(coalesce(s, 0)::DOUBLE / (x.k + y.k - coalesce(s, 0)), 6) AS jaccard FROM k x CROSS JOIN k y LEFT JOIN sh ON sh.a = x.part AND sh.b = y.part")
def overlap_matrix(spark, sf):
    return rounded(B.overlap(parted(spark, sf), "part", zeros=True))


@R.query(_TYPES + " SELECT x.part AS document_a, y.part AS document_b, coalesce(s, 0)::BIGINT AS shared_types, (x.k - coalesce(s, 0))::BIGINT AS a_only_types, (y.k - coalesce(s, 0))::BIGINT AS b_only_types, (x.k + y.k - coalesce(s, 0))::BIGINT AS union_types, round(coalesce(s, 0)::DOUBLE / (x.k + y.k - coalesce(s, 0)), 6) AS jaccard FROM k x JOIN k y ON x.part < y.part LEFT JOIN sh ON sh.a = x.part AND sh.b = y.part")
def overlap_pairs(spark, sf):
    return rounded(B.overlap(parted(spark, sf), "part", ordered_pairs=False, zeros=True))


@R.query(sql(f"SELECT doc_id, " + ", ".join(f"nullif(count(*) FILTER (level = {k}), 0)::BIGINT AS K{k}" for k in range(1, LEVELS + 1)) + " FROM mapped GROUP BY doc_id"))
def band_pivot(spark, sf):
    per = mapped(spark, sf).filter("level is not null").groupBy("doc_id", F.concat(F.lit("K"), "level").alias("band")).agg(F.count("*").alias("n"))
    every = toks(spark, sf).select("doc_id").distinct()
    return every.join(B.pivot(per, KEYS, "band", "n", [f"K{k}" for k in range(1, LEVELS + 1)]), "doc_id", "left")


@R.query()
def profile_scores(spark, sf):
    return B.profile_scores(_wide(spark, sf), KEYS, 6118)


@R.query(sql("SELECT doc_id, CASE WHEN count(*) < 100 THEN 'panel_a_below_recommended_minimum' ELSE '' END || '|' || CASE WHEN 100.0::DOUBLE * count(*) FILTER (rank IS NULL) / count(*) > 10 THEN 'panel_b_off_list_over_10pct' ELSE '' END AS flags FROM mapped GROUP BY doc_id"))
def interpretation_flags(spark, sf):
    m = mapped(spark, sf)
    n = m.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    f = B.flags(n.join(P.sophistication(m, KEYS), "doc_id"), KEYS)
    pick = lambda s: F.when(F.array_contains("flags", s), s).otherwise("")
    return f.select("doc_id", F.concat(pick("panel_a_below_recommended_minimum"), F.lit("|"), pick("panel_b_off_list_over_10pct")).alias("flags"))
