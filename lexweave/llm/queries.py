"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.llm import canonical, leakage, packing, pii, reading, spans, splits
from lexweave.session import table


def p1_found(spark, sf):
    pairs = splits.overlaps(table(spark, sf, "essays"))
    return pairs.select(F.least("train_row", "eval_row").alias("essay_a"), F.greatest("train_row", "eval_row").alias("essay_b"))


def p1_counts(spark, sf):
    return splits.overlap_counts(splits.overlaps(table(spark, sf, "essays")))


def p2_found(spark, sf):
    docs = canonical.changed_texts(table(spark, sf, "documents"), "doc_id", "text")
    forms = canonical.clean_lexicon(table(spark, sf, "flemma_forms")).filter("changed")
    return docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id")).union(
        forms.select(F.lit("flemma_forms").alias("tbl"), F.col("entry_id").alias("rec_id"))
    )


def p2_lexicon(spark, sf):
    return canonical.clean_lexicon(table(spark, sf, "flemma_forms")).withColumn("heads", F.array_join("heads", "|"))


def p2_form_to_heads(spark, sf):
    return canonical.form_to_heads(canonical.clean_lexicon(table(spark, sf, "flemma_forms"))).withColumn("heads", F.array_join("heads", "|"))


def p2_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return canonical.clean_texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n_chars"))


def p4_levels(spark, sf):
    docs, lex = table(spark, sf, "documents"), reading.lexicon(table(spark, sf, "rank_list"))
    return reading.levels(docs, reading.learn(docs, table(spark, sf, "doc_labels"), lex), lex)


def p4_quality(spark, sf):
    """One row: rank agreement with held-out grades."""
    docs, lex = table(spark, sf, "documents"), reading.lexicon(table(spark, sf, "rank_list"))
    got = reading.held_out(docs, table(spark, sf, "doc_labels"), lex)
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} {'long' if k[:2] == 'n_' else 'double'}" for k in got))


def p4_profile(spark, sf):
    return p4_levels(spark, sf).groupBy("status", "band").agg(F.count("*").alias("n_docs"), F.avg("n_words").alias("mean_words"))


def p5_found(spark, sf):
    return pii.mentions(table(spark, sf, "documents")).select("doc_id", "start_at", "kind").distinct()


def p5_redacted(spark, sf):
    return pii.redacted(table(spark, sf, "documents"))


def p5_kinds(spark, sf):
    return pii.mentions(table(spark, sf, "documents")).groupBy("kind").agg(
        F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs")
    )


def p6_packed(spark, sf):
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p6_fill(spark, sf):
    return packing.fill(p6_packed(spark, sf))


def p7_found(spark, sf):
    found = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), window=12, max_edits=0)
    return found.select("doc_id", "item_id").distinct()


def p7_leaks(spark, sf):
    """Passages of 24 words up to two word edits, shorter items as a whole: altered leaks too."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), window=24, max_edits=2, short_items=True)


def p7_items(spark, sf):
    return leakage.leaked_items(leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")))


def p8_found(spark, sf):
    docs = table(spark, sf, "documents")
    return spans.document_pairs(spans.index_batches(docs), spans.class_members(docs))


def p8_stretches(spark, sf):
    return spans.stretches(spans.index_batches(table(spark, sf, "documents")))


def p8_coverage(spark, sf):
    docs = table(spark, sf, "documents")
    return spans.coverage(spans.index_batches(docs), docs)


_QUERIES = (p1_found, p1_counts, p4_levels, p4_quality, p4_profile, p5_found, p5_redacted, p5_kinds, p6_packed, p6_fill, p2_found, p2_lexicon, p2_form_to_heads, p2_documents, p7_found, p7_leaks, p7_items, p8_found, p8_stretches, p8_coverage)


def queries():
    return {f.__name__: f for f in _QUERIES}


_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


_OVERLAPS = f"""WITH r AS (SELECT essay_row AS id, lower(trim(set_name)) AS s, nullif(lower(trim(text_id_kaggle)), '') AS k, lower(nfc_normalize(full_text)) AS t FROM essays WHERE lower(trim(set_name)) IN ('train', 'test', 'validation')),
 x AS (SELECT id, s = 'train' AS tr, k, nullif(trim(regexp_replace(t, '{_SPACES}', ' ', 'g')), '') AS f, regexp_extract_all(t, '[a-z]+(?:[''’][a-z]+)?') AS w FROM r),
 g AS (SELECT DISTINCT id, tr, list_transform(range(5), lambda j: w[i + j]) AS g FROM (SELECT id, tr, w, unnest(range(1, len(w) - 3)) AS i FROM x WHERE len(w) >= 5)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.id AS a, b.id AS b, 'i' AS why FROM x a JOIN x b ON a.tr AND NOT b.tr AND a.k = b.k UNION SELECT a.id, b.id, 't' FROM x a JOIN x b ON a.tr AND NOT b.tr AND a.f = b.f
  UNION SELECT q.a, q.b, 'n' FROM (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.tr AND NOT b.tr AND a.g = b.g GROUP BY ALL) q JOIN n na ON na.id = q.a JOIN n nb ON nb.id = q.b WHERE c >= 0.85 * (na.n + nb.n - c))"""


def oracle_sql():
    """Naive twins of the queries that SQL can express; the others are tested by brute force."""
    return {
        "p1_found": _OVERLAPS + " SELECT DISTINCT least(a, b) AS essay_a, greatest(a, b) AS essay_b FROM p",
        "p1_counts": _OVERLAPS + """ SELECT r.s AS set_name, coalesce(nullif(lower(trim(source)), ''), '(none)') AS source, count(*)::BIGINT AS n_pairs, count(DISTINCT b)::BIGINT AS n_eval_rows, count(DISTINCT a)::BIGINT AS n_train_rows,
 count(*) FILTER (bi)::BIGINT AS n_same_id, count(*) FILTER (bt)::BIGINT AS n_same_text, count(*) FILTER (bn)::BIGINT AS n_near_text
 FROM (SELECT a, b, bool_or(why = 'i') AS bi, bool_or(why = 't') AS bt, bool_or(why = 'n') AS bn FROM p GROUP BY 1, 2) q JOIN r ON r.id = q.b JOIN essays e ON e.essay_row = q.b GROUP BY 1, 2""",
        "p8_found": """WITH w AS (SELECT DISTINCT doc_id, md5(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
 m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), v AS (SELECT w.* FROM w JOIN m USING (h)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p8_coverage": """WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, class_id, i, md5(substring(text, i, 400)) AS h FROM (SELECT *, unnest(range(1, length(text) - 398)) AS i FROM d WHERE length(text) >= 400)),
 m AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), v AS (SELECT w.* FROM w JOIN m USING (h)),
 c AS (SELECT doc_id, sum(least(400, coalesce(nx - i, 400))) AS shared FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM v) GROUP BY 1),
 l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n FROM v a JOIN v b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY 1)
 SELECT d.doc_id, d.class_id, d.n_copies::BIGINT AS n_copies, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(c.shared, 0)::BIGINT AS shared_chars, length(text)::BIGINT AS n_chars FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (class_id)""",
    }
