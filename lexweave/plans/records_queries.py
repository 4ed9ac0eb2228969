"""Queries of the record parser (problem 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.session import table
from lexweave.sources import records as R


def _parsed(spark, sf):
    return R.parse_lines(table(spark, sf, "tubelex_lines"), table(spark, sf, "tubelex_feeds"))


def _assembled(spark, sf):
    """The table as line-wise files: every line break inside a line cuts it in two, ``assemble`` joins what belongs together."""
    lines = table(spark, sf, "tubelex_lines")
    cut = lines.select("feed_id", F.col("line_id"), F.col("line_no"), F.posexplode(F.split("raw_line", "\n", -1)).alias("part", "raw_line"))
    rows = cut.select((F.col("line_id") * 64 + F.col("part")).alias("line_id"), "feed_id", "line_no", "raw_line")
    feeds = table(spark, sf, "tubelex_feeds")
    parsed = R.parse_lines(R.assemble(rows, feeds), feeds)
    return parsed.groupBy("feed_id").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_valid"))


def queries():
    return {
        "p3_assembled": _assembled,
        "p3_found": lambda s, d: R.failed_records(_parsed(s, d)).select("line_id"),
        "p3_failed": lambda s, d: R.failed_records(_parsed(s, d)),
        "p3_valid": lambda s, d: R.valid_records(_parsed(s, d)).withColumn(
            "category_counts", F.to_json("category_counts")
        ),
        "p3_reasons": lambda s, d: R.failed_records(_parsed(s, d))
        .groupBy("feed_id", "reason")
        .agg(F.count("*").alias("n_lines")),
    }


# A field of a quoting feed: in quotes with quotes inside doubled, or not begun by a quote, or empty.
_FIELD = """("(?:[^"]|"")*"|[^"' || delim || '][^' || delim || ']*|)"""
_SPLIT = f"""rec AS (SELECT l.line_id, l.feed_id, l.raw_line, f.header_cols AS h, len(f.header_cols) AS n, CASE WHEN f.quote_mode = 'none' THEN string_split(raw_line, delim)
  WHEN regexp_full_match(raw_line, '{_FIELD}(?:[' || delim || ']{_FIELD})*') THEN list_transform(regexp_extract_all(delim || raw_line, '[' || delim || ']{_FIELD}', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS fs
 FROM tubelex_lines l JOIN tubelex_feeds f USING (feed_id)),
 num AS (SELECT *, list_transform(fs[2:], lambda x: CASE WHEN regexp_full_match(x, '0|[1-9][0-9]{{0,9}}') THEN x::BIGINT END) AS v FROM rec),
 chk AS (SELECT *, coalesce(len(fs) = n AND fs[1] <> '' AND NOT regexp_matches(fs[1], '[\\t\\r\\n]') AND len(list_filter(v, lambda x: x IS NULL OR x > 4294967295)) = 0
  AND v[3] <= v[2] AND v[2] <= v[1] AND list_sum(v[4:]) = v[1], false) AS ok FROM num)"""


def oracle_sql():
    return {
        "p3_found": f"WITH {_SPLIT} SELECT line_id FROM chk WHERE NOT ok",
        "p3_valid": f"""WITH {_SPLIT} SELECT c.line_id, c.feed_id, t.line_no, fs[1] AS word, v[1] AS count, v[2] AS videos, v[3] AS channels,
 '{{' || array_to_string(list_transform(list_zip(h[5:], v[4:]), lambda z: '"' || replace(z[1], 'count:', '') || '":' || z[2]), ',') || '}}' AS category_counts FROM chk c JOIN tubelex_lines t USING (line_id) WHERE ok""",
    }
