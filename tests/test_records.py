import pytest

from lexweave.sources import records as R

FEEDS = [("d", ",", "double", ["word", "count", "videos", "channels", "count:a", "count:b"]),
         ("n", "\t", "none", ["word", "count", "videos", "channels", "count:a"])]
LINES = [
    ("d", "w,3,2,1,1,2", None), ("d", '"w","3",2,1,1,2', None), ("d", '"the ""x""",3,2,1,1,2', None),
    ("d", 'a"b,3,2,1,1,2', None), ("d", '"w,3,2,1,1,2', "unclosed_quote"), ("d", '"w"s,3,2,1,1,2', "text_after_quote"),
    ("d", '"a\rb",3,2,1,1,2', "bad_word"), ("d", "a\nb,3,2,1,1,2", "line_break"), ("d", "w,3,2,1,1,2\r", "line_break"),
    ("d", "w,3,2,1,1", "field_count"), ("d", "", "field_count"), ("d", ",3,2,1,1,2", "empty_word"),
    ("d", "w,03,2,1,1,2", "bad_number"), ("d", "w,3.0,2,1,1,2", "bad_number"), ("d", "w,٣,2,1,1,2", "bad_number"),
    ("d", "w,4294967296,2,1,4294967296,0", "number_too_large"), ("d", "w,3,1,2,1,2", "channels_over_videos"),
    ("d", "w,3,4,2,1,2", "videos_over_count"), ("d", "w,3,2,1,1,1", "category_sum"),
    ("n", '"\t3\t2\t1\t3', None), ("n", 'w\t3\t"2"\t1\t3', "bad_number"), ("n", "[TOTAL]\t3\t2\t1\t3", None),
    ("zz", "w", "unknown_feed"), (None, "w", "unknown_feed"), ("d", None, "null_line"),
    ("d", "x" * 300_000 + ",3,2,1,1,2", None), ("d", "w,3,2,1,1,2", None),
]


def test_reasons(spark):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, delim string, quote_mode string, header_cols array<string>")
    rows = [(i, f, i, l, "clash") for i, (f, l, _) in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "line_id long, feed_id string, line_no long, raw_line string, reason string")
    parsed = R.parse_lines(lines, feeds)
    got = {r.line_id: r for r in parsed.collect()}
    assert [got[i].reason for i in range(len(LINES))] == [x[2] for x in LINES]
    assert got[2].word == 'the "x"' and got[2].category_counts == {"a": 1, "b": 2}
    assert R.valid_records(parsed).count() + R.failed_records(parsed).count() == len(LINES)
    assert R.parse_lines(lines.limit(0), feeds).count() == 0


def test_too_many_feeds(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_FEEDS", 1)
    feeds = spark.createDataFrame(FEEDS, "feed_id string, delim string, quote_mode string, header_cols array<string>")
    with pytest.raises(ValueError):
        R.parse_lines(spark.createDataFrame([], "line_id long, feed_id string, line_no long, raw_line string"), feeds)


def test_bad_dialects(spark):
    names = ["word", "count", "videos", "channels", "a"]
    feeds = spark.createDataFrame([("two", "::", "double", names), ("quote", '"', "double", names), ("none", ",", "none", None), ("ok", ",", "none", names)], "feed_id string, delim string, quote_mode string, header_cols array<string>")
    lines = spark.createDataFrame([(i, f, 0, "w,1,1,1,1") for i, f in enumerate(("two", "quote", "none", "ok"))], "line_id long, feed_id string, line_no long, raw_line string")
    assert [r.reason for r in R.parse_lines(lines, feeds).orderBy("line_id").collect()] == ["bad_dialect"] * 3 + [None]
    assert R.assemble(lines, feeds).count() == 4


def test_long_records(spark, monkeypatch):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, delim string, quote_mode string, header_cols array<string>")
    text = ['"w', *(f"line {i}" for i in range(500)), 'end",3,2,1,1,2', "x,3,2,1,1,2"]
    lines = spark.createDataFrame([(i, "d", i, t) for i, t in enumerate(text)], "line_id long, feed_id string, line_no long, raw_line string")
    assert {r.line_id: r.raw_line for r in R.assemble(lines, feeds).collect()} == {0: "\n".join(text[:-1]), 502: text[-1]}
    monkeypatch.setattr(R, "MAX_RECORD", 1000)
    assert R.assemble(lines, feeds).count() == 503


def test_assemble(spark):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, delim string, quote_mode string, header_cols array<string>")
    text = ["w,3,2,1,1,2", '"a', 'b",3,2,1,1,2', '"never', "x,3,2,1,1,2", "y,3,2,1,1,2", "z,3,2,1,1,2", 'q"q,3,2,1,1,2', '"end']
    rows = [(i, "d", i, t) for i, t in enumerate(text)] + [(100, "n", 0, '"'), (101, "n", 1, "b"), (102, None, 0, None)]
    got = R.assemble(spark.createDataFrame(rows, "line_id long, feed_id string, line_no long, raw_line string"), feeds)
    assert {r.line_id: r.raw_line for r in got.collect()} == {0: text[0], 1: '"a\nb",3,2,1,1,2', 3: '"never', 4: text[4], 5: text[5], 6: text[6], 7: text[7], 8: '"end', 100: '"', 101: "b", 102: None}
    parsed = {r.line_id: r.reason for r in R.parse_lines(got, feeds).collect()}
    assert parsed[3] == parsed[8] == "unclosed_quote" and parsed[1] == "bad_word" and parsed[4] is None
