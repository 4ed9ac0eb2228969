"""Delimited records with a dialect per feed: valid rows typed, failing rows with a reason.

Every physical record is parsed by Python's strict ``csv`` reader inside Arrow batches
(no shuffle, one pass). Structural errors that the reader raises are captured before any
typed field is built; field and consistency rules follow on the parsed fields.

Defined results
---------------
* ``null`` line: reason ``null_line``; unknown or null feed: ``unknown_feed``; a feed without a header, or whose
  delimiter is not one sign: ``bad_dialect``.
* empty line: reason ``field_count`` (it has no field).
* empty table: empty result with the same schema.
* repeated lines and words are records like any other.
* extra columns of the input are ignored; clashing names do no harm as only the four
  named columns are read.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

csv.field_size_limit(2**31 - 1)

MAX_UINT32 = 4294967295
_NUMBER = re.compile(r"(?:0|[1-9][0-9]{0,9})\Z")
_BAD_WORD = re.compile(r"[\t\r\n]")

#: Reasons, in the order in which they are looked for.
REASONS = (
    "null_line",
    "unknown_feed",
    "bad_dialect",
    "unclosed_quote",
    "text_after_quote",
    "line_break",
    "malformed",
    "field_count",
    "empty_word",
    "bad_word",
    "bad_number",
    "number_too_large",
    "channels_over_videos",
    "videos_over_count",
    "category_sum",
)

#: At most this many feed dialects are held in every task.
MAX_FEEDS = 100_000

SCHEMA = (
    "line_id bigint, feed_id string, line_no bigint, word string, count bigint, videos bigint, "
    "channels bigint, category_counts map<string,bigint>, reason string"
)
_ARROW = pa.schema(
    [
        ("line_id", pa.int64()),
        ("feed_id", pa.string()),
        ("line_no", pa.int64()),
        ("word", pa.string()),
        ("count", pa.int64()),
        ("videos", pa.int64()),
        ("channels", pa.int64()),
        ("category_counts", pa.map_(pa.string(), pa.int64())),
        ("reason", pa.string()),
    ]
)


def split_record(line: str, delim: str, quoted: bool) -> tuple[list[str] | None, str | None]:
    """Fields of one record, or the structural reason why it has none."""
    if line[-1:] in ("\r", "\n"):  # the reader would take it for the record's end
        return None, "line_break"
    reader = csv.reader(
        [line], delimiter=delim, quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE, doublequote=True, strict=True
    )
    try:
        return next(reader, []), None
    except csv.Error as e:
        said = str(e)
        if "unexpected end" in said:
            return None, "unclosed_quote"
        if "expected after" in said:
            return None, "text_after_quote"
        return None, "line_break" if "new-line" in said else "malformed"


def field_reason(fields: list[str], width: int) -> tuple[list[int] | None, str | None]:
    """Numbers of a record of ``width`` fields, or the rule that its fields break."""
    if len(fields) != width:
        return None, "field_count"
    if not fields[0]:
        return None, "empty_word"
    if _BAD_WORD.search(fields[0]):
        return None, "bad_word"
    match = _NUMBER.match
    for f in fields[1:]:
        if not match(f):
            return None, "number_too_large" if f.isascii() and f.isdigit() and f[0] != "0" else "bad_number"
    numbers = [int(f) for f in fields[1:]]
    if max(numbers) > MAX_UINT32:
        return None, "number_too_large"
    if numbers[2] > numbers[1]:
        return None, "channels_over_videos"
    if numbers[1] > numbers[0]:
        return None, "videos_over_count"
    if sum(numbers[3:]) != numbers[0]:
        return None, "category_sum"
    return numbers, None


def _parser(dialects: dict[str, tuple[str, bool, list[str]] | None]):
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, feeds, nos, lines = (batch.column(i).to_pylist() for i in range(4))
            words, nums, cats, reasons = [], ([], [], []), [], []
            for feed, line in zip(feeds, lines):
                numbers = fields = None
                if line is None:
                    reason = "null_line"
                elif feed not in dialects:
                    reason = "unknown_feed"
                else:
                    fields, reason = (None, "bad_dialect") if dialects[feed] is None else split_record(line, *dialects[feed][:2])
                    if reason is None:
                        names = dialects[feed][2]
                        numbers, reason = field_reason(fields, len(names) + 4)
                reasons.append(reason)
                if numbers is None:
                    words.append(None)
                    cats.append(None)
                    for col in nums:
                        col.append(None)
                else:
                    words.append(fields[0])
                    cats.append(list(zip(names, numbers[3:])))
                    for col, v in zip(nums, numbers):
                        col.append(v)
            data = [ids, feeds, nos, words, *nums, cats, reasons]
            yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, _ARROW)], schema=_ARROW)

    return parse


#: A record over this many code points is not put together: its first line stands alone.
MAX_RECORD = 2**27


def _lines_of_record(held: list[str], delim: str) -> int | None:
    """How many of the held lines the first record takes: none while a quote is open, None where the strict reader fails."""
    reader = csv.reader((f"{t}\n" for t in held), delimiter=delim, strict=True)
    try:
        next(reader, None)
    except csv.Error as e:
        return 0 if "unexpected end" in str(e) else None
    return reader.line_num


def assemble(lines: DataFrame, feeds: DataFrame) -> DataFrame:
    """Physical lines of files to records: lines are joined while a quote of a ``double`` feed is open.

    For line-wise sources, where a record may be cut at a line break inside quotes; a table whose rows are records
    goes to ``parse_lines`` as it is. The strict reader itself takes the lines. Where it fails on a joined record,
    or the feed (or ``MAX_RECORD``) ends inside a quote, the first line becomes a record (which fails in parsing) and
    reading goes on with the next. The record has the ``line_id`` and ``line_no`` of its first line. Lines stream past
    in order per feed; only those of the open record are held, and they are read again only when a line with a quote comes.
    """
    delims = {r.feed_id: r.delim for r in _dialects(feeds) if r.quote_mode == "double" and r.delim and len(r.delim) == 1}
    schema = pa.schema([("line_id", pa.int64()), ("feed_id", pa.string()), ("line_no", pa.int64()), ("raw_line", pa.string())])

    def settle(held: list, delim: str, final: bool, out: list) -> list:
        """Move complete records to ``out``; the lines still held."""
        at = 0
        while at < len(held):
            if '"' not in held[at][3]:
                took = 1
            else:
                took = _lines_of_record([row[3] for row in held[at:]], delim)
                if took == 0 and not final and sum(len(row[3]) for row in held[at:]) <= MAX_RECORD:
                    break
            took = took or 1
            out.append((*held[at][:3], "\n".join(row[3] for row in held[at : at + took])))
            at += took
        return held[at:]

    def run(batches):
        feed, held, size = None, [], 0
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if row[1] != feed or row[3] is None:
                    if held:
                        settle(held, delims[feed], True, out)
                    feed, held, size = row[1], [], 0
                if row[3] is None or feed not in delims or (not held and '"' not in row[3]):
                    out.append(row)
                    continue
                held.append(row)
                size += len(row[3])
                if len(held) == 1 or '"' in row[3] or size > MAX_RECORD:
                    held = settle(held, delims[feed], False, out)
                    size = sum(len(r[3]) for r in held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out = []
        if held:
            settle(held, delims[feed], True, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    narrow = lines.select(F.col("line_id").cast("bigint"), "feed_id", F.col("line_no").cast("bigint"), F.col("raw_line").cast("string"))
    return narrow.repartition("feed_id").sortWithinPartitions("feed_id", "line_no", "line_id").mapInArrow(run, "line_id bigint, feed_id string, line_no bigint, raw_line string")


def _dialects(feeds: DataFrame) -> list:
    rows = feeds.select("feed_id", "delim", "quote_mode", "header_cols").limit(MAX_FEEDS + 1).collect()
    if len(rows) > MAX_FEEDS:
        raise ValueError(f"more than {MAX_FEEDS} feed dialects")
    return rows


def parse_lines(lines: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per line: typed fields where it is valid, else ``reason``.

    ``lines`` has ``line_id, feed_id, line_no, raw_line``; ``feeds`` has ``feed_id, delim,
    quote_mode, header_cols`` and is small (at most ``MAX_FEEDS`` rows, checked). A header
    names ``word, count, videos, channels`` and then its categories.
    """
    dialects = {}
    for r in _dialects(feeds):
        if r.feed_id is None:
            continue
        usable = bool(r.delim) and len(r.delim) == 1 and r.delim not in '"\r\n' and r.header_cols is not None
        dialects[r.feed_id] = (r.delim, r.quote_mode == "double", [(c or "").removeprefix("count:") for c in r.header_cols[4:]]) if usable else None
    narrow = lines.select(
        F.col("line_id").cast("bigint"), "feed_id", F.col("line_no").cast("bigint"), F.col("raw_line").cast("string")
    )
    return narrow.mapInArrow(_parser(dialects), SCHEMA)


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def failed_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "feed_id", "line_no", "reason")
