"""Held-out items inside corpus documents (problem 7).

The method: every window of ``window`` words is embedded by the CGK random walk, in which a
shared random string decides, symbol by symbol, whether the reading place moves on; windows
at a small edit distance become strings at a small Hamming distance. Each of several
repetitions samples some places of the embedded string as a bucket key, enough of them for
the target recall; windows that meet in a bucket are verified by their exact word edit
distance. A q-gram count bound that no window within the allowed edits can fail sifts the
corpus windows before they are embedded.

Scale: the items become a bucket table in the shared folder, whatever their number; tasks hold
only a sieve of word pairs of fixed size. The corpus is read once, without a shuffle; the keys
of the windows that pass the sieve are joined with the bucket table and verified after it.

Defined results
---------------
* null, empty and wordless texts (on either side) leak nothing;
* items of fewer words than the window can't share a window; with ``short_items`` they are
  matched as a whole (their own length is their window, with the edits in proportion), from
  ``LEAST_WORDS`` words on;
* repeated rows: a document id given twice counts as one document of both texts; ids are
  returned once per item;
* extra columns are ignored; empty tables give an empty result.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexweave.llm.arrays import U64, Words, map_texts, mix, mix_int, record_batch
from lexweave.llm.canonical import canonical
from lexweave.session import materialize

#: Slots of the sieve of word pairs (one byte each in a task). Fuller sieves let more windows through, none is lost.
SIEVE = 1 << 22
#: The shortest item that is matched as a whole.
LEAST_WORDS = 4
_PAD = U64(0)


def word_form(text: str) -> str:
    """Text in the consistent form, lower-cased; words are its runs of a-z."""
    return canonical(text).lower()


def cgk(windows: np.ndarray, seed: int) -> np.ndarray:
    """Random-walk embedding of rows of symbols: three output places per symbol."""
    n, w = windows.shape
    out = np.full((n, 3 * w), _PAD, U64)
    place = np.zeros(n, np.int64)
    padded = np.concatenate([windows, np.zeros((n, 1), U64)], axis=1)
    rows = np.arange(n)
    for j in range(3 * w):
        s = padded[rows, place]
        out[:, j] = s
        step = mix(s ^ U64(mix_int(seed * 1_000_003 + j))) & U64(1)
        place = np.minimum(place + step.astype(np.int64), w)
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of aligned rows of two symbol matrices."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1), (n, 1))
    for i in range(1, w + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, w + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = new
    return row[:, w]


def repetitions(window: int, max_edits: int, samples: int, recall: float) -> int:
    """Repetitions that bring a pair at ``max_edits`` edits into one bucket with probability ``recall``.

    An edit costs about three walk steps before the two walks meet again, and walks that are
    apart differ; identical windows agree everywhere, so one repetition is enough for them.
    """
    if max_edits == 0:
        return 1
    agree = max(0.05, 1 - min(0.9, 4.5 * max_edits / (3 * window) * (1 + max_edits / 4)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**samples)))


class Embedding:
    """Bucket keys of windows of one length."""

    def __init__(self, window: int, max_edits: int, recall: float, seed: int = 7):
        self.window, self.max_edits = window, max_edits
        samples = max(min(4, window), window // 2)
        rng = np.random.default_rng(seed + window)
        self.places = [np.sort(rng.choice(3 * window, samples, replace=False)) for _ in range(repetitions(window, max_edits, samples, recall))]

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each repetition the keys of the windows, which hold their length and repetition too."""
        out = []
        for r, places in enumerate(self.places):
            e = cgk(rows, r + 1)
            key = np.full(len(rows), (self.window << 16) + r + 1, U64)
            for p in places:
                key = mix(key ^ e[:, p])
            out.append(key)
        return out


def starts(words: Words, window: int) -> np.ndarray:
    """Places at which a window lies within one text."""
    at = np.arange(max(0, len(words.hash) - window + 1))
    return at[words.doc[at] == words.doc[at + window - 1]] if len(at) else at


def pair_slots(h: np.ndarray) -> np.ndarray:
    return (mix(h[:-1] * U64(3) + h[1:]) % U64(SIEVE)).astype(np.int64)


def candidates(words: Words, sieve: np.ndarray, window: int, max_edits: int) -> np.ndarray:
    """Starts of windows that share enough word pairs with the items."""
    h = words.hash
    if len(h) < window:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(sieve[pair_slots(h)] & (words.doc[:-1] == words.doc[1:]))])
    at = np.flatnonzero(total[window - 1 :] - total[: len(total) - window + 1] >= (window - 1) - 2 * max_edits)
    return at[words.doc[at] == words.doc[at + window - 1]]


_WINDOW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("words", pa.binary())])
_WINDOW_SQL = "key bigint, id bigint, place bigint, words binary"


def _emit(words: Words, ids: np.ndarray, at: np.ndarray, e: Embedding):
    """Rows of the windows that start at some places."""
    for s in range(0, len(at), 20_000):
        part = at[s : s + 20_000]
        rows = np.ascontiguousarray(words.hash[part[:, None] + np.arange(e.window)])
        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * e.window), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
        place = part - np.searchsorted(words.doc, words.doc[part])
        for key in e.keys(rows):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[words.doc[part]]), pa.array(place), data], schema=_WINDOW)


def _lengths(window: int, max_edits: int, short_items: bool) -> dict[int, int]:
    """Window lengths and the edits they may have."""
    out = {window: max_edits}
    if short_items:
        out |= {w: max_edits * w // window for w in range(LEAST_WORDS, window)}
    return out


def item_windows(items: DataFrame, window: int, max_edits: int, recall: float, short_items: bool = False) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The bucket table of the items' windows, the sieve of their word pairs, and the window lengths there are."""
    lengths = _lengths(window, max_edits, short_items)

    def fn(ids, texts):
        words = Words([word_form(t) for t in texts])
        ids, size = np.array(ids, np.int64), np.bincount(words.doc, minlength=len(texts))
        for w, edits in lengths.items():
            at = starts(words, w)
            if w < window:
                at = at[size[words.doc[at]] == w]
            yield from _emit(words, ids, at, Embedding(w, edits, recall))

    def slots(batches):
        for b in batches:
            for at in range(b.num_rows):
                words = Words([word_form(b.column(1)[at].as_py())])
                got = np.unique(pair_slots(words.hash)) if len(words.hash) > 1 else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(np.full(len(got), len(words.hash), np.int32))], names=["slot", "n_words"])

    known = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id is not null and text is not null").distinct()
    table = materialize(map_texts(known, fn, _WINDOW_SQL), "item-windows")
    pairs = known.mapInArrow(slots, "slot int, n_words int").groupBy("slot").agg(F.collect_set(F.least("n_words", F.lit(window))).alias("sizes"))
    rows = pairs.toPandas()  # at most SIEVE rows
    sieve = np.zeros(SIEVE, bool)
    sieve[rows["slot"].to_numpy(np.int64)] = True
    sizes = {int(n) for s in rows["sizes"] for n in s}
    return table, sieve, [w for w in lengths if w in sizes]


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int32)
    size = a.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for s in range(0, len(at), 20_000):
            part = at[s : s + 20_000]
            x, y = (np.frombuffer(b"".join(v.iloc[part]), U64).reshape(len(part), n // 8) for v in (a, b))
            out[part] = edit_distances(x, y)
    return pd.Series(out)


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 0, recall: float = 0.95, short_items: bool = False) -> DataFrame:
    """Each document and item that share a window of ``window`` words up to ``max_edits`` edits.

    ``doc_word`` and ``item_word`` are the word places of the best window (fewest edits, then
    first), ``n_windows`` the number of matching window pairs. With ``max_edits = 0`` the result
    is exact (equal windows share every key); else recall is at least about ``recall`` and precision 1.
    """
    lengths = _lengths(window, max_edits, short_items)
    table, sieve, sizes = item_windows(items, window, max_edits, recall, short_items)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def fn(ids, texts):
        words = Words([word_form(t) for t in texts])
        ids = np.array(ids, np.int64)
        for w in sizes:
            yield from _emit(words, ids, candidates(words, shared.value, w, lengths[w]), Embedding(w, lengths[w], recall))

    named = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null")
    found = map_texts(named, fn, _WINDOW_SQL).select("key", F.col("id").alias("doc_id"), F.col("place").alias("doc_word"), F.col("words").alias("doc_words"))
    held = table.select("key", F.col("id").alias("item_id"), F.col("place").cast("int").alias("item_word"), F.col("words").alias("item_words"))
    met = found.join(held, "key").filter(F.length("doc_words") == F.length("item_words"))
    if max_edits == 0:
        checked = met.filter(F.col("doc_words") == F.col("item_words")).select("doc_id", "doc_word", "item_id", "item_word", F.lit(0).alias("edits"))
    else:
        once = met.groupBy("doc_id", "doc_word", "item_id", "item_word", "doc_words", "item_words").agg(F.count("*").alias("keys"))
        allowed = F.create_map(*(F.lit(x) for w, e in lengths.items() for x in (8 * w, e)))[F.length("doc_words")]
        checked = once.withColumn("edits", _edits("doc_words", "item_words")).filter(F.col("edits") <= allowed).select("doc_id", "doc_word", "item_id", "item_word", "edits")
    best = F.min(F.struct("edits", "doc_word", "item_word"))
    rows = checked.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count("*").cast("int").alias("n_windows"))
    return rows.select("doc_id", "item_id", "b.doc_word", "b.item_word", "b.edits", "n_windows")


def leaked_items(found: DataFrame) -> DataFrame:
    """Per item: how many documents leak it."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("edits").alias("best_edits"))
