"""Long exact spans shared between documents (problem 8).

The method: a log-structured index of window fingerprints. A batch of documents becomes one
immutable run, sorted by fingerprint; it is merge-joined with the runs of all earlier
batches and with itself, the candidates are verified on the texts, and runs are compacted
level by level. A later batch therefore costs its own fingerprints
and one merge pass, not a new look at the old texts.

Fingerprints are the minima (winnowing) of the hashes of ``K`` consecutive code points over
``min_len - K + 1`` places, so that any shared span of ``min_len`` code points contains one,
chosen alike in both texts. Identical texts are one class from the start. Buckets of more
than ``HOT`` classes are split by longer context around the fingerprint (``STEP`` code points
finer each), which only true spans of nearly ``min_len`` survive: nothing is dropped.

Defined results
---------------
* null texts and texts shorter than ``min_len`` share nothing;
* repeated rows of one ``doc_id`` count once; identical texts under different ids are pairs
  if they have ``min_len`` code points;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.arrays import U64, codes, prefix_hash, record_batch, span_hash
from lexweave.session import bucketed, materialize, small_or_not

MIN_LEN = 400
K = 256
HOT = 64
STEP = 24
FANOUT = 3
BATCHES = 6

_PLACE = U64((1 << 24) - 1)
_NEVER = U64(2**64 - 1)


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(text) - k + 1)
    return span_hash(prefix_hash(text), at, at + k)


def sliding_min(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each t consecutive values, in three passes whatever t is."""
    n = len(x)
    pad = -n % t
    y = np.concatenate([x, np.full(pad, _NEVER, U64)]).reshape(-1, t)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - t + 1], left[t - 1 : n])


def chosen(text: np.ndarray, min_len: int = MIN_LEN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the fingerprints of one text."""
    t = min_len - k + 1
    if len(text) < min_len:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    places = []
    h = gram_hashes(text, k)
    size = 1 << 23  # places fit into the low bits; longer texts go by overlapping stretches
    for s in range(0, len(h), size):
        part = h[s : s + size + t - 1]
        if len(part) < t:
            break
        tagged = (part & ~_PLACE) | np.arange(len(part), dtype=U64)
        m = sliding_min(tagged, t) & _PLACE
        places.append(m[np.concatenate([[True], m[1:] != m[:-1]])].astype(np.int64) + s)
    at = np.unique(np.concatenate(places))
    return h[at], at


def _sha():
    return F.substring(F.unhex(F.sha2("text", 256)), 1, 16)


def eligible(docs: DataFrame, min_len: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= min_len)
    )


_ROW = "fp bigint, sha binary"


def fingerprints(docs: DataFrame, min_len: int = MIN_LEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``fp, sha`` and the columns ``keep`` (bigint): the fingerprints of each document of at least ``min_len``."""
    schema = pa.schema([("fp", pa.int64()), ("sha", pa.binary()), *((k, pa.int64()) for k in keep)])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                each = [np.unique(chosen(codes(t), min_len)[0]) for t in part.column(1).to_pylist()]
                n = np.array([len(h) for h in each])
                row = pa.array(np.repeat(np.arange(len(n)), n))
                fp = np.concatenate(each).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp), *(part.column(i).take(row) for i in (0, *range(2, 2 + len(keep))))], schema=schema)

    rows = docs.select("doc_id", "text", *keep).filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_len))
    return rows.select(_sha().alias("sha"), F.col("text").cast("string"), *(F.col(k).cast("bigint") for k in keep)).mapInArrow(run, ", ".join([_ROW, *(f"{k} bigint" for k in keep)]))


class FingerprintLog:
    """Sorted immutable runs of fingerprints, in levels.

    A run is a bucketed table in the shared folder: rows lie in ``buckets`` parts by fingerprint, one sorted file each.
    A new batch is shuffled once, when its run is written; merge joins with itself and with every older run then read
    the files bucket by bucket, without a shuffle. ``FANOUT`` runs of one level are merged into one of the next, so a
    row is rewritten once a level and the number of runs grows with the logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, min_len: int = MIN_LEN, buckets: int | None = None):
        self.spark, self.min_len = spark, min_len
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = [[]]
        # files of a bucket are sorted and there is one, so a merge join may take their order as it is
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        placed = rows.select("fp", "sha").repartition(self.buckets, "fp").dropDuplicates(["fp", "sha"])
        return bucketed(placed.sortWithinPartitions("fp"), "fp_run", "fp", self.buckets)

    def add(self, rows: DataFrame, refine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
        """Index the fingerprints ``fp, sha`` of a batch; candidate class pairs ``sha_a, sha_b`` of it with all before and itself.

        ``refine(members, hot)`` gives finer keys for the rows of fingerprints that more than ``HOT`` classes have.
        """
        run = self._write(rows)
        every = [*self.runs, run]
        self.levels[0].append(run)
        met = None
        hot = self._hot(every) if refine else None
        marked = small_or_not(hot) if hot is not None and not hot.isEmpty() else None
        cold = (lambda r: r) if marked is None else (lambda r: r.join(marked, "fp", "left_anti"))
        for old in every:
            found = _meet(cold(run), cold(old))
            met = found if met is None else met.unionByName(found)
        if marked is not None:
            members = None
            for r in every:
                part = r.join(marked, "fp", "left_semi")
                members = part if members is None else members.unionByName(part)
            fine = materialize(refine(members.distinct(), marked), "refined")
            new = fine.join(run.join(marked, "fp", "left_semi").select("sha").distinct(), "sha", "left_semi").select("fp", "sha")
            met = met.unionByName(_meet(new, fine))
        self._compact()
        return met

    def _hot(self, runs: list[DataFrame]) -> DataFrame:
        """Fingerprints of more than ``HOT`` classes: counts of single runs need no shuffle, and one of them must have its share."""
        share = HOT // len(runs)
        some, exact = None, None
        for r in runs:
            part = r.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > share).select("fp")
            some = part if some is None else some.unionByName(part)
        some = small_or_not(materialize(some.distinct(), "maybe-hot"))
        for r in runs:
            part = r.join(some, "fp", "left_semi").groupBy("fp").agg(F.count("*").alias("n"))
            exact = part if exact is None else exact.unionByName(part)
        return materialize(exact.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select("fp"), "hot")

    def _compact(self) -> None:
        """Merge each full level into one run of the next; a fingerprint and class stays once."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= FANOUT:
                rows = None
                for r in self.levels[k]:
                    rows = r if rows is None else rows.unionByName(r)
                merged = self._write(rows)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
            k += 1


def _meet(new: DataFrame, old: DataFrame) -> DataFrame:
    """Class pairs ``sha_a < sha_b`` with a fingerprint in common."""
    a, b = new.select("fp", F.col("sha").alias("x")), old.select("fp", F.col("sha").alias("y"))
    return a.hint("merge").join(b, "fp").filter("x <> y").select(F.least("x", "y").alias("sha_a"), F.greatest("x", "y").alias("sha_b"))


def refined(docs: DataFrame, members: DataFrame, min_len: int) -> DataFrame:
    """``fp, sha``: finer keys of hot fingerprints, from more context on both sides, one grid step apart."""
    spare = min_len - K
    schema = pa.schema([("fp", pa.int64()), ("sha", pa.binary())])
    need = members.groupBy("sha").agg(F.collect_set("fp").alias("fps"))

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                sha, fps, text = (b.column(i)[at].as_py() for i in range(3))
                arr = codes(text)
                h, place = chosen(arr, min_len)
                place = place[np.isin(h, np.array(fps, np.int64).view(U64))]
                prefix = prefix_hash(arr)
                keys = [np.zeros(0, U64)]
                for left in range(0, spare + STEP, STEP):
                    # a span with at least ``left`` and less than ``left + STEP`` before the fingerprint
                    start, end = place - left, place + K + max(0, spare - left - STEP)
                    ok = (start >= 0) & (end <= len(arr))
                    keys.append(span_hash(prefix, start[ok], end[ok]) ^ U64(left + 1))
                key = np.unique(np.concatenate(keys)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([sha] * len(key), pa.binary())], schema=schema)

    texts = representatives(docs, small_or_not(need.select("sha")), min_len)
    return need.join(texts, "sha").select("sha", "fps", "text").mapInArrow(run, _ROW).distinct()


def representatives(docs: DataFrame, shas: DataFrame, min_len: int) -> DataFrame:
    """``sha, rep, text``: one document (least id) of each class in ``shas``. Texts move only for those."""
    mine = eligible(docs, min_len).withColumn("sha", _sha()).join(shas, "sha", "left_semi")
    return mine.groupBy("sha").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("rep")).select("sha", "rep", "text")


def _runs(a: str, b: str, hx: np.ndarray, hy: np.ndarray, min_len: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Equal stretches (start in a, start in b, length) that hold each shared place of ``a`` once, at its first
    place in ``b``; and whether no shared place occurs twice in either text, so that these are all there are."""
    order = np.argsort(hy, kind="stable")
    sorted_y = hy[order]
    at = np.minimum(np.searchsorted(sorted_y, hx), len(hy) - 1)
    i = np.flatnonzero(sorted_y[at] == hx)
    if not len(i):
        return [], True
    at = at[i]
    j = order[at]
    again = np.minimum(at + 1, len(hy) - 1)
    single = len(np.unique(j)) == len(j) and not ((again > at) & (sorted_y[again] == hx[i])).any()
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    spans = []
    for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]])):
        n = int(i[e - 1] - i[s]) + min_len
        if a[i[s] : i[s] + n] == b[j[s] : j[s] + n]:
            spans.append((int(i[s]), int(j[s]), n))
    return spans, single


def _unlike(x: np.ndarray, y: np.ndarray, near_x: np.ndarray, near_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (i, j) of equal ids in x and y whose neighbours differ: the ends of the equal runs.

    Only groups of one id with unlike neighbours are crossed, so the work is that of the output."""
    places, ids, near = np.concatenate([np.arange(len(x)), np.arange(len(y))]), np.concatenate([x, y]), np.concatenate([near_x, near_y])
    side = np.repeat([0, 1], [len(x), len(y)])
    order = np.lexsort((near, side, ids))
    places, ids, near, side = places[order], ids[order], near[order], side[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    end = np.concatenate([start[1:], [len(ids)]])
    most, least, right = (f.reduceat(v, start) for f, v in ((np.maximum, near), (np.minimum, near), (np.add, side)))
    left, out = end - start - right, []
    for g in np.flatnonzero((most != least) & (left > 0) & (right > 0)):
        m = start[g] + left[g]
        px, nx, py, ny = places[start[g] : m], near[start[g] : m], places[m : end[g]], near[m : end[g]]
        edge = np.flatnonzero(np.concatenate([[True], nx[1:] != nx[:-1], [True]]))
        for s, e in zip(edge[:-1], edge[1:]):
            to = py[ny != nx[s]]
            out.append((np.repeat(px[s:e], len(to)), np.tile(to, e - s)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _all_runs(a: str, b: str, hx: np.ndarray, hy: np.ndarray, min_len: int) -> list[tuple[int, int, int]]:
    """Every maximal equal stretch, whatever else its places share: first and last places are paired by diagonal."""
    ids = np.unique(np.concatenate([hx, hy]), return_inverse=True)[1].astype(np.int64)
    x, y = ids[: len(hx)], ids[len(hx) :]
    shift = lambda v, none, back: np.concatenate([[none], v[:-1]] if back else [v[1:], [none]])
    first, last = (_unlike(x, y, shift(x, -1, back), shift(y, -2, back)) for back in (True, False))
    first, last = ((i[o], j[o]) for i, j in (first, last) for o in (np.lexsort((i, i - j)),))
    n = last[0] - first[0] + min_len
    order = np.lexsort((first[1], first[0]))
    found = zip(first[0][order].tolist(), first[1][order].tolist(), n[order].tolist())
    return [(i, j, k) for i, j, k in found if a[i : i + k] == b[j : j + k]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Covered places of (start, length) as disjoint (start, end)."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n))
        else:
            out.append((s, s + n))
    return out


def shared_parts(a: str, b: str, min_len: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal equal stretches (start in a, start in b, length), one per pair of occurrences; the covered places
    (start, end) of a and of b."""
    x, y = codes(a), codes(b)
    if len(x) < min_len or len(y) < min_len:
        return [], [], []
    hx, hy = gram_hashes(x, min_len), gram_hashes(y, min_len)
    spans, single = _runs(a, b, hx, hy, min_len)
    back = [(j, n) for _, j, n in spans]
    cover = [(i, n) for i, _, n in spans]
    if not single:
        back = [(j, n) for j, _, n in _runs(b, a, hy, hx, min_len)[0]]
        spans = _all_runs(a, b, hx, hy, min_len)
    return spans, _merged(cover), _merged(back)


def shared_spans(a: str, b: str, min_len: int) -> list[tuple[int, int, int]]:
    """Maximal equal stretches (start in a, start in b, length), one per pair of occurrences."""
    return shared_parts(a, b, min_len)[0]


_SPAN = "sha_a binary, sha_b binary, rep_a bigint, rep_b bigint, spans array<struct<start_a:bigint,start_b:bigint,len:bigint>>, cover_a array<struct<s:bigint,e:bigint>>, cover_b array<struct<s:bigint,e:bigint>>"


def verified(candidates: DataFrame, docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Candidate class pairs ``sha_a, sha_b`` with their exact shared spans and covered places; pairs without one are gone.

    The work of a pair, however many of them a class has, is spread by pair, not by class.
    """
    pairs = materialize(candidates, "candidates")
    shas = pairs.select(F.col("sha_a").alias("sha")).union(pairs.select("sha_b")).distinct()
    texts = materialize(representatives(docs, small_or_not(shas), min_len), "candidate-texts")
    side = lambda c: texts.select(F.col("sha").alias(f"sha_{c}"), F.col("rep").alias(f"rep_{c}"), F.col("text").alias(f"text_{c}"))
    full = pairs.join(side("a"), "sha_a").join(side("b"), "sha_b")
    kind = pa.list_(pa.struct([("start_a", pa.int64()), ("start_b", pa.int64()), ("len", pa.int64())]))
    cover = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    schema = pa.schema([("sha_a", pa.binary()), ("sha_b", pa.binary()), ("rep_a", pa.int64()), ("rep_b", pa.int64()), ("spans", kind), ("cover_a", cover), ("cover_b", cover)])

    def run(batches):
        for b in batches:
            rows = []
            for at in range(b.num_rows):
                sha_a, sha_b, rep_a, rep_b = (b.column(i)[at].as_py() for i in range(4))
                s, in_a, in_b = shared_parts(b.column(4)[at].as_py(), b.column(5)[at].as_py(), min_len)
                if s:
                    rows.append((sha_a, sha_b, rep_a, rep_b, [dict(zip(("start_a", "start_b", "len"), x)) for x in s], *([dict(zip("se", x)) for x in c] for c in (in_a, in_b))))
            if rows:
                yield record_batch(schema, list(zip(*rows)))

    return full.select("sha_a", "sha_b", "rep_a", "rep_b", "text_a", "text_b").mapInArrow(run, _SPAN)


def class_members(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    return eligible(docs, min_len).select("doc_id", _sha().alias("sha")).distinct()


def index_batches(docs: DataFrame, n_batches: int = BATCHES, min_len: int = MIN_LEN) -> DataFrame:
    """Verified class pairs of a table that arrives in ``n_batches`` by ``ingested_at`` (nulls first).

    The texts are read once for all fingerprints, and once more for the candidates.
    """
    log = FingerprintLog(docs.sparkSession, min_len)
    marks = []
    if n_batches > 1:
        marks = docs.select(F.percentile_approx("ingested_at", [i / n_batches for i in range(1, n_batches)])).first()[0] or []
    marks = sorted(set(marks))
    number = F.lit(0)
    for m in marks:
        number = number + F.coalesce((F.col("ingested_at") > F.lit(m)).cast("int"), F.lit(0))
    plain = docs.select("doc_id", "text", number.alias("batch"))
    rows = materialize(fingerprints(plain, min_len, ("batch",)), "fingerprints", by=["batch"])
    found = None
    for i in range(len(marks) + 1):
        pairs = log.add(rows.filter(F.col("batch") == i), lambda members, hot: refined(docs, members, min_len))
        found = pairs if found is None else found.unionByName(pairs)
    return verified(found.distinct(), docs, min_len)


def document_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of documents of verified class pairs, and of documents with identical texts."""
    m = members
    cross = pairs.select("sha_a", "sha_b").join(m.select(F.col("doc_id").alias("x"), F.col("sha").alias("sha_a")), "sha_a").join(
        m.select(F.col("doc_id").alias("y"), F.col("sha").alias("sha_b")), "sha_b"
    )
    same = m.select(F.col("doc_id").alias("x"), "sha").join(m.select(F.col("doc_id").alias("y"), "sha"), "sha").filter("x < y")
    both = cross.select("x", "y").filter("x <> y").union(same.select("x", "y"))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def stretches(pairs: DataFrame) -> DataFrame:
    """One row per stretch of a class pair: where it is in both representatives."""
    return pairs.select("rep_a", "rep_b", F.inline("spans"))


def coverage(pairs: DataFrame, docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links, shared_chars, n_chars`` for every document that has text.

    ``shared_chars`` counts the code points inside stretches found in another document; a text
    with an identical copy of at least ``min_len`` is shared as a whole. ``n_links`` is the
    number of classes that share a stretch with the document's class.
    """
    m = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    m = m.select("doc_id", _sha().alias("sha"), F.length("text").cast("bigint").alias("n_chars")).dropDuplicates(["doc_id"])
    one = pairs.select(F.col("sha_a").alias("sha"), F.col("sha_b").alias("other"), F.inline("cover_a")).union(pairs.select("sha_b", "sha_a", F.inline("cover_b")))
    before = Window.partitionBy("sha").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.col("s"))))
    part = one.distinct().withColumn("gain", gain).groupBy("sha").agg(F.sum("gain").alias("part"), F.countDistinct("other").alias("n_links"))
    classes = m.groupBy("sha").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    whole = (F.col("n_copies") > 1) & (F.col("n_chars") >= min_len)
    return (
        m.join(classes, "sha").join(part, "sha", "left")
        .select("doc_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                F.when(whole, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("bigint").alias("shared_chars"), "n_chars")
    )
