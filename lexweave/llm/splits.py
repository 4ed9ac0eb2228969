"""Rows of evaluation splits that recur, exactly or nearly, in the training split (problem 1).

The method: the texts of the evaluation splits become a compressed full-text index (Burrows-
Wheeler transform over words: for each word the sorted places at which it precedes a suffix,
delta-coded and deflated where the shard is stored, and a document array; the texts are not
kept). Training rows stream in blocks through backward search, which gives for every word place
the interval of suffixes that start with the ``SHINGLE`` words there; places in a row that one
evaluation text has make a maximal match with it. The matches are merged, the distinct shingles
within them counted, and this count decides whether the pair is near.

Scale: an evaluation side of up to ``SHARD_WORDS`` words is indexed as a whole, the tasks read
the index from the shared folder and training rows are not shuffled. Identical evaluation texts
are indexed once. A larger evaluation side takes no index, as each shard would be a pass over
all training rows: the rarest shingles of each text, as many as the similarity can spare and
``SHARED``, are joined, and only texts that share ``SHARED`` are compared, by their maximal matches. With the
index a text is compared with another only if one of its rarest shingles is shared.

Defined results
---------------
* null, blank or tiny texts (under five words) have no shingles and are no near copies; they
  may still match by id, and non-empty ones by equal text;
* null or blank ids match nothing; a null or unknown ``set_name`` belongs to no split;
* repeated rows (the same ``essay_row``) count once; ties don't matter as all pairs are kept;
* empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.arrays import U64, codes, mix, prefix_hash, record_batch, span_hash
from lexweave.session import materialize, small_or_not, work_path

SHINGLE = 5
THRESHOLD = 0.85
SHARD_WORDS = 6_000_000
#: Rare shingles that two texts must share to be compared, where an index is too large.
SHARED = 3
#: At most 2**COUNT_BITS bytes in a task tell how common shingles are.
COUNT_BITS = 25
EVAL_SETS = ("test", "validation")

_SPACE = re.compile(r"\s+")
# Signs that may join two runs of letters into one word.
_JOINERS = (0x27, 0x2019)


def text_form(text: str) -> str:
    """NFC, lower case, every run of whitespace one space, trimmed."""
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text).lower()).strip()


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts and the number of each word's text.

    A word is a run of a-z of the composed, lower-cased text with at most one apostrophe and a further run.
    """
    arr = codes("\n".join(unicodedata.normalize("NFC", t).lower().replace("\n", " ") for t in texts))
    letter = np.zeros(len(arr) + 2, bool)
    np.logical_and(arr >= 97, arr <= 122, out=letter[1:-1])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    link = np.zeros(len(start), bool)  # one joiner to the next run
    link[:-1] = (start[1:] - end[:-1] == 1) & np.isin(arr[end[:-1]], _JOINERS)
    head = np.flatnonzero(~np.concatenate([[False], link[:-1]]))
    place = np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(start))))
    own = np.flatnonzero(place % 2 == 0)  # in a chain of joined runs words take two runs each
    last = own + link[own]
    line = np.cumsum(np.concatenate([[0], arr == 10]))[start[own]]
    return span_hash(prefix_hash(arr), start[own], end[last]), line


def _split(name: str | None) -> str:
    return (name or "").strip().lower()


_KEYS = pa.schema([("essay_row", pa.int64()), ("split", pa.string()), ("source", pa.string()), ("id_key", pa.string()), ("text_key", pa.binary()), ("word_key", pa.binary()), ("n_words", pa.int32())])
_KEYS_SQL = "essay_row bigint, split string, source string, id_key string, text_key binary, word_key binary, n_words int"


def _per_text(texts: list[str | None]) -> list[np.ndarray]:
    h, doc = word_hashes([t or "" for t in texts])
    return np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))


def _rows(essays: DataFrame, *columns: str) -> DataFrame:
    """Rows that may belong to a split (its name decides in Python, trimmed in one way everywhere)."""
    near = F.lower(F.col("set_name").cast("string"))
    some = near.contains("train")
    for name in EVAL_SETS:
        some = some | near.contains(name)
    return essays.filter(some).select(F.col("essay_row").cast("bigint"), *(F.col(c).cast("string") for c in ("set_name", "full_text", *columns)))


def split_keys(essays: DataFrame) -> DataFrame:
    """One row per row of a split: its trimmed split name and source, id and text keys, and for held-out rows the word key."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cols = [c.to_pylist() for c in b.slice(at, 512).columns]
                held = [t if _split(name) in EVAL_SETS else None for name, t in zip(cols[1], cols[2])]
                rows = []
                for row, name, text, ident, source, words in zip(*cols, _per_text(held)):
                    name = _split(name)
                    if row is None or (name != "train" and name not in EVAL_SETS):
                        continue
                    form = text_form(text) if text else ""
                    key = _digest(words.tobytes()) if len(words) >= SHINGLE else None
                    rows.append((row, name, _split(source) or None, _split(ident) or None, _digest(form.encode("utf-8", "surrogatepass")) if form else None, key, len(words)))
                if rows:
                    yield record_batch(_KEYS, list(zip(*rows)))

    return _rows(essays, "text_id_kaggle", "source").mapInArrow(run, _KEYS_SQL)


def _suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each text ends with its own sign. Only groups that are not settled are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n, np.int64)  # place of the first suffix of a suffix's group
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.concatenate([new[1:], [True]])
    open_, k = np.flatnonzero(~alone), 1
    while len(open_):
        suffix = order[open_]
        after = np.where(suffix + k < n, rank[np.minimum(suffix + k, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[open_] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(new, open_, 0))
        open_, k = open_[~(new & np.concatenate([new[1:], [True]]))], 2 * k
    return order


#: Slots of a shard's sieve of word sequences: places that fall through it need no search.
SIEVE = 1 << 24


def gram_codes(words: np.ndarray) -> np.ndarray:
    """Hashes of each SHINGLE words in a row."""
    m = max(0, len(words) - SHINGLE + 1)
    code = np.zeros(m, U64)
    for j in range(SHINGLE):
        code = mix(code ^ words[j : j + m])
    return code


class TextIndex:
    """Backward search over the words of a shard of evaluation texts."""

    def __init__(self, vocab, places, first, docs, keys, grams, gram_at, sieve):
        self.sieve = sieve
        self.vocab, self.n = vocab, len(places)
        symbol = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.occ = symbol * (self.n + 1) + places.astype(np.int64)  # occurrence lists, one after another
        self.docs, self.keys, self.counts, self.grams, self.gram_at = docs, keys, np.diff(gram_at), grams, gram_at
        self.first = first
        self.first_word = len(first) - 1 - len(vocab)

    @classmethod
    def pack(cls, keys: list[bytes], texts: Sequence[np.ndarray]) -> list[tuple[str, bytes]]:
        """The stored parts of the index of some texts, each the hashes of its words."""
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        vocab, ids = np.unique(np.concatenate(texts), return_inverse=True)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        s = doc.astype(np.int64)  # a text's own sign stands at its end, words elsewhere
        word = np.ones(len(s), bool)
        word[np.cumsum(sizes) - 1] = False
        s[word] = ids + len(texts)
        plain = np.zeros(len(s), U64)
        plain[word] = vocab[ids]
        left = np.cumsum(sizes)[doc] - np.arange(len(s)) - 1  # words up to the text's end
        sieve = np.zeros(SIEVE, bool)
        sieve[gram_codes(plain)[np.flatnonzero(left[: max(0, len(s) - SHINGLE + 1)] >= SHINGLE)] % U64(SIEVE)] = True
        order = _suffix_order(s)
        bwt = s[order - 1]  # the last suffix's predecessor wraps around to the last sign
        by = np.argsort(bwt, kind="stable")
        first = np.searchsorted(bwt[by], np.arange(len(texts) + len(vocab) + 1))
        left = left[order]
        gram = np.zeros(len(s), U64)
        for j in range(SHINGLE):
            gram = mix(gram ^ np.roll(s, -j).astype(U64))
        g = gram[order]
        low = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(s)), 0))
        whole = left >= SHINGLE
        pairs = np.unique(doc[order][whole].astype(np.int64) * (len(s) + 1) + low[whole])
        gdoc, glow = pairs // (len(s) + 1), pairs % (len(s) + 1)
        gram_at = np.searchsorted(gdoc, np.arange(len(texts) + 1))
        delta = np.diff(by.astype(np.int64), prepend=0).astype(np.int32)
        parts = {
            "vocab": vocab.tobytes(), "places": delta.tobytes(), "first": first.astype(np.int64).tobytes(), "docs": doc[order].tobytes(),
            "sieve": np.packbits(sieve).tobytes(), "keys": b"".join(keys), "grams": glow.astype(np.int64).tobytes(), "gram_at": gram_at.astype(np.int64).tobytes(),
        }
        return [(k, zlib.compress(v, 1)) for k, v in parts.items()]

    @classmethod
    def unpack(cls, parts: dict[str, bytes]) -> TextIndex:
        raw = {k: zlib.decompress(v) for k, v in parts.items()}
        keys = [raw["keys"][i : i + 16] for i in range(0, len(raw["keys"]), 16)]
        places = np.cumsum(np.frombuffer(raw["places"], np.int32), dtype=np.int64)
        wide = {k: np.frombuffer(raw[k], np.int64) for k in ("first", "grams", "gram_at")}
        return cls(np.frombuffer(raw["vocab"], U64), places, wide["first"], np.frombuffer(raw["docs"], np.int32), keys, wide["grams"], wide["gram_at"], np.unpackbits(np.frombuffer(raw["sieve"], np.uint8)).view(bool))

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes in [lo, hi) preceded by the symbol."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.occ, base + lo), np.searchsorted(self.occ, base + hi)

    def intervals(self, words: np.ndarray, whole: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the places ``whole`` (with codes ``code``) begin an indexed run of SHINGLE words, and the interval of suffixes of each."""
        at = whole[self.sieve[code % U64(SIEVE)]]
        use = np.zeros(len(words), bool)
        for j in range(SHINGLE):
            use[at + j] = True
        ids = np.full(len(words), -1, np.int64)
        here = np.flatnonzero(use)
        near = np.minimum(np.searchsorted(self.vocab, words[here]), len(self.vocab) - 1)
        ids[here] = np.where(self.vocab[near] == words[here], near + self.first_word, -1)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        at = at[known[at + SHINGLE] - known[at] == SHINGLE]
        last = ids[at + SHINGLE - 1]
        a, b = self.first[last], self.first[last + 1]  # suffixes that start with the last word
        for j in range(SHINGLE - 2, -1, -1):
            a, b = self.step(a, b, ids[at + j])
            ok = b > a
            at, a, b = at[ok], a[ok], b[ok]
        return at, a, b

    def matches(self, d: int, at: np.ndarray, low: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Maximal matches (start, end) in words of a text with indexed text ``d``, and which of the places ``at`` lie in one."""
        theirs = self.grams[self.gram_at[d] : self.gram_at[d + 1]]
        inside = theirs[np.minimum(np.searchsorted(theirs, low), len(theirs) - 1)] == low
        place = at[inside]
        cut = np.flatnonzero(np.diff(place) != 1) + 1
        first, last = place[np.concatenate([[0], cut])], place[np.concatenate([cut - 1, [len(place) - 1]])]
        return list(zip(first.tolist(), (last + SHINGLE).tolist())), inside

    def near(self, texts: list[np.ndarray], threshold: float) -> list[tuple[int, bytes, int, int, int, int]]:
        """(text number, word key, shared, union, longest match, words in merged matches) at ``threshold`` or more, for a block of texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        words, doc = np.concatenate([*texts, np.zeros(0, U64)]), np.repeat(np.arange(len(texts)), sizes)
        if len(words) < SHINGLE:
            return []
        whole = np.flatnonzero(doc[: len(doc) - SHINGLE + 1] == doc[SHINGLE - 1 :])
        code = gram_codes(words)[whole]
        at, lo, hi = self.intervals(words, whole, code)
        _, one = np.unique(code ^ mix(doc[whole].astype(U64) + U64(1)), return_index=True)
        distinct = np.bincount(doc[whole][one], minlength=len(texts))
        start, begin = np.searchsorted(doc[at], np.arange(len(texts) + 1)), np.concatenate([[0], np.cumsum(sizes)])
        need = np.ceil(threshold * distinct - 1e-9)
        out = []
        for t in np.flatnonzero((np.diff(start) >= need) & (distinct > 0)):
            n = int(distinct[t])
            here = slice(start[t], start[t + 1])
            low, first = np.unique(lo[here], return_index=True)
            if len(low) < need[t]:
                continue
            size = (hi - lo)[here][first]
            spare = int(n - need[t] + 1 - (n - len(low)))  # shingles that are nowhere come first among the rarest
            rare = np.argsort(size, kind="stable")[:spare]
            cand = np.unique(np.concatenate([self.docs[low[i] : low[i] + size[i]] for i in rare]))
            c = self.counts[cand]
            for k in cand[(c >= threshold * n - 1e-9) & (c * threshold <= n + 1e-9)]:
                spans, inside = self.matches(k, at[here] - begin[t], lo[here])
                shared = len(np.unique(lo[here][inside]))  # distinct shingles within the matches
                union = n + int(self.counts[k]) - shared
                if shared >= threshold * union - 1e-9:
                    out.append((int(t), self.keys[k], shared, union, max(e - s for s, e in spans), sum(e - s for s, e in merged(spans))))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def held_words(keys: DataFrame) -> int:
    """Words of the evaluation texts."""
    return keys.filter(F.col("word_key").isNotNull()).agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]


def build_index(essays: DataFrame, keys: DataFrame) -> tuple[str, int]:
    """Write the index shards of all distinct evaluation texts; their folder and number."""

    def texts(batches):
        schema = pa.schema([("word_key", pa.binary()), ("words", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                held = [t if _split(name) in EVAL_SETS else None for name, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                each = [w.tobytes() for w in _per_text(held) if len(w) >= SHINGLE]
                yield record_batch(schema, [[_digest(w) for w in each], each])

    n_shards = max(1, math.ceil(held_words(keys) / SHARD_WORDS))

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column(0)[0].as_py()
        order = np.argsort(np.array(table.column(1).to_pylist(), object))
        key, words = table.column(1).to_pylist(), table.column(2).to_pylist()
        parts = TextIndex.pack([key[i] for i in order], [np.frombuffer(words[i], U64) for i in order])
        return pa.table({"shard": pa.array([shard] * len(parts), pa.int32()), "part": [p for p, _ in parts], "data": pa.array([d for _, d in parts], pa.binary())})

    distinct = _rows(essays).mapInArrow(texts, "word_key binary, words binary").groupBy("word_key").agg(F.first("words").alias("words"))
    path = work_path(essays.sparkSession, "eval-index")
    shard = F.pmod(F.xxhash64("word_key"), F.lit(n_shards)).cast("int")
    distinct.select(shard.alias("shard"), "word_key", "words").groupBy("shard").applyInArrow(pack, "shard int, part string, data binary").write.partitionBy("shard").parquet(path)
    return path, n_shards


_loaded: dict[tuple[str, int], TextIndex | None] = {}


def load_shard(path: str, shard: int) -> TextIndex | None:
    """The shard from the shared folder; one is kept per worker process."""
    if (path, shard) not in _loaded:
        _loaded.clear()
        data = pads.dataset(re.sub(r"^s3[an]:", "s3:", path), format="parquet", partitioning="hive")
        got = data.to_table(columns=["part", "data"], filter=pads.field("shard") == shard).to_pylist() if "shard" in data.schema.names else []
        _loaded[path, shard] = TextIndex.unpack({r["part"]: r["data"] for r in got}) if got else None
    return _loaded[path, shard]


_NEAR = pa.schema([("train_row", pa.int64()), ("word_key", pa.binary()), ("shared", pa.int32()), ("united", pa.int32()), ("longest", pa.int32()), ("covered_words", pa.int32())])
_NEAR_SQL = "train_row bigint, word_key binary, shared int, united int, longest int, covered_words int"


def _prefix_size(n: int, threshold: float) -> int:
    """So many first shingles, in an order that all texts share, have ``SHARED`` in common (or all that must be common) if the texts have ``threshold`` resemblance."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + SHARED)


_GRAMS = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("n", pa.int32())])


def _texts_of(rows: DataFrame, held: bool) -> DataFrame:
    """The rows that may be of one side, by the same loose test as ``_rows``; Python decides."""
    near = F.lower("set_name")
    some = near.contains(EVAL_SETS[0]) | near.contains(EVAL_SETS[1]) if held else near.contains("train")
    return rows.filter(some & F.col("full_text").isNotNull() & F.col("essay_row").isNotNull())


#: Texts of a block: their number and a count of a byte make a key of 16 bits.
_BLOCK = 128


def _grams_of(batches, held: bool):
    """For blocks of texts of one side: their rows, the number of distinct shingles of each, and these, sorted by text and code."""
    for b in batches:
        for at in range(0, b.num_rows, _BLOCK):
            row, name, text = (c.to_pylist() for c in b.slice(at, _BLOCK).columns)
            keep = [i for i in range(len(row)) if (_split(name[i]) in EVAL_SETS if held else _split(name[i]) == "train")]
            if not keep:
                continue
            words, doc = word_hashes([text[i] for i in keep])
            code = gram_codes(words)
            whole = doc[: len(code)] == doc[SHINGLE - 1 :]
            code, doc = code[whole], doc[: len(code)][whole]
            cut = np.searchsorted(doc, np.arange(len(keep) + 1))
            for i in range(len(keep)):
                code[cut[i] : cut[i + 1]].sort()
            one = np.ones(len(code), bool)
            one[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            yield np.array([row[i] for i in keep], np.int64), np.bincount(doc[one], minlength=len(keep)), code[one]


def gram_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """How many evaluation texts have the shingles of each of ``2**bits`` slots, up to 255.

    They only decide the order in which shingles are tried (rare ones first), never which pairs are found.
    """
    low = max(0, bits - 6)  # slots are counted in parts of 2**low

    def slots(batches):
        def packed(seen):
            slot = np.sort(np.concatenate(seen) >> U64(64 - bits)).astype(np.uint32)
            part, first = np.unique(slot >> low, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in np.split(slot & np.uint32(2**low - 1), first[1:])], pa.binary())], names=["part", "data"])

        seen, size = [], 0
        for _, _, code in _grams_of(batches, True):
            seen.append(code)
            size += len(code)
            if size > 2_000_000:
                yield packed(seen)
                seen, size = [], 0
        if seen:
            yield packed(seen)

    def count(batches):
        at: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.bincount(np.frombuffer(data.as_buffer(), np.uint32), minlength=2**low)
                at[part] = np.minimum(at.get(part, 0) + got, 255).astype(np.uint8).astype(np.int64)
        for part, n in at.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n.astype(np.uint8).tobytes()], pa.binary())], names=["part", "data"])

    out = np.zeros((2 ** (bits - low), 2**low), np.uint8)
    sent = _texts_of(rows, True).mapInArrow(slots, "part int, data binary").repartition(2 ** (bits - low), "part")
    for part, data in sent.mapInArrow(count, "part int, data binary").collect():
        out[part] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def candidate_pairs(rows: DataFrame, threshold: float, bits: int) -> DataFrame:
    """``train_row, eval_row`` of all pairs that can have ``threshold`` resemblance: ``SHARED`` of their rarest shingles are shared and their numbers of shingles allow it."""
    counts = rows.sparkSession.sparkContext.broadcast(gram_counts(rows, bits))

    def side(held: bool) -> DataFrame:
        def run(batches):
            for row, sizes, code in _grams_of(batches, held):
                text = np.repeat(np.arange(len(row)), sizes)
                rare = counts.value[(code >> U64(64 - bits)).astype(np.int64)]
                order = np.argsort((text << 8 | rare).astype(np.uint16), kind="stable")  # then by code
                place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = order[place < np.repeat([_prefix_size(int(k), threshold) for k in sizes], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), pa.array(row[text[first]]), pa.array(sizes[text[first]].astype(np.int32))], schema=_GRAMS)

        return _texts_of(rows, held).mapInArrow(run, "gram bigint, row bigint, n int")

    a = side(False).select("gram", F.col("row").alias("train_row"), F.col("n").alias("n_train"))
    b = side(True).select("gram", F.col("row").alias("eval_row"), F.col("n").alias("n_eval"))
    t = F.lit(threshold)
    met = a.join(b.hint("merge"), "gram").filter((F.col("n_eval") >= t * F.col("n_train") - 1e-9) & (F.col("n_train") >= t * F.col("n_eval") - 1e-9))
    need = F.least(F.lit(SHARED), F.ceil(t * F.min(F.greatest("n_train", "n_eval")) - 1e-9))  # a repeated row may only count more
    return met.groupBy("train_row", "eval_row").agg(F.count("*").alias("shared"), need.alias("need")).filter("shared >= need").select("train_row", "eval_row")


def compared(words: np.ndarray, other: np.ndarray) -> tuple[int, int, int, int]:
    """Shingles shared and united, longest match, and words in merged matches, of two texts given by the hashes of their words."""
    code, theirs = gram_codes(words), np.unique(gram_codes(other))
    place = np.flatnonzero(theirs[np.minimum(np.searchsorted(theirs, code), len(theirs) - 1)] == code)
    if not len(place):
        return 0, len(np.unique(code)) + len(theirs), 0, 0
    cut = np.flatnonzero(np.diff(place) != 1) + 1  # places in a row are a maximal match
    first, last = place[np.concatenate([[0], cut])], place[np.concatenate([cut - 1, [len(place) - 1]])]
    spans = list(zip(first.tolist(), (last + SHINGLE).tolist()))
    shared = len(np.unique(code[place]))
    return shared, len(np.unique(code)) + len(theirs) - shared, max(e - s for s, e in spans), sum(e - s for s, e in merged(spans))


def routed_copies(essays: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """As ``near_copies``, for evaluation sides of any size: pairs that share a rare shingle meet in a join, and the
    maximal matches of the two texts decide. No training row is read once per shard."""
    rows = _rows(essays)
    pairs = materialize(candidate_pairs(rows, threshold, min(COUNT_BITS, max(16, held_words(keys).bit_length() + 1))), "near-candidates")

    def texts(held: bool, row: str) -> DataFrame:
        side = _texts_of(rows, held).select(F.col("essay_row").alias(row), F.col("set_name").alias(f"{row}_set"), F.col("full_text").alias(f"{row}_text"))
        return side.join(small_or_not(pairs.select(row).distinct()), row, "left_semi")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                row, a_set, a, b_set, c = (x.to_pylist() for x in b.slice(at, 256).columns)
                keep = [i for i in range(len(row)) if _split(a_set[i]) == "train" and _split(b_set[i]) in EVAL_SETS]
                out = []
                for i, x, y in zip(keep, _per_text([a[i] for i in keep]), _per_text([c[i] for i in keep])) if keep else ():
                    if min(len(x), len(y)) >= SHINGLE:
                        got = compared(x, y)
                        if got[0] >= threshold * got[1] - 1e-9:
                            out.append((row[i], _digest(y.tobytes()), *got))
                if out:
                    yield record_batch(_NEAR, list(zip(*out)))

    met = pairs.join(texts(False, "train_row"), "train_row").join(texts(True, "eval_row"), "eval_row")
    found = met.select("train_row", "train_row_set", "train_row_text", "eval_row_set", "eval_row_text").mapInArrow(run, _NEAR_SQL)
    return found.distinct()  # evaluation texts may be the same


def near_copies(essays: DataFrame, keys: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Training rows and evaluation texts (by word key) of at least ``threshold`` resemblance, by their maximal matches.

    Evaluation texts of one shard are held as an index in the tasks; more of them would need a pass over the training rows each.
    """
    if held_words(keys) > SHARD_WORDS:
        return routed_copies(essays, keys, threshold)
    path, _ = build_index(essays, keys)

    def run(batches):
        index = load_shard(path, 0)
        for b in batches:
            for at in range(0, b.num_rows if index is not None else 0, 256):
                part = b.slice(at, 256)
                row, name, text = (part.column(i).to_pylist() for i in range(3))
                keep = [i for i in range(len(row)) if row[i] is not None and text[i] and _split(name[i]) == "train"]
                found = index.near(_per_text([text[i] for i in keep]), threshold) if keep else []
                if found:
                    yield record_batch(_NEAR, list(zip(*((row[keep[t]], *rest) for t, *rest in found))))

    return _rows(essays).mapInArrow(run, _NEAR_SQL)


def overlaps(essays: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs ``train_row, eval_row`` with the evaluation row's ``set_name`` and ``source``, the reasons ``same_id``,
    ``same_text``, ``near_text``, and where near the resemblance, the longest match and the words in merged matches."""
    keys = materialize(split_keys(essays), "split-keys")
    train = keys.filter("split = 'train'")
    held = keys.filter(F.col("split").isin(*EVAL_SETS))
    side = [F.col("essay_row").alias("eval_row"), F.col("split").alias("set_name"), F.coalesce("source", F.lit("(none)")).alias("source")]
    measures = {"resemblance": "double", "longest": "int", "covered_words": "int"}

    def equal(key: str, reason: str) -> DataFrame:
        a = train.select(F.col("essay_row").alias("train_row"), key).filter(F.col(key).isNotNull())
        b = held.select(*side, key).filter(F.col(key).isNotNull())
        return a.join(b, key).select("train_row", "eval_row", "set_name", "source", F.lit(reason).alias("reason"), *(F.lit(None).cast(t).alias(c) for c, t in measures.items()))

    near = near_copies(essays, keys, threshold).join(held.select(*side, "word_key"), "word_key")
    near = near.select("train_row", "eval_row", "set_name", "source", F.lit("near_text").alias("reason"), (F.col("shared") / F.col("united")).alias("resemblance"), "longest", "covered_words")
    every = equal("id_key", "same_id").unionByName(equal("text_key", "same_text")).unionByName(near)
    return every.groupBy("train_row", "eval_row").agg(
        F.min("set_name").alias("set_name"), F.min("source").alias("source"), *(F.max(F.col("reason") == r).alias(r) for r in ("same_id", "same_text", "near_text")),
        F.max("resemblance").alias("resemblance"), F.max("longest").alias("longest_match"), F.max("covered_words").alias("covered_words"),
    )


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation row: pairs, evaluation rows and training rows concerned, by reason."""
    return pairs.groupBy("set_name", "source").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("eval_row").alias("n_eval_rows"), F.countDistinct("train_row").alias("n_train_rows"),
        *(F.count(F.when(F.col(r), 1)).alias(f"n_{r}") for r in ("same_id", "same_text", "near_text")),
    )
