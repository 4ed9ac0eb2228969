"""Array kernels over batches of texts: code points, runs, hashes; no Python loop per word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
#: Odd multiplier of the prefix hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Texts are joined into blocks of about this many code points, so memory does not follow the batch size.
BLOCK = 1_000_000

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + BLOCK // 4)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (finalizer of splitmix)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of symbol * BASE**place over [i, j)."""
    out = np.empty(len(symbols) + 1, U64)
    out[0] = 0
    np.cumsum(symbols.astype(U64) * powers(BASE, len(symbols)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal content wherever it stands."""
    h = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of about BLOCK code points in all; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > BLOCK:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The runs of a-z in lower-cased texts: for each its text, place and 64-bit hash."""

    def __init__(self, texts: list[str]):
        data = "\n".join(texts).encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        letter = np.zeros(len(raw) + 2, bool)
        np.logical_and(raw >= 97, raw <= 122, out=letter[1:-1])
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.raw, self.data = raw, data
        self.hash = span_hash(prefix_hash(raw), self.start, self.end)
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1


def map_texts(
    df: DataFrame, fn: Callable[[list, list[str]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``fn(ids, texts)`` over blocks of the two columns of ``df``; null texts do not reach it."""

    def run(batches):
        for batch in batches:
            step = 512  # strings of a batch become Python objects a slice at a time
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if t is not None]
                ids, texts = [ids[i] for i in keep], [texts[i] for i in keep]
                for i, j in blocks(texts):
                    yield from fn(ids[i:j], texts[i:j])

    return df.mapInArrow(run, schema)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
