"""Texts into containers of fixed capacity (problem 6).

The method, best-two-fit: a container takes the largest unpacked item, then again and again
the largest that fits its gap; when none fits, its smallest item is given back if two
unpacked items together fill the widened gap more tightly.

Sizes are tokens of a public tokenizer, counted exactly: the byte-pair merges never cross the
pieces of the tokenizer's pattern, so each distinct piece is encoded once per worker.
Items are packed per shard of at most about ``SHARD_ITEMS`` items with a table of counts by
size, so time is linear in the items and memory bounded; each shard leaves at most one
badly filled container.

Defined results
---------------
* null texts: one row with null container and 0 tokens; empty texts: 0 tokens, container null
  (they take no room);
* texts over the capacity are cut into full pieces and a rest, only the rest shares a
  container; equal sizes are taken in order of ``doc_id``; repeated rows are packed each;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize

CAPACITY = 2048
SHARD_ITEMS = 65_536
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the piece pattern of the byte-level tokenizer, and what it is for ASCII text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


class TokenCounter(dict):
    """Token count of a piece, encoded at its first use."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < 2_000_000:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        pieces = _ASCII.findall(text) if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text else self.pattern.findall(text)
        return sum(map(self.__getitem__, pieces))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens``; null for a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        c = counter(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n = [None if t is None else c.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is 1 .. capacity."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    have: list[int] = np.flatnonzero(count).tolist()  # sizes in stock, ascending

    def take(s: int) -> None:
        count[s] -= 1
        if not count[s]:
            del have[bisect.bisect_left(have, s)]

    def give(s: int) -> None:
        count[s] += 1
        if count[s] == 1:
            bisect.insort(have, s)

    out = []
    while have:
        box, gap = [], capacity
        while have and have[0] <= gap:
            s = have[bisect.bisect_right(have, gap) - 1]
            take(s)
            box.append(s)
            gap -= s
        if gap and have and len(box) > 1:
            room, least = gap + box[-1], box[-1]
            x = np.array(have[: bisect.bisect_right(have, room - 1)], np.int64)
            if len(x):
                # the best partner of each x is the largest size in stock that still fits
                at = np.searchsorted(x, room - x, side="right") - 1
                partner = np.where(at >= 0, x[np.maximum(at, 0)], 0)
                twice = (partner == x) & (count[x] < 2)
                below = np.where(at > 0, x[np.maximum(at - 1, 0)], 0)
                partner = np.where(twice, below, partner)
                total = np.where(partner > 0, x + partner, 0)
                k = int(np.argmax(total))
                if total[k] > least:
                    box.pop()
                    give(least)
                    for s in (int(x[k]), int(partner[k])):
                        take(s)
                        box.append(s)
        out.append(box)
    return out


_OUT = "doc_id bigint, piece int, n_pieces int, n_tokens bigint, container bigint, position int, offset int"


def pack(counts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, piece, n_pieces, n_tokens, container, position, offset`` for every text or piece of it."""
    counts = materialize(counts, "token-counts")
    n_items = counts.filter("n_tokens > 0").count()
    n_shards = max(1, math.ceil(n_items / shard_items))
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") % capacity
    n_pieces = whole + F.when(rest > 0, 1).otherwise(0)
    some = counts.filter("n_tokens > 0").select("doc_id", "n_tokens", whole.alias("whole"), rest.alias("rest"), n_pieces.cast("int").alias("n_pieces"))
    # the salt spreads repeated ids too
    shard = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int") if n_shards > 1 else F.lit(0)

    def run(table: pa.Table) -> pa.Table:
        base = table.column("shard")[0].as_py() << 40
        col = {n: table.column(n).to_numpy() for n in ("doc_id", "whole", "rest", "n_pieces")}
        order = np.lexsort((col["doc_id"], col["rest"]))
        col = {n: v[order] for n, v in col.items()}
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "n_pieces", "n_tokens", "container", "position", "offset")}

        def add(i: int, piece: int, size: int, box: int, position: int, offset: int) -> None:
            for n, v in zip(out, (int(col["doc_id"][i]), piece, int(col["n_pieces"][i]), size, box, position, offset)):
                out[n].append(v)

        box = base
        for i in np.flatnonzero(col["whole"]):
            for p in range(col["whole"][i]):
                add(i, p, capacity, box, 0, 0)
                box += 1
        sizes = col["rest"]
        next_of = np.searchsorted(sizes, np.arange(capacity + 1)).tolist()  # next unused row of each size
        for content in best_two_fit(sizes[sizes > 0], capacity):
            offset = 0
            for position, s in enumerate(content):
                i = next_of[s]
                next_of[s] += 1
                add(i, int(col["whole"][i]), s, box, position, offset)
                offset += s
            box += 1
        kinds = {"piece": pa.int32(), "n_pieces": pa.int32(), "position": pa.int32(), "offset": pa.int32()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    packed = some.withColumn("shard", shard).groupBy("shard").applyInArrow(run, _OUT)
    none = counts.filter("n_tokens is null or n_tokens = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("offset"),
    )
    return packed.union(none)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of the capacity in use."""
    boxes = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return boxes.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.min("used").alias("least_used"), F.max("used").alias("most_used"),
    )


def default_tokenizer(folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, "byte_bpe_50k.tiktoken")
