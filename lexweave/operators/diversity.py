"""Lexical diversity per group of ordered tokens (Panel A).

Every operator takes a frame with the key columns, ``pos`` (1, 2, ... within the key) and a
token column, and returns one row per key. All is native but vocd, whose definition is a
seeded sampling.

Null tokens do not occur (the tokenizer makes none); keys without tokens have no row;
undefined values are null.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Recommended minimum tokens of each index, and its direction and name.
FLOORS = {
    "ttr": 1, "rttr": 1, "cttr": 1, "herdan": 2, "maas": 2, "msttr": 50, "mattr": 50, "mtld": 50, "hdd": 42, "vocd": 50, "yule_k": 100, "yule_i": 100,
}
INDICES = tuple(FLOORS)
LOWER_IS_DIVERSE = ("maas", "yule_k")
PRETTY = {
    "ttr": "TTR", "rttr": "Root TTR", "cttr": "Corrected TTR", "herdan": "Herdan's C", "maas": "Maas", "msttr": "MSTTR", "mattr": "MATTR", "mtld": "MTLD",
    "hdd": "HD-D", "vocd": "vocd-D", "yule_k": "Yule's K", "yule_i": "Yule's I",
}


def required_tokens(key: str, segment: int = 50, window: int = 50, hdd_sample: int = 42, override: int | None = None) -> int:
    """Minimum tokens of an index under the settings; an override applies only above a floor of one."""
    floor = FLOORS[key]
    floor = max(floor, {"msttr": segment, "mattr": window, "hdd": hdd_sample, "vocd": 50}.get(key, 0))
    return override if override is not None and floor > 1 else floor


def spectrum(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """``keys, freq, n_types``: how many types occur ``freq`` times."""
    counts = tokens.groupBy(*keys, token).agg(F.count("*").alias("freq"))
    return counts.groupBy(*keys, "freq").agg(F.count("*").alias("n_types"))


def basic(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """Counts and the closed-form indices, aggregated once per key."""
    counts = tokens.groupBy(*keys, token).agg(F.count("*").alias("c"))
    agg = counts.groupBy(*keys).agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_types"), F.sum(F.col("c") * F.col("c")).alias("m2"))
    n, v, m2 = F.col("n_tokens").cast("double"), F.col("n_types").cast("double"), F.col("m2").cast("double")
    more = F.col("n_tokens") > 1
    return agg.select(
        *keys, "n_tokens", "n_types",
        (v / n).alias("ttr"), (v / F.sqrt(n)).alias("rttr"), (v / F.sqrt(2 * n)).alias("cttr"),
        F.when(more, F.try_divide(F.ln(v), F.ln(n))).alias("herdan"),
        F.when(more, F.try_divide(F.ln(n) - F.ln(v), F.pow(F.ln(n), 2))).alias("maas"),
        (F.lit(1e4) * (m2 - n) / (n * n)).alias("yule_k"),
        F.try_divide(v * v, m2 - v).alias("yule_i"),
    )


def msttr(tokens: DataFrame, keys: list[str], token: str = "token", segment: int = 50) -> DataFrame:
    """Mean TTR of whole segments; a text shorter than a segment is one."""
    n = F.count("*").over(W.partitionBy(*keys))
    size = F.least(F.lit(segment), n)
    seg = tokens.withColumn("L", size).withColumn("seg", F.floor((F.col("pos") - 1) / F.col("L")))
    per = seg.groupBy(*keys, "seg", "L").agg(F.count("*").alias("n"), F.count_distinct(token).alias("v"))
    return per.filter("n = L").groupBy(*keys).agg(F.avg(F.col("v") / F.col("L")).alias("msttr"))


def linked(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """Adds ``n``, and ``prev`` and ``next``: places of the same token before and after (0 if none)."""
    same = W.partitionBy(*keys, token).orderBy("pos")
    return tokens.select(
        *keys, "pos", F.coalesce(F.lag("pos").over(same), F.lit(0)).alias("prev"), F.coalesce(F.lead("pos").over(same), F.lit(0)).alias("next"),
    ).withColumn("n", F.count("*").over(W.partitionBy(*keys)))


def mattr(tokens: DataFrame, keys: list[str], token: str = "token", window: int = 50) -> DataFrame:
    """Mean TTR of all windows: each token counts for the window starts in which it comes first."""
    x = linked(tokens, keys, token).withColumn("w", F.least(F.lit(window), F.col("n")))
    first = F.greatest(F.col("prev") + 1, F.col("pos") - F.col("w") + 1, F.lit(1))
    last = F.least(F.col("pos"), F.col("n") - F.col("w") + 1)
    starts = F.greatest(F.lit(0), last - first + 1)
    return x.groupBy(*keys).agg((F.sum(starts) / F.max(F.col("w") * (F.col("n") - F.col("w") + 1))).alias("mattr"))


def _factors(steps: Column, threshold: float, least: int) -> Column:
    """Factor count of one pass over ordered (pos, prev); the state is four numbers, no set."""
    zero = F.struct(
        F.lit(1).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("types"), F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("factors")
    )

    def step(a: Column, x: Column) -> Column:
        types = a["types"] + F.when(x["prev"] < a["start"], 1).otherwise(0)
        count = a["count"] + 1
        full = (types / count <= F.lit(threshold)) & (count >= least)
        return F.struct(
            F.when(full, x["pos"] + 1).otherwise(a["start"]).cast("bigint").alias("start"),
            F.when(full, F.lit(0)).otherwise(types).cast("bigint").alias("types"),
            F.when(full, F.lit(0)).otherwise(count).cast("bigint").alias("count"),
            (a["factors"] + F.when(full, 1.0).otherwise(0.0)).alias("factors"),
        )

    def end(a: Column) -> Column:
        rest = F.when(a["count"] > 0, (1 - a["types"] / a["count"]) / F.lit(1 - threshold)).otherwise(0.0)
        return a["factors"] + rest

    return F.aggregate(steps, zero, step, end)


def mtld(tokens: DataFrame, keys: list[str], token: str = "token", threshold: float = 0.72, least: int = 10) -> DataFrame:
    """Mean of the forward and backward mean factor length."""
    # one list a key; it is turned around only while the key is measured
    all_ = linked(tokens, keys, token).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "prev", "next"))).alias("fwd"))
    turn = F.size("fwd").cast("bigint") + 1
    both = all_.withColumn(
        "bwd", F.transform(F.reverse("fwd"), lambda x: F.struct((turn - x["pos"]).alias("pos"), F.when(x["next"] > 0, turn - x["next"]).otherwise(0).alias("prev")))
    )
    n = F.size("fwd").cast("double")
    one = lambda c: F.try_divide(n, _factors(F.col(c), threshold, least))
    f, b = one("fwd"), one("bwd")
    return both.select(*keys, f.alias("mtld_forward"), b.alias("mtld_backward"), F.coalesce((f + b) / 2, f, b).alias("mtld"))


def hdd(tokens: DataFrame, keys: list[str], token: str = "token", sample: int = 42) -> DataFrame:
    """Hypergeometric expectation of TTR in samples; evaluated once per frequency, not per type."""
    s = spectrum(tokens, keys, token).withColumn("n", F.sum(F.col("freq") * F.col("n_types")).over(W.partitionBy(*keys)))
    size = F.least(F.lit(sample), F.col("n")).cast("int")
    absent = F.aggregate(
        F.sequence(F.lit(0), size - 1), F.lit(1.0), lambda a, j: a * F.greatest(F.col("n") - F.col("freq") - j, F.lit(0)) / (F.col("n") - j)
    )
    part = F.col("n_types") * (1 - absent) / size
    return s.withColumn("part", part).groupBy(*keys).agg(F.least(F.lit(1.0), F.sum("part")).alias("hdd"))


def vocd_of(words: list[str], seed: int = 42, trials: int = 100, top: float = 200.0, runs: int = 3) -> float | None:
    """D by seeded sampling of 35 .. 50 tokens and a two-stage grid fit, averaged over the runs that converge."""
    import numpy as np

    n = len(words)
    hi = min(50, n)
    lo = min(35, hi)
    if n == 0:
        return None
    sizes = np.arange(lo, hi + 1, dtype=float)

    def errors(d: np.ndarray, seen: np.ndarray) -> np.ndarray:
        d = d[:, None]
        return (((d / sizes) * (np.sqrt(1 + 2 * sizes / d) - 1) - seen) ** 2).sum(axis=1)

    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = [number[w] for w in words]
    kept = []
    for r in range(runs):
        rng = random.Random(seed + r)
        seen = np.array([sum(len(set(rng.sample(ids, k))) / k for _ in range(trials)) / trials for k in range(lo, hi + 1)])
        grid = np.linspace(1.0, top, 400)
        best = float(grid[int(np.argmin(errors(grid, seen)))])
        if best >= top - 0.5:
            continue
        fine = np.concatenate([[best], np.linspace(max(1.0, best - 1), min(top, best + 1), 200)])
        kept.append(float(fine[int(np.argmin(errors(fine, seen)))]))
    return sum(kept) / len(kept) if kept else None


class Draws:
    """The samples of ``vocd_of``. The places drawn depend on the number of words only, so texts of one length share them.

    ``counts(n)`` holds for each place a bit for every sample that has it (the samples of a run and size in 128 bits). The
    types of all samples of a size are then the bits that are set in the union of the places of each type.
    """

    def __init__(self, seed: int = 42, trials: int = 100, top: float = 200.0, runs: int = 3):
        import numpy as np

        if trials > 128:
            raise ValueError("at most 128 samples of a size")
        self.seed, self.trials, self.top, self.runs, self.made = seed, trials, top, runs, (0, None)
        self.grid, self.curves = np.linspace(1.0, top, 400), {}
        self.streams = [(random.Random(seed + r), []) for r in range(runs)]  # the generators' words of 32 bits

    def _stream(self, r: int, least: int):
        import numpy as np

        rng, parts = self.streams[r]
        while sum(map(len, parts)) < least:
            parts.append(np.frombuffer(rng.getrandbits(32 * 200_000).to_bytes(800_000, "little"), np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _drawn(self, r: int, n: int, sizes: range):
        """Places drawn in a run, sample after sample, as ``random.sample`` draws them, and how many each sample takes; a place may be there twice."""
        import numpy as np

        least = 1
        while True:
            raw = self._stream(r, least)
            try:
                return (self._from_list if n <= 21 + (4 ** math.ceil(math.log(3 * sizes[0], 4)) if sizes[0] > 5 else 0) else self._from_set)(raw, n, sizes)
            except IndexError:
                least = len(raw) + 1

    def _from_list(self, raw, n: int, sizes: range):
        """Short texts: a drawn place is filled with the last one, and the next draw is from one place less."""
        import numpy as np

        stream, all_, at, out, lens = raw.tolist(), list(range(n)), 0, [], []
        for k in sizes:
            steps = [(n - i, 32 - (n - i).bit_length()) for i in range(k)]
            for _ in range(self.trials):
                pool = all_[:]
                for left, shift in steps:
                    j = stream[at] >> shift
                    at += 1
                    while j >= left:
                        j = stream[at] >> shift
                        at += 1
                    out.append(pool[j])
                    pool[j] = pool[left - 1]
                lens.append(k)
        return np.array(out, np.int32), np.array(lens)

    def _from_set(self, raw, n: int, sizes: range):
        """Long texts: a place that the sample has is drawn again."""
        import numpy as np

        drawn = raw >> np.uint32(32 - n.bit_length())
        drawn = drawn[drawn < n].astype(np.int32)
        some = int(sum(sizes) * self.trials * (1 + 60 / n) + 5000) * (len(raw) // 200_000)  # what is needed as a rule
        drawn = drawn[:some]
        by = np.argsort(drawn.astype(np.uint16) if n < 65536 else drawn, kind="stable")
        again = np.flatnonzero(drawn[by[1:]] == drawn[by[:-1]])
        place, before = by[again + 1], by[again]  # a place drawn again, and when it was drawn before
        near = place - before < 1000  # far longer than a sample
        turn = np.argsort(place[near])
        place, before = [*place[near][turn].tolist(), len(drawn) + 1000], before[near][turn].tolist()
        at, i, lens = 0, 0, []
        for k in sizes:
            for _ in range(self.trials):
                end = at + k
                while place[i] < end:
                    end += before[i] >= at
                    i += 1
                lens.append(end - at)
                at = end
        if at > len(drawn):
            raise IndexError
        return drawn[:at], np.array(lens)

    def counts(self, n: int):
        import numpy as np

        if self.made[0] != n:
            sizes = range(min(35, n), min(50, n) + 1)
            out = np.zeros((n, self.runs, len(sizes), 16), np.uint8)
            step = max(1, (1 << 24) // (128 * n))  # sizes at a time, so that memory does not follow the text
            for r in range(self.runs):
                places, lens = self._drawn(r, n, sizes)
                ends = np.concatenate([[0], np.cumsum(lens)])
                column = np.repeat(np.arange(len(lens)) // self.trials * 128 + np.arange(len(lens)) % self.trials, lens)
                for i in range(0, len(sizes), step):
                    k = min(step, len(sizes) - i)
                    part = slice(ends[i * self.trials], ends[(i + k) * self.trials])
                    has = np.zeros((n, k * 128), bool)
                    has[places[part], column[part] - i * 128] = True
                    out[:, r, i : i + k] = np.packbits(has, axis=1).reshape(n, k, 16)
            self.made = n, out.reshape(n, -1).view(np.uint64)
        return self.made[1]

    def vocd(self, words) -> float | None:
        """``vocd_of`` of a text given by the numbers of its words."""
        import numpy as np

        n = len(words)
        if n == 0:
            return None
        sizes = np.arange(min(35, n), min(50, n) + 1)
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(words[order]) != 0]))
        types = np.bitwise_count(np.bitwise_or.reduceat(self.counts(n)[order], first, axis=0)).sum(axis=0, dtype=np.uint32)
        seen = types.reshape(self.runs, len(sizes), 2).sum(axis=2) / sizes / self.trials

        def curve(d: np.ndarray) -> np.ndarray:
            d = d[..., None]
            return (d / sizes) * (np.sqrt(1 + 2 * sizes / d) - 1)

        if len(sizes) not in self.curves or len(sizes) == 1:
            self.curves[len(sizes)] = curve(self.grid[None])
        best = self.grid[((self.curves[len(sizes)] - seen[:, None, :]) ** 2).sum(axis=2).argmin(axis=1)]
        seen, best = seen[best < self.top - 0.5], best[best < self.top - 0.5]
        if not len(best):
            return None
        fine = np.concatenate([best[:, None], np.linspace(np.maximum(1.0, best - 1), np.minimum(self.top, best + 1), 200, axis=1)], axis=1)
        kept = fine[np.arange(len(best)), ((curve(fine) - seen[:, None, :]) ** 2).sum(axis=2).argmin(axis=1)].tolist()
        return sum(kept) / len(kept)


def vocd(docs: DataFrame, keys: list[str], words: str = "tokens", seed: int = 42) -> DataFrame:
    """``keys, vocd`` from an array column of ordered tokens, in Arrow batches; texts of one length lie together and share their samples."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    types = [f for f in docs.select(*keys).schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types) + ", vocd double"

    def run(batches):
        draws = Draws(seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column(len(types))
                number = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum([n or 0 for n in pc.list_value_length(lists).to_pylist()])
                values = [draws.vocd(number[e - n : e]) for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(types))), pa.array(values, pa.float64())], names=[*(f.name for f in types), "vocd"])

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    size = F.coalesce(F.size(words), F.lit(0)).alias("size")
    lying = docs.select(*keys, words, size).repartitionByRange(n, F.xxhash64("size"), F.xxhash64(*keys)).sortWithinPartitions("size")  # a frequent length takes several partitions
    return lying.drop("size").mapInArrow(run, ddl)


def vocd_expected(tokens: DataFrame, keys: list[str], token: str = "token", top: float = 200.0) -> DataFrame:
    """D fitted to the exact hypergeometric expectation of TTR at 35 .. 50 tokens: no sampling, all native.

    Texts of fewer than 50 tokens have null; so has a fit pinned to the ceiling.
    """
    s = spectrum(tokens, keys, token).withColumn("n", F.sum(F.col("freq") * F.col("n_types")).over(W.partitionBy(*keys))).filter("n >= 50")
    # the product for one size continues that of the size before
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(49)),
        F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("all")),
        lambda a, j: F.struct(
            (F.try_divide(a["p"] * F.greatest(F.col("n") - F.col("freq") - j, F.lit(0)), F.col("n") - j)).alias("p"),
            F.concat(a["all"], F.array(F.try_divide(a["p"] * F.greatest(F.col("n") - F.col("freq") - j, F.lit(0)), F.col("n") - j))).alias("all"),
        ),
        lambda a: a["all"],
    )
    per = s.withColumn("absent", series).select(*keys, "n_types", F.posexplode("absent").alias("j", "p")).filter("j >= 34")
    seen = per.groupBy(*keys, "j").agg((F.sum(F.col("n_types") * (1 - F.col("p"))) / F.first(F.col("j") + 1)).alias("ttr"))
    curve = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "ttr"))).alias("curve"))

    def fit(grid: Column) -> Column:
        def error(d: Column) -> Column:
            return F.aggregate("curve", F.lit(0.0), lambda a, x: a + F.pow((d / (x["j"] + 1)) * (F.sqrt(1 + 2 * (x["j"] + 1) / d) - 1) - x["ttr"], 2))

        return F.array_min(F.transform(grid, lambda d: F.struct(error(d).alias("e"), d.alias("d"))))["d"]

    step = (top - 1) / 399
    coarse = curve.withColumn("best", fit(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: 1 + i * F.lit(step))))
    fine = fit(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.greatest(F.lit(1.0), F.col("best") - 1 + i * F.lit(0.01))))
    return coarse.select(*keys, F.when(F.col("best") < top - 0.5, fine).alias("vocd_expected"))


def panel_a(tokens: DataFrame, keys: list[str], token: str = "token", segment: int = 50, window: int = 50, sample: int = 42, threshold: float = 0.72) -> DataFrame:
    """All native indices, one row per key; the parts share the partitioning on the key."""
    out = basic(tokens, keys, token)
    for part in (msttr(tokens, keys, token, segment), mattr(tokens, keys, token, window), mtld(tokens, keys, token, threshold).select(*keys, "mtld"), hdd(tokens, keys, token, sample)):
        out = out.join(part, keys, "left")
    return out


def long_form(wide: DataFrame, keys: list[str], indices: tuple[str, ...] = INDICES) -> DataFrame:
    """``keys, index_key, value`` and its name and direction."""
    have = [i for i in indices if i in wide.columns]
    rows = wide.unpivot([*keys], have, "index_key", "value")
    name = F.create_map(*(F.lit(x) for kv in PRETTY.items() for x in kv))
    return rows.select(*keys, "index_key", name[F.col("index_key")].alias("index"), "value", F.when(F.col("index_key").isin(*LOWER_IS_DIVERSE), "lower").otherwise("higher").alias("direction"))
