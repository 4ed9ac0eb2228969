"""Corpus tables: n-grams, dispersion over parts, association, bootstrap intervals.

Parts without a word count as empty where the measure says so; words never occur zero times.
A corpus without tokens gives empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.operators.ordered import running
from lexweave.session import materialize, small_or_not


def unigrams(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``token, frequency, document_frequency``: counted per document first, so a hot word is combined map-side."""
    per = tokens.groupBy("token", doc).agg(F.count("*").alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("frequency"), F.count("*").alias("document_frequency"))


def ngrams(tokens: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """``w1 .. wn, frequency`` of contiguous n-grams that stay within a document."""
    w = W.partitionBy(doc).orderBy("pos")
    cols = [F.col("token").alias("w1"), *(F.lead("token", k).over(w).alias(f"w{k + 1}") for k in range(1, n))]
    return tokens.select(*cols).filter(F.col(f"w{n}").isNotNull()).groupBy(*(f"w{k}" for k in range(1, n + 1))).agg(F.count("*").alias("frequency"))


def corpus_stats(docs: DataFrame, n_tokens: Column, text: str = "text") -> DataFrame:
    one = docs.select(n_tokens.alias("n"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))
    return one.agg(
        F.count("*").alias("documents"), F.count(F.when(F.coalesce("n", F.lit(0)) == 0, 1)).alias("empty_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("characters"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def association(tokens: DataFrame, doc: str = "doc_id", least: int = 2) -> DataFrame:
    """Bigram association: mutual information, its cubed-frequency form, t-score, log-likelihood and both delta-P.

    Margins come from the bigram table itself; the totals are one row.
    """
    bi = ngrams(tokens, 2, doc)
    left = bi.groupBy("w1").agg(F.sum("frequency").alias("f1"))
    right = bi.groupBy("w2").agg(F.sum("frequency").alias("f2"))
    total = F.broadcast(bi.agg(F.sum("frequency").alias("n")))
    t = bi.filter(F.col("frequency") >= least).join(left, "w1").join(right, "w2").crossJoin(total)
    a, f1, f2, n = (F.col(c).cast("double") for c in ("frequency", "f1", "f2", "n"))
    b, c, d = f1 - a, f2 - a, n - f1 - f2 + a
    expected = f1 * f2 / n

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)

    g2 = 2 * (part(a, expected) + part(b, f1 * (n - f2) / n) + part(c, (n - f1) * f2 / n) + part(d, (n - f1) * (n - f2) / n))
    return t.select(
        "w1", "w2", "frequency", F.log2(a / expected).alias("mi"), F.log2(a * a * a / expected).alias("mi3"), ((a - expected) / F.sqrt(a)).alias("t_score"),
        g2.alias("log_likelihood"), (a / f1 - F.try_divide(c, n - f1)).alias("delta_p_21"), (a / f2 - F.try_divide(b, n - f2)).alias("delta_p_12"),
    )


def part_counts(tokens: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """``token, part, v`` and ``part, c, s`` (size and share of each part)."""
    v = tokens.groupBy("token", part).agg(F.count("*").alias("v"))
    sizes = v.groupBy(part).agg(F.sum("v").alias("c"))
    return v, sizes.withColumn("s", F.col("c") / F.sum("c").over(W.partitionBy(F.lit(1))))


def dispersion(tokens: DataFrame, part: str) -> DataFrame:
    """Per word: frequency, range, Juilland D, Carroll D2, DP, DKL and Rosengren S over the parts.

    Only present parts are stored; what the absent ones add follows from sums over all parts
    (their rates are zero, their shares complete to one). The part table is small and checked.
    """
    v, sizes = part_counts(tokens, part)
    total = F.broadcast(sizes.agg(F.count("*").alias("n_parts")))
    x = v.join(small_or_not(sizes), part).withColumn("f", F.sum("v").over(W.partitionBy("token")))
    p, q, s = F.col("v") / F.col("c"), F.col("v") / F.col("f"), F.col("s")
    agg = x.groupBy("token").agg(
        F.max("f").alias("f"), F.count("*").alias("r"), F.sum(p).alias("sp"), F.sum(p * p).alias("sp2"), F.sum(-q * F.log2(q)).alias("h"),
        F.sum(F.abs(q - s)).alias("dev"), F.sum(s).alias("seen"), F.sum(q * F.log2(q / s)).alias("dkl"), F.sum(F.sqrt(s * F.col("v"))).alias("root"),
    ).crossJoin(total)
    n, mean = F.col("n_parts"), F.col("sp") / F.col("n_parts")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("sp2") / n - mean * mean))
    return agg.select(
        "token", F.col("f").alias("frequency"), F.col("r").alias("range"), (100 * F.col("r") / n).alias("range_pct"),
        F.when(n > 1, F.greatest(F.lit(0.0), 1 - sd / mean / F.sqrt(n - 1))).alias("juilland_d"), F.when(n > 1, F.col("h") / F.log2(n)).alias("carroll_d2"),
        ((F.col("dev") + 1 - F.col("seen")) / 2).alias("dp"), F.col("dkl").alias("dkl"), (F.col("root") * F.col("root") / F.col("f")).alias("rosengren_s"),
    )


def corpus_positions(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``place``: the token's place in the corpus, documents in order of their key.

    The running total goes over one row per document in ranges of keys, not over the tokens.
    """
    per = tokens.groupBy(doc).agg(F.count("*").alias("n"))
    offset = running(per, [doc], F.col("n"), "offset").select(doc, "offset")
    return tokens.join(offset, doc).withColumn("place", F.col("offset") + F.col("pos") - 1)


#: Places of one block of the corpus, within which the gaps of a word are looked at together.
GAP_BLOCK = 1 << 20


def reduced_frequency(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Average reduced frequency per word, with cyclic gaps.

    Gaps are taken per word and block of places, and stitched over one row per word and block, so that a common word is
    spread over all blocks; what comes together for a word is one row per distinct gap.
    """
    placed = corpus_positions(tokens, doc).select("token", "place", F.floor(F.col("place") / GAP_BLOCK).alias("block"))
    total = F.broadcast(tokens.agg(F.count("*").alias("N")))
    after = F.lead("place").over(W.partitionBy("token", "block").orderBy("place"))
    inner = placed.select("token", (after - F.col("place")).alias("gap")).filter("gap is not null")
    edges = placed.groupBy("token", "block").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).crossJoin(total)
    word = W.partitionBy("token")
    following = F.coalesce(F.lead("lo").over(word.orderBy("block")), F.min("lo").over(word) + F.col("N"))
    gaps = inner.unionByName(edges.select("token", (following - F.col("hi")).alias("gap"))).groupBy("token", "gap").agg(F.count("*").alias("c"))
    x = gaps.withColumn("f", F.sum("c").over(word)).crossJoin(total)
    v = F.col("N") / F.col("f")
    return x.groupBy("token").agg(F.max("f").alias("frequency"), (F.sum(F.col("c") * F.least(F.col("gap").cast("double"), v)) / F.max(v)).alias("arf"))


def equal_parts(tokens: DataFrame, n_parts: int, doc: str = "doc_id") -> DataFrame:
    """Per word and equal-width part of the corpus: ``token, part (0 .. n_parts - 1), v``."""
    placed = corpus_positions(tokens, doc).crossJoin(F.broadcast(tokens.agg(F.count("*").alias("N"))))
    return placed.select("token", F.least(F.floor(F.col("place") * n_parts / F.col("N")), F.lit(n_parts - 1)).cast("int").alias("part")).groupBy("token", "part").agg(F.count("*").alias("v"))


def range_measures(tokens: DataFrame, n_parts: int, doc: str = "doc_id") -> DataFrame:
    """Observed and expected range over equal parts, their ratio, and the frequency-adjusted range."""
    v = equal_parts(tokens, n_parts, doc)
    size = F.broadcast(tokens.agg((F.count("*") / n_parts).alias("len"), F.count("*").alias("N")))
    x = v.groupBy("token").agg(F.sum("v").alias("f"), F.count("*").alias("r")).crossJoin(size)
    expected = 100 * (1 - F.exp(-F.col("f") * F.col("len") / F.col("N")))
    low, high = F.ceil(F.col("f") / F.col("len")), F.least(F.col("f"), F.lit(n_parts))
    return x.select(
        "token", F.col("f").alias("frequency"), F.col("r").alias("range"), (100 * F.col("r") / n_parts).alias("range_pct"), expected.alias("expected_range_pct"),
        (100 * F.col("r") / n_parts / expected).alias("range_ratio"), F.when(high == low, F.lit(1.0)).otherwise((F.col("r") - low) / (high - low)).alias("fa_range"),
    )


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with mid-ranks: one row ``n1, n0, auc``.

    Ranks come from counts per distinct score, so ties are one row; the running sum is over ranges of those.
    """
    per = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count(F.when(F.col(label), 1)).alias("p"))
    run = running(per, [score], F.col("n"), "below")
    mid = F.col("below") + (F.col("n") + 1) / 2
    a = run.agg(F.sum("p").alias("n1"), F.sum(F.col("n") - F.col("p")).alias("n0"), F.sum(F.col("p") * mid).alias("r"))
    n1, n0 = F.col("n1"), F.col("n0")
    return a.select("n1", "n0", F.try_divide(F.col("r") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def contextual_diversity(tokens: DataFrame, register: str, doc: str = "doc_id") -> DataFrame:
    """Per word: documents with it, registers, and the normalized entropy over registers."""
    per = tokens.groupBy("token", doc, register).agg(F.count("*").alias("c"))
    reg = per.groupBy("token", register).agg(F.sum("c").alias("v"), F.count("*").alias("d"))
    n = F.broadcast(tokens.agg(F.count_distinct(register).alias("n_registers")))
    q = F.col("v") / F.col("f")
    agg = reg.withColumn("f", F.sum("v").over(W.partitionBy("token"))).groupBy("token").agg(
        F.max("f").alias("frequency"), F.sum("d").alias("contexts"), F.count("*").alias("registers"), F.sum(-q * F.log2(q)).alias("h")
    )
    return agg.crossJoin(n).select("token", "frequency", "contexts", "registers", F.when(F.col("n_registers") > 1, F.col("h") / F.log2("n_registers")).alias("register_entropy"))


def _draw_hash(doc: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """``xxhash64(doc, b, seed)`` of rounds b = 1, 2, ..., given Spark's ``xxhash64(doc)``."""
    u = np.uint64
    p1, p2, p3, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

    def with_int(h: np.ndarray, i: np.ndarray) -> np.ndarray:
        h = (h + (p5 + u(4))) ^ (i * p1)
        h = ((h << u(23)) | (h >> u(41))) * p2 + p3
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))

    each = with_int(doc.view(u)[:, None], np.arange(1, rounds + 1, dtype=u)[None])
    return with_int(each, np.full(1, seed & 0xFFFFFFFF, u))


def _draw_weights(doc: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """How often each document is drawn in each round: quantiles of the Poisson distribution of mean one."""
    acc, p, bounds = 0.0, 0.36787944117144233, []
    for k in range(1, 8):
        acc += p
        bounds.append(acc)
        p /= k
    # (h + 0.5) / 2**30 >= bound, for whole numbers h
    least = np.array([next(h for h in range(int(x * 2**30) - 2, 2**30 + 3) if (h + 0.5) / 2**30 >= x) for x in bounds], np.int64)
    h = (_draw_hash(doc, rounds, seed) & np.uint64((1 << 30) - 1)).astype(np.int64)
    return np.searchsorted(least, h, side="right")


#: Words of a block of counts, documents of a block, and cells of sums that a task holds before it hands them on.
_WORDS, _DOCS, _CELLS = 1024, 2048, 4_000_000


def bootstrap(tokens: DataFrame, words: DataFrame, register: str, rounds: int = 300, seed: int = 7, doc: str = "doc_id") -> DataFrame:
    """95 percent document bootstrap intervals of range percent and DKL for chosen words.

    Each document is drawn a Poisson(1) number of times per round, decided by a hash of document
    and round: no document table is copied, results are the same on any cluster. Tasks multiply
    the draws of their documents with the counts of the words in them, as matrices; what is
    shuffled is one row of sums over all rounds per word, register and task.
    """
    reg = next(f.dataType.simpleString() for f in tokens.schema if f.name == register)
    chosen = small_or_not(words.select("token").distinct().withColumn("chosen", F.lit(True)))
    counts = tokens.groupBy(doc, register, "token").agg(F.count("*").alias("v")).join(chosen, "token", "left")
    per = counts.groupBy(doc, register).agg(
        F.sum("v").alias("c"), F.collect_list(F.when(F.col("chosen"), F.struct("token", "v"))).alias("hits")
    ).select(F.xxhash64(doc).alias("h"), F.col(register).alias("reg"), "c", F.col("hits.token").alias("t"), F.col("hits.v").alias("n"))

    def sums(batches):
        held: dict = {}  # register: words (None: all its tokens and documents) and their two sums

        def flush():
            for r, (number, at) in held.items():
                names = list(number)
                for s in range(0, len(names), 512):
                    rows = at[s : s + 512][: len(names) - s]
                    data = [pa.array([x[i].astype(np.int64).tobytes() for x in rows], pa.binary()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 512], pa.string()), pa.array([r] * len(rows), kind), *data], names=["token", "reg", "v", "r"])
            held.clear()

        kind = None
        for whole in batches:
            kind = whole.schema.field(1).type
            for s in range(0, whole.num_rows, _DOCS):
                b = whole.slice(s, _DOCS)
                regs = b.column(1).to_pylist()
                w = _draw_weights(b.column(0).to_numpy(), rounds, seed).astype(np.float64)  # whole numbers, so sums are exact
                c = b.column(2).to_numpy().astype(np.float64)
                size = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(b.num_rows), size)
                code = b.column(3).flatten().dictionary_encode()
                word, n = code.indices.to_numpy(zero_copy_only=False), b.column(4).flatten().to_numpy(zero_copy_only=False)
                names = code.dictionary.to_pylist()
                by: dict = {}
                for i, r in enumerate(regs):
                    by.setdefault(r, []).append(i)
                for r, docs in by.items():
                    number, at = held.setdefault(r, ({}, []))
                    mine = w[docs].T
                    place = np.full(b.num_rows, -1)
                    place[docs] = np.arange(len(docs))
                    here = place[of] >= 0
                    used, col = np.unique(word[here], return_inverse=True)
                    row, times = place[of[here]], n[here]
                    parts = [(None, (mine @ c[docs]), mine.sum(axis=1))]  # the register's tokens and documents
                    for k in range(0, len(used), _WORDS):
                        some = (col >= k) & (col < k + _WORDS)
                        m = np.zeros((len(docs), min(_WORDS, len(used) - k)))
                        m[row[some], col[some] - k] = times[some]
                        v, d = mine @ m, mine @ (m > 0).astype(np.float64)
                        parts += [(names[used[k + j]], v[:, j], d[:, j]) for j in range(m.shape[1])]
                    for name, v, d in parts:
                        if name not in number:
                            number[name] = len(at)
                            at.append(np.zeros((2, rounds)))
                        at[number[name]][0] += v
                        at[number[name]][1] += d
                if sum(len(at) for _, at in held.values()) * 2 * rounds > _CELLS:
                    yield from flush()
        yield from flush()

    def added(table: pa.Table) -> pa.Table:
        v, r = (sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)) for k in ("v", "r"))
        return pa.table({"token": table.column("token").slice(0, 1), "reg": table.column("reg").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary()), "r": pa.array([r.tobytes()], pa.binary())})

    shape = f"token string, reg {reg}, v binary, r binary"
    total = materialize(per.mapInArrow(sums, shape).groupBy("token", "reg").applyInArrow(added, shape), "bootstrap-sums")
    by_reg = total.filter("token is null").select("reg", F.col("v").alias("c_reg"), F.col("r").alias("docs"))

    def all_of(table: pa.Table) -> pa.Table:
        c, d = (sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)) for k in ("c_reg", "docs"))
        return pa.table({"C": pa.array([c.tobytes()], pa.binary()), "D": pa.array([d.tobytes()], pa.binary())})

    everything = by_reg.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(all_of, "C binary, D binary")

    def intervals(table: pa.Table) -> pa.Table:
        v, r, c_reg, c, d = (np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)]).astype(np.float64) for k in ("v", "r", "c_reg", "C", "D"))
        f = v.sum(axis=0)
        some = f > 0
        v, r, c_reg, c, d, f = v[:, some], r[:, some], c_reg[:, some], c[0, some], d[0, some], f[some]
        q = v / f
        with np.errstate(divide="ignore", invalid="ignore"):
            dkl = np.where(v > 0, q * np.log2(q / (c_reg / c)), 0.0).sum(axis=0)
        stat = [100 * r.sum(axis=0) / d, dkl]
        cut = [np.percentile(x, [2.5, 97.5]).tolist() if len(f) else [None, None] for x in stat]
        if not len(f):  # drawn in no round
            return pa.table({k: pa.array([], t) for k, t in (("token", pa.string()), *((x, pa.float64()) for x in names))})
        return pa.table({"token": table.column("token").slice(0, 1)} | {k: [x] for k, x in zip(names, cut[0] + cut[1])})

    names = [f"{c}_{n}" for c in ("range_pct", "dkl") for n in ("low", "high")]
    met = total.filter("token is not null").join(small_or_not(by_reg, 10_000), "reg")
    return met.crossJoin(F.broadcast(everything)).groupBy("token").applyInArrow(intervals, "token string, " + ", ".join(f"{x} double" for x in names))
