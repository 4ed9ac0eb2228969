import math

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import corpus as C


def test_ngrams_stop_at_document_ends(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha can't"), (2, "beta gamma alpha"), (3, "42"), (4, None)], "doc_id long, text string")
    t = T.tokens(df)
    uni = {r.token: (r.frequency, r.document_frequency) for r in C.unigrams(t).collect()}
    assert uni == {"alpha": (3, 2), "beta": (2, 2), "can't": (1, 1), "gamma": (1, 1)}
    bi = {(r.w1, r.w2): r.frequency for r in C.ngrams(t, 2).collect()}
    assert bi[("alpha", "beta")] == 1 and ("can't", "beta") not in bi
    assert C.ngrams(t, 3).count() == 3
    s = C.corpus_stats(df, F.size(T.surfaces("text"))).first()
    assert (s.documents, s.empty_documents, s.tokens) == (4, 2, 7)


def test_juilland_depends_on_parts(spark):
    n, hits = 20_000, 200
    rows = [(i // 100, i % 100 + 1, "hit" if i < n // 10 and i % 10 == 0 else "o") for i in range(n)]
    t = spark.createDataFrame(rows, "doc_id long, pos long, token string")
    for parts, want in ((10, 0.0), (200, 1 - 3 / math.sqrt(199))):
        p = C.corpus_positions(t).withColumn("part", F.floor(F.col("place") * parts / n))
        r = {x.token: x for x in C.dispersion(p, "part").collect()}["hit"]
        assert r.frequency == hits and r.juilland_d == pytest.approx(want, abs=1e-9)


def test_auc_and_arf(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True), (None, True)], "s double, y boolean")
    assert C.auc(df, "s", "y").first().auc == pytest.approx(3.5 / 4)
    t = spark.createDataFrame([(0, i + 1, "x" if i in (0, 5) else "o") for i in range(10)], "doc_id long, pos long, token string")
    assert {r.token: r.arf for r in C.reduced_frequency(t).collect()}["x"] == pytest.approx(2)


def test_bootstrap_is_repeatable(spark):
    t = spark.createDataFrame([(d, i, "a" if (d + i) % 3 else "b", "r" if d % 2 else "s") for d in range(30) for i in range(1, 9)], "doc_id long, pos long, token string, reg string")
    w = spark.createDataFrame([("a",)], "token string")
    a, b = (C.bootstrap(t.repartition(k), w, "reg", rounds=40).first() for k in (1, 5))
    assert a == b and a.range_pct_low <= 100 <= a.range_pct_high + 1e-9 and 0 <= a.dkl_low <= a.dkl_high


def test_bootstrap_of_the_whole_list(spark, tmp_path):
    from lexweave.plans import catalog

    docs = [(i, "the cat sat on " + ("a mat" if i % 2 else "it"), "s", "g" if i % 3 else None) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, genre_id string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("the", 1), ("cat", 2), ("mat", 9), ("dog", 1)], "form string, band int").write.parquet(str(tmp_path / "rank_list.parquet"))
    assert {r.token for r in catalog.queries()["bootstrap_ci"](spark, str(tmp_path)).collect()} == {"the", "cat", "mat"}


def test_bootstrap_against_plain_python(spark):
    """Intervals of the plain definition, without a row per word, document and round."""
    import math
    import random

    import numpy as np
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(d, i, r.choice("aabbbcdxyz"), f"r{d % 3}") for d in range(40) for i in range(r.randint(1, 12))] + [(99, 1, "e", "r0")]
    t = spark.createDataFrame(rows, "doc_id long, pos int, token string, reg string")
    w = spark.createDataFrame([(x,) for x in "abcdea"] + [("none",)], "token string")
    frame = C.bootstrap(t, w, "reg", rounds=60)
    assert "explode" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {x.token: x[1:] for x in frame.collect()}
    hashes = spark.range(100).select("id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("b")).select("id", "b", F.pmod(F.xxhash64("id", "b", F.lit(7)), F.lit(1 << 30)).alias("h")).collect()
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
    drawn = {(x.id, x.b): int(((x.h + 0.5) / 2**30 >= cdf).sum()) for x in hashes}
    docs, reg = {d for d, *_ in rows}, {d: g for d, _, _, g in rows}
    for word in "abcde":
        share, dkl = [], []
        for b in range(1, 61):
            size, v = ({g: sum(drawn[d, b] for d, _, x, h in rows if h == g and (y is None or x == y)) for g in ("r0", "r1", "r2")} for y in (None, word))
            if sum(v.values()):
                share.append(100 * sum(drawn[d, b] for d in {d for d, _, x, _ in rows if x == word}) / sum(drawn[d, b] for d in docs))
                dkl.append(sum(v[g] / sum(v.values()) * math.log2(v[g] / sum(v.values()) * sum(size.values()) / size[g]) for g in v if v[g]))
        assert got[word] == pytest.approx([*np.percentile(share, [2.5, 97.5]), *np.percentile(dkl, [2.5, 97.5])])
    assert set(got) == set("abcde") and len(reg) == 41
    assert C.bootstrap(t.limit(0), w, "reg").count() == 0
