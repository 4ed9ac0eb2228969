import random

import numpy as np
import pytest

from lexweave.llm import spans as S


def texts(seed=3, n=24):
    r = random.Random(seed)
    make = lambda k: "".join(r.choices("abcdefgh é😀", k=k))
    a, b = make(700), make(450)
    out = [make(r.randint(0, 900)) for _ in range(n)]
    out += [make(100) + a[:400] + make(50), a, a, a[300:] + make(10), b[:399] + make(30), b, b[25:430] + b, "", None, make(30_000) + a[100:520], "x" * 3000, "x" * 2000, make(399)]
    return out


def brute(rows, n):
    seen = {}
    for d, t in rows:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    return {(a, b) for v in seen.values() for a in v for b in v if a < b}


@pytest.mark.parametrize("batches,hot", [(1, 64), (6, 64), (2, 1), (5, 1)])
def test_pairs_are_exact(spark, monkeypatch, batches, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "FANOUT", 2)
    rows = list(enumerate(texts()))
    rows.append(rows[-3])  # a repeated row
    when = lambda i: None if i % 7 == 0 else f"2025-01-{1 + i % 28:02d} 00:00:00"
    df = spark.createDataFrame([(i, t, when(i), "z") for i, t in rows], "doc_id long, text string, at string, sha string").selectExpr("doc_id", "text", "cast(at as timestamp) ingested_at", "sha")
    pairs = S.index_batches(df, batches).cache()
    got = [tuple(r) for r in S.document_pairs(pairs, S.class_members(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, S.MIN_LEN)
    for r in S.stretches(pairs).collect():
        a, b = rows[r.rep_a][1], rows[r.rep_b][1]
        assert a[r.start_a : r.start_a + r.len] == b[r.start_b : r.start_b + r.len] and r.len >= S.MIN_LEN
    cov = {r.doc_id: r for r in S.coverage(pairs, df).collect()}
    assert cov[25].shared_chars == 700 and cov[25].n_copies == 2 and cov[24].shared_chars == 400 and cov[0].shared_chars == 0


def test_log_levels_and_plans(spark, monkeypatch):
    """Ten batches in levels of three: runs 3 + 3 + 3 make one of the third level; joins with older runs shuffle nothing."""
    monkeypatch.setattr(S, "FANOUT", 3)
    log = S.FingerprintLog(spark, buckets=4)
    seen = set()
    for i in range(10):
        rows = [(fp, bytes([i, j])) for fp in range(3 * i, 3 * i + 5) for j in range(2)]
        found = log.add(spark.createDataFrame(rows, "fp long, sha binary"))
        if i in (2, 9):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        seen |= {(bytes(r.sha_a), bytes(r.sha_b)) for r in found.distinct().collect()}
        assert [len(level) for level in log.levels] == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2], [0, 0, 1], [1, 0, 1]][i]
    classes = [(i, j) for i in range(10) for j in range(2)]
    near = lambda a, b: abs(a - b) <= 1
    assert seen == {(bytes(a), bytes(b)) for a in classes for b in classes if a < b and near(a[0], b[0])}


def brute_stretches(a, b, n):
    out = []
    for i in range(len(a) - n + 1):
        for j in range(len(b) - n + 1):
            if a[i : i + n] == b[j : j + n] and (not i or not j or a[i - 1] != b[j - 1]):
                k = n
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                out.append((i, j, k))
    return out


def test_all_occurrences():
    r = random.Random(5)
    p = "".join(r.choices("abcd", k=30))
    some = [p + "1" + p, p, p[:20] + "x" + p + "y" + p[5:], "z" * 40, "z" * 25 + p + p, p * 3, p[:25] + p + p[3:], ""]
    some += ["".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(30)]
    for n in (4, 12):
        for a in some:
            for b in some:
                assert sorted(S.shared_spans(a, b, n)) == brute_stretches(a, b, n)


def test_coverage_of_repeated_stretches(spark):
    r = random.Random(8)
    make = lambda k: "".join(r.choices("abcdefgh é😀", k=k))
    p, q = make(450), make(600)
    texts = [make(30) + p + make(20), p + make(50) + p + make(9) + p, q[:420] + make(5) + q, q + make(3) + q + make(3) + q[100:], make(500), make(3) + "v" * 450, "v" * 900 + make(4)]
    for rows in (list(enumerate(texts)), list(enumerate(t[::-1] for t in texts))):
        df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, ingested_at timestamp")
        pairs = S.index_batches(df, 1).cache()
        want = {}
        for d, t in rows:
            grams = {o[i : i + 400] for e, o in rows if e != d for i in range(len(o) - 399)}
            want[d] = len({k for i in range(len(t) - 399) if t[i : i + 400] in grams for k in range(i, i + 400)})
        assert {c.doc_id: c.shared_chars for c in S.coverage(pairs, df).collect()} == want
        listed = {(x.rep_a, x.rep_b, x.start_a, x.start_b, x.len) for x in S.stretches(pairs).collect()}
        ends = {tuple(x) for x in pairs.select("rep_a", "rep_b").collect()}
        assert listed == {(a, b, *s) for a, b in ends for s in brute_stretches(rows[a][1], rows[b][1], 400)} and len(ends) == 3


def test_window_guarantee():
    r = np.random.default_rng(0)
    base = r.integers(97, 123, 400).astype(np.uint32)
    a = np.concatenate([r.integers(97, 123, 200), base, r.integers(97, 123, 90)]).astype(np.uint32)
    b = np.concatenate([r.integers(97, 123, 11), base]).astype(np.uint32)
    assert set(S.chosen(a)[0]) & set(S.chosen(b)[0])
    assert len(S.chosen(base[:399])[0]) == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ingested_at timestamp")
    assert S.document_pairs(S.index_batches(df), S.class_members(df)).count() == 0
    assert S.coverage(S.index_batches(df), df).count() == 0
