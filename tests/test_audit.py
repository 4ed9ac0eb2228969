import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from lexweave.operators import audit as A
from lexweave.operators import guard as U


def test_near_duplicates(spark):
    r = random.Random(1)
    vocab = [a + b for a in "bcdfgh" for b in "aeiou"]
    base = [" ".join(r.choices(vocab, k=150)) for _ in range(15)]
    rows = [(i, base[i % 15]) for i in range(30)]
    for i in range(30, 70):
        w = base[i % 15].split()
        for _ in range(r.choice([1, 1, 2, 4])):
            w[r.randrange(150)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, " "), (102, "a b c"), (103, base[0].upper() + "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cls = {x.doc_id: x for x in A.exact_classes(df).collect()}
    assert cls[15].class_id == 0 and cls[103].class_id == 0 and cls[0].n_copies == 3 and 100 not in cls and 101 not in cls
    reps = {c.class_id for c in cls.values()}
    sets = {}
    for i, t in rows:
        if i in reps:
            w = t.lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    got = {(x.doc_a, x.doc_b) for x in A.near_duplicates(df).collect()}
    assert got == want and len(want) > 5
    assert A.near_duplicates(df.limit(0)).count() == 0


def test_duplicates_in_composed_form(spark):
    word = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    text = " ".join(word[:20] + ["caf\u00e9"] + word[20:])
    rows = [(0, text), (1, text.replace("\u00e9", "e\u0301")), (2, text.replace(" ", "\u00a0", 3).replace(" ", "\u2003\r\n", 1) + "\u3000"), (3, "\u00a0\u2028"), (4, text.replace("\u00e9", "e\u0301") + " end"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_copies) for r in A.exact_classes(df).collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (4, 4, 1)}
    # one shingle more at the end; the accent changes none
    assert [(r.doc_a, r.doc_b, r.shared + 1) for r in A.near_duplicates(df).collect()] == [(0, 4, r.united) for r in A.near_duplicates(df).collect()]
    assert A.near_duplicates(df).count() == 1


def test_every_essay_has_a_class(spark, tmp_path):
    from lexweave.plans import catalog

    text = " ".join(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(0, text), (1, text.upper()), (2, text + " caf\u00e9"), (3, text + "\u00a0cafe\u0301"), (4, " "), (5, None)]
    spark.createDataFrame(rows, "essay_row long, full_text string").write.parquet(str(tmp_path / "essays.parquet"))
    q = catalog.queries()
    for form, want in (("", {0: 0, 1: 0, 2: 2, 3: 3}), ("_nfc", {0: 0, 1: 0, 2: 2, 3: 2})):
        got = {r.doc_id: (r.class_id, r.n_copies) for r in q[f"exact_duplicate_essays{form}"](spark, str(tmp_path)).collect()}
        assert got == {d: (c, list(want.values()).count(c)) for d, c in want.items()}
        ends = {x for r in q[f"near_duplicate_essays{form}"](spark, str(tmp_path)).collect() for x in (r.doc_a, r.doc_b)}
        assert 0 in ends and ends <= set(want.values())


def test_guard_rules(spark):
    c, sec = U.GuardConfig(), U.SECOND
    s, said, _ = U.request(None, 0, 200, True, c)
    assert said == "allowed" and U.shown(s, c)["credits"] == 0
    assert U.request(s, 30 * sec, 1, True, c)[1:] == ("budget", 570)
    assert U.request(s, 30 * sec + 1, 1, True, c)[1:] == ("budget", 570) and U.request(s, 31 * sec, 1, True, c)[1:] == ("budget", 569)
    assert U.request(s, 600 * sec - 1, 1, True, c)[1:] == ("budget", 1)
    assert U.request(s, 600 * sec, 1, True, c)[1] == "allowed"
    s = None
    for t in range(3):
        s, said, _ = U.request(s, t * sec, 1, False, c, too_short=2)
    assert s.rest_until == 122 * sec and s.too_short == 6 and U.request(s, 3 * sec, 1, True, c)[1:] == ("cooldown", 119)
    assert U.request(s, 122 * sec, 1, True, c)[1] == "allowed"
    assert U.request(None, 0, 0, True, c)[1] == "invalid" and U.request(None, 0, None, True, c)[1] == "invalid" and U.request(None, 0, 201, True, c)[1] == "over_capacity"
    back, _, _ = U.request(U.Schedule(50 * sec, 50 * sec + 190 * 30 * sec), 10 * sec, 1, True, c)
    assert U.shown(back, c)["credits"] == 10.0 and back.clock == 50 * sec
    for bad in ({"capacity": 0}, {"least_cost": 300}, {"cooldown": 0.0}, {"seconds_per_credit": float("nan")}):
        with pytest.raises(ValueError):
            U.decisions(None, U.GuardConfig(**bad))


def test_guard_frame(spark):
    at = datetime(2025, 1, 1)
    rows = [(i, "hot" if i % 3 else None, at + timedelta(seconds=i), 1, None if i % 5 == 0 else True) for i in range(60)] + [(900, "hot", at + timedelta(seconds=1), 1, True)]
    df = spark.createDataFrame(rows, "request_id long, session_key string, ts timestamp, documents int, success boolean")
    assert U.once(df).count() == 60
    got = U.decisions(U.once(df)).collect()
    assert len(got) == 60 and sum(r.decision == "no_session" for r in got) == 20 and sum(r.decision == "allowed" for r in got) == 10
    assert U.decisions(df.limit(0)).count() == 0


def test_upload_budget(spark):
    df = spark.createDataFrame([("r", i, b) for i, b in enumerate([50, 40, 200, 30, 10, 5])] + [("s", 0, None)], "req string, i int, b long")
    got = {(r.request, r.file): r.status for r in A.upload_budget(df, "req", "i", "b", 100, 110, 3).collect()}
    assert [got["r", i] for i in range(6)] == ["taken", "taken", "too_large", "over_total", "taken", "over_number"] and got["s", 0] == "taken"


def test_leave_group_out(spark):
    g = np.random.default_rng(0)
    rows = []
    for k in range(300):
        n, m, z = int(g.integers(50, 500)), float(g.normal(70, 10)), float(g.normal())
        rows.append((f"p{k % 6}", float(1 + 0.4 * np.log(n) + 0.02 * m + 0.8 * z + g.normal(0, 0.1)), n, m, z))
    rows.append(("p0", None, 1, 1.0, 1.0))
    df = spark.createDataFrame(rows, "g string, y double, n int, m double, z double")
    err, ci = A.leave_group_out(df, "g", "y", "n", ["m"], ["z"], rounds=500)
    assert err.count() == 6 and ci["low"] > 0.3 and ci["delta_macro_mae"] > 0.4
    d = [r for r in rows if r[1] is not None]
    hold = [r for r in d if r[0] == "p2"]
    x = np.array([[np.log(r[2]), r[3], r[4]] for r in d if r[0] != "p2"])
    y = np.array([r[1] for r in d if r[0] != "p2"])
    cum = np.sort(np.round(x[:, 0], 3))
    knots = np.array([cum[0], *(cum[int(np.searchsorted(np.arange(1, len(cum) + 1) / len(cum), q))] for q in (1 / 3, 2 / 3)), cum[-1]])
    make = lambda v: np.concatenate([np.ones((len(v), 1)), A._spline(v[:, 0], knots), (v[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)], axis=1)
    w = np.linalg.lstsq(make(x), y, rcond=None)[0]
    e = np.array([r[1] for r in hold]) - make(np.array([[np.log(r[2]), r[3], r[4]] for r in hold])) @ w
    assert {r.g: r.mae_1 for r in err.collect()}["p2"] == pytest.approx(np.abs(e).mean(), rel=1e-6)


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    got = {r.test: (round(r.holm, 6), round(r.benjamini_hochberg, 6)) for r in A.holm(df).collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}
