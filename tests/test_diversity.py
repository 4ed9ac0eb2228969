import math
import random

import numpy as np
import pytest

from lexweave.operators import diversity as D


def frame(spark, **texts):
    rows = [(k, i + 1, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "k string, pos long, token string")


def one(df, name):
    return {r.k: r[name] for r in df.collect()}


def mtld_pass(ts):
    factors, seen, n = 0.0, set(), 0
    for t in ts:
        n += 1
        seen.add(t)
        if len(seen) / n <= 0.72 and n >= 10:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - 0.72)
    return len(ts) / factors if factors else None


def test_short_text(spark):
    t = frame(spark, a="alpha beta alpha gamma delta".split())
    for f, n in ((D.msttr, "msttr"), (D.mattr, "mattr"), (D.hdd, "hdd")):
        assert one(f(t, ["k"]), n)["a"] == pytest.approx(0.8)


def test_factor_closes_at_equality(spark):
    ts = [f"w{i}" for i in range(18)] + [f"w{i}" for i in range(7)] + [f"z{i}" for i in range(25)]
    assert one(D.mtld(frame(spark, a=ts), ["k"]), "mtld_forward")["a"] == pytest.approx(50)


def test_against_plain_python(spark):
    r = random.Random(0)
    texts = {f"t{i}": [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.randint(1, 26)]) for _ in range(n)] for i, n in enumerate([1, 2, 9, 10, 49, 50, 51, 120, 333])}
    t = frame(spark, **texts)
    mattr, msttr, hdd, mtld = one(D.mattr(t, ["k"]), "mattr"), one(D.msttr(t, ["k"]), "msttr"), one(D.hdd(t, ["k"]), "hdd"), one(D.mtld(t, ["k"]), "mtld")
    base = {x.k: x for x in D.basic(t, ["k"]).collect()}
    for k, ts in texts.items():
        n, w = len(ts), min(50, len(ts))
        assert mattr[k] == pytest.approx(sum(len(set(ts[i : i + w])) / w for i in range(n - w + 1)) / (n - w + 1))
        segs = [ts[i : i + w] for i in range(0, n - w + 1, w)]
        assert msttr[k] == pytest.approx(sum(len(set(s)) / w for s in segs) / len(segs))
        s = min(42, n)
        assert hdd[k] == pytest.approx(min(1, sum((1 - math.comb(n - ts.count(x), s) / math.comb(n, s)) / s for x in set(ts))))
        both = [v for v in (mtld_pass(ts), mtld_pass(ts[::-1])) if v is not None]
        assert mtld[k] == (pytest.approx(sum(both) / len(both)) if both else None)
        assert base[k].ttr == pytest.approx(len(set(ts)) / n) and (base[k].herdan is None) == (n == 1)


def test_yule_and_vocd(spark):
    # 86 types with a sum of squares of 260
    ts = [f"a{i}" for i in range(72)] + [w for i, k in enumerate([2] * 7 + [3] * 1 + [5] * 5 + [5]) for w in [f"b{i}"] * k]
    m2 = sum(ts.count(x) ** 2 for x in set(ts))
    assert one(D.basic(frame(spark, a=ts), ["k"]), "yule_i")["a"] == pytest.approx(len(set(ts)) ** 2 / (m2 - len(set(ts))))
    assert 86 * 86 / (260 - 86) == pytest.approx(42.51, abs=0.01)
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 90}" for _ in range(300)]
    d = D.vocd_of(words)
    assert d == D.vocd_of(list(words)) and d is not None
    expected = one(D.vocd_expected(frame(spark, a=words), ["k"]), "vocd_expected")["a"]
    assert expected == pytest.approx(d, rel=0.05)
    assert D.vocd_of([]) is None and D.vocd_of([f"u{i}" for i in range(80)]) is None
    arr = spark.createDataFrame([("a", words), ("b", [])], "k string, tokens array<string>")
    assert one(D.vocd(arr, ["k"]), "vocd") == {"a": pytest.approx(d), "b": None}


def test_floors_and_long_form(spark):
    assert D.required_tokens("mattr", window=80) == 80 and D.required_tokens("msttr", segment=90) == 90 and D.required_tokens("hdd", hdd_sample=60) == 60
    assert D.required_tokens("mtld", override=75) == 75 and D.required_tokens("ttr", override=75) == 1
    t = frame(spark, a=["x", "y", "x"])
    wide = D.panel_a(t, ["k"])
    assert wide.count() == 1 and {r.index_key for r in D.long_form(wide, ["k"]).collect()} == set(D.INDICES) - {"vocd"}
    assert D.panel_a(t.limit(0), ["k"]).count() == 0


def test_vocd_of_texts_of_one_length_shares_its_samples(spark, monkeypatch):
    """All texts of a length are measured on samples drawn once, with the values of the plain definition."""
    r = random.Random(8)
    texts = {f"t{i}": [f"w{int(r.paretovariate(0.7)) % 90}" for _ in range(n)] for i, n in enumerate([1, 20, 34, 35, 36, 49, 50, 51, 64, 276, 277, 278, 512, 900, 900, 900, 2100])}
    arr = spark.createDataFrame(list(texts.items()), "k string, tokens array<string>")
    assert one(D.vocd(arr, ["k"]), "vocd") == {k: D.vocd_of(ts) for k, ts in texts.items()}
    calls = []
    plain = D.Draws._drawn
    monkeypatch.setattr(D.Draws, "_drawn", lambda *a: calls.append(1) or plain(*a))
    draws = D.Draws()
    for k in ("t13", "t14", "t15"):
        draws.vocd(np.array([int(w[1:]) for w in texts[k]]))
    assert len(calls) == 3  # one a run
