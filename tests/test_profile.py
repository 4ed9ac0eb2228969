import pytest

from lexweave.functions import normalizers as N
from lexweave.operators import profile as P


def mapped(spark, ranks, key="a"):
    rows = [(key, i + 1, f"t{i}", f"h{r}" if r else f"o{i}", r, None if r is None else (r - 1) // 1000 + 1) for i, r in enumerate(ranks)]
    return spark.createDataFrame(rows, "k string, pos long, token string, head string, rank int, level int")


def test_p_lex_vectors(spark):
    hard = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    r = P.p_lex(mapped(spark, [x for h in hard for x in [None] * h + [1] * (10 - h)]), ["k"]).first()
    assert r.n_segments == 10 and r["lambda"] == pytest.approx(0.92, abs=0.005) and r.mean_hard == pytest.approx(0.8)
    assert P.p_lex(mapped(spark, [None] * 100), ["k"]).first()["lambda"] <= 10
    assert P.p_lex(mapped(spark, [1] * 100), ["k"]).first()["lambda"] == 0
    short = P.p_lex(mapped(spark, [1] * 9), ["k"]).first()
    assert short.n_segments == 0 and short["lambda"] is None
    hist = [3, 2, 6, 4]
    r = P.p_lex(mapped(spark, [x for k, c in enumerate(hist) for _ in range(c) for x in [None] * k + [1] * (10 - k)]), ["k"]).first()
    assert r["lambda"] == pytest.approx(2.101, abs=0.001) and r.mean_hard == pytest.approx(1.7333, abs=1e-4)


def test_s_index_from_published_coverage(spark):
    cov = {500: 70.32, 1000: 82.58, 1500: 90.97, 2000: 96.13, 2500: 97.42, 3000: 98.71}
    n, ranks, done = 155, [], 0
    for x, c in cov.items():
        k = round(c * n / 100)
        ranks += [x] * (k - done)
        done = k
    r = P.s_index(mapped(spark, ranks + [None] * (n - done)), ["k"]).first()
    assert r.s == 3508 and not r.capped and r.cov_500 == pytest.approx(70.32, abs=0.01)
    assert P.s_index(mapped(spark, [None] * 60), ["k"]).first().capped
    assert P.s_index(mapped(spark, [1] * 49), ["k"]).first().s is None
    assert P.s_index(mapped(spark, [1] * 60), ["k"]).first().s >= 200


def test_profile_vectors(spark):
    m = mapped(spark, [1, 1, 2501, None, None])
    assert P.sophistication(m.filter("pos <> 5"), ["k"]).first().pct_beyond_k == pytest.approx(200 / 3)
    rows = {r.level: r for r in P.lexical_profile(mapped(spark, [1, 1001, None]), ["k"], 2).collect()}
    assert set(rows) == {"K1", "K2", "off-list"}
    assert rows["off-list"].coverage_pct == pytest.approx(100 / 3) and rows["off-list"].cumulative_pct == pytest.approx(200 / 3)
    t = {r.threshold: r.level for r in P.coverage_thresholds(mapped(spark, [1] * 9 + [1001]), ["k"], 8).collect()}
    assert t == {90: 1, 95: 2, 98: 2}
    none = P.sophistication(mapped(spark, [None]), ["k"]).first()
    assert none.mean_rank is None and none.pct_off_list == 100
    band = {r.level: r for r in P.band_wise(mapped(spark, [1, 2, 1]), ["k"], 2).collect()}
    assert band[1].mattr == pytest.approx(2 / 3) and band[1].hdd == pytest.approx(2 / 3) and band[1].min_n == 50


def test_map_tokens(spark):
    ranks = spark.createDataFrame([("able", "able", 1), ("ability", "able", 1), ("run", "run", 1200)], "form string, head string, rank int")
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ability", "running", "zzz", "odd"])], "doc_id long, pos long, token string")
    norm = lambda v: N.static_map(v, spark.createDataFrame([("running", "walk", 1), ("running", "run", 2), ("odd", "queer", 1)], "form string, head string, o int"), "o")
    got = {r.token: (r.head, r["rank"], r.level) for r in P.map_tokens(toks, ranks, norm).collect()}
    assert got == {"ability": ("able", 1, 1), "running": ("run", 1200, 2), "zzz": ("zzz", None, None), "odd": ("queer", None, None)}


def flemma(spark, tokens, heads, entries=None):
    v = spark.createDataFrame([(t,) for t in tokens], "token string")
    e = spark.createDataFrame(entries, "form string, heads array<string>") if entries else None
    return {r.token: r["head"] for r in N.flemma(v, e, spark.createDataFrame([(h,) for h in heads], "head string")).collect()}


def test_flemma_vectors(spark):
    heads = "study stop make box nice big teacher".split()
    want = {"studies": "study", "stopped": "stop", "making": "make", "boxes": "box", "nicer": "nice", "biggest": "big", "teacher": "teacher", "unlicenseds": "unlicenseds", "leaves": "leaves", "axes": "axes", "won": "win", "children": "child"}
    assert flemma(spark, want, heads) == want
    assert flemma(spark, ["teacher's", "teachers'", "it's", "Don’t"], ["teacher", "it"]) == {"teacher's": "teacher", "teachers'": "teacher", "it's": "it's", "Don’t": "don't"}
    assert flemma(spark, ["ran", "cats", "dogs"], ["cat"], [("dogs", ["hound"]), ("cats", ["cat", "feline"]), (None, ["x"]), ("y", None)]) == {"ran": "run", "cats": "cats", "dogs": "hound"}
    assert flemma(spark, ["teach", "teaches"], ["teacher"]) == {"teach": "teach", "teaches": "teaches"}


def test_normalizer_names(spark):
    v = spark.createDataFrame([("Word",)], "token string")
    assert N.normalizer("surface-form")(v).first()["head"] == "word"
    with pytest.raises(ValueError):
        N.normalizer("none such")


def test_band_wise_mtld_is_all_that_is_worked_out(spark):
    """Same rows as in ``band_wise``, from one list a band and without a join of the parts."""
    ranks = [1, 1500, None, 2, 1, 7, 1500, 1501] * 9
    m = mapped(spark, ranks)
    frame = P.band_wise_mtld(m, ["k"], 2)
    key = lambda d: sorted((r.k, r.level, r.mtld) for r in d.collect())
    assert key(frame) == key(P.band_wise(m, ["k"], 2)) and frame.count() == 3
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Join" not in plan
