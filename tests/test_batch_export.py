import json
import math

import pytest

from lexweave.config import AnalysisConfig
from lexweave.operators import batch as B
from lexweave.operators import export as E
from lexweave.pipeline import analyze


def test_off_list_causes(spark):
    rows = [(1, i, s, s.lower(), None, None) for i, s in enumerate(["NASA", "Tokyo", "walking", "Don't", "ox", "quark", "quark"])]
    m = spark.createDataFrame(rows, "doc_id long, pos int, surface string, head string, rank int, level int")
    got = {r["head"]: (r["count"], r.cause) for r in B.off_list(m, ["doc_id"]).collect()}
    assert [got[h][1] for h in ("nasa", "don't", "tokyo", "walking", "ox", "quark")] == list(B.CAUSES) and got["quark"][0] == 2
    assert B.off_list_top(B.off_list(m, ["doc_id"]), 1).first()["head"] == "quark"


def test_overlap(spark, monkeypatch):
    t = spark.createDataFrame([("a", w) for w in ("alpha", "beta", "xray", "beta")] + [("b", w) for w in ("alpha", "gamma")] + [("c", "zz")], "g string, token string")
    rows = {(r.document_a, r.document_b): r for r in B.overlap(t, "g", zeros=True).collect()}
    assert len(rows) == 9 and rows["b", "a"].jaccard == 0.25 and rows["a", "b"].union_types == 4 and rows["a", "a"].jaccard == 1 and rows["c", "a"].shared_types == 0
    assert B.overlap(t, "g", ordered_pairs=False, zeros=True).count() == 3
    monkeypatch.setattr(B, "MAX_GROUPS", 2)
    with pytest.raises(ValueError):
        B.overlap(t, "g", zeros=True)
    sparse = {(r.document_a, r.document_b): r for r in B.overlap(t, "g").collect()}  # beyond the bound: all pairs but those without a common word
    assert sparse == {k: r for k, r in rows.items() if r.shared_types} and len(sparse) == 5


def test_ordinals_of_any_keys(spark):
    names = [f"n{(i * 7919) % 1000:04d}" for i in range(300)]
    got = {r.n: r.document for r in B.ordinal_labels(spark.createDataFrame([(n, n) for n in names], "n string, k string"), "k").collect()}
    assert got == {n: f"Document {i + 1:03d}" for i, n in enumerate(sorted(names))}


def test_scores_and_flags(spark):
    w = spark.createDataFrame([(1, 40, 0.9, 300.0, 0.1, 500.0, 20.0)], "d int, n_tokens int, mattr double, mtld double, maas double, yule_k double, pct_off_list double")
    s = {r.dimension: r.score for r in B.profile_scores(w, ["d"], 5000).collect()}
    assert s["MATTR"] == 90 and s["MTLD"] == 100 and s["Low repetition"] == 50 and s["In-list coverage"] == 80 and s["vocd-D"] is None
    assert B.flags(w, ["d"]).first().flags == ["panel_a_below_recommended_minimum", "panel_b_off_list_over_10pct"]


def test_descriptives(spark):
    d = E.descriptives(spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, float("nan"))], "a double, b double"), ["a", "b"])
    got = {r.measure: r for r in d.collect()}
    assert got["a"].q1 == 1.5 and got["a"].sd == pytest.approx(math.sqrt(7 / 3)) and got["b"].sd is None and got["b"].missing == 2


def test_payload_and_privacy(spark):
    df = spark.createDataFrame([(1, float("nan"), "é")], "doc_id int, x double, note string")
    r = E.payload(df, ["doc_id"]).first()
    assert json.loads(r.json) == {"doc_id": 1, "x": None, "note": "é"} and E.pretty(r.json).endswith("\n}\n") and "é" in E.pretty(r.json)
    for bad in ("raw_tokens array<string>", "s struct<text: string>", "_x int", "a array<struct<raw_surfaces: int>>"):
        with pytest.raises(ValueError):
            E.assert_private(spark.createDataFrame([], bad))
    a, b = E.fingerprint(df.union(df)).first(), E.fingerprint(df.union(df).repartition(3)).first()
    assert a == b and a.fingerprint != E.fingerprint(df).first().fingerprint


def test_sheet_is_never_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "SHEET_ROWS", 2, raising=False)
    with pytest.raises(ValueError, match="does not fit"):
        E.sheets({"few": spark.range(2), "many": spark.range(3)}, str(tmp_path / "x.xlsx"))
    assert not (tmp_path / "x.xlsx").exists() and E.sheets({"many": spark.range(3)})["many"].count() == 3


def test_artifact(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, w string")
    E.write_artifact(df, str(tmp_path / "x"), ["i"], single_file=True)
    assert [r.w for r in spark.read.option("header", True).csv(str(tmp_path / "x")).collect()] == ["a", "b"]


def test_config():
    assert AnalysisConfig().cutoff == 2
    for bad in ({"window": 0}, {"mtld_threshold": 1.0}, {"thresholds": (95, 90)}, {"thresholds": ()}, {"segment": True}, {"cutoff": -1}, {"other": 1}, {"normalizer": "x"}, {"thresholds": (0, 90)}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 30), (2, "one two three"), (3, None), (4, "")], "doc_id long, text string")
    ranks = spark.createDataFrame([("the", "the", 1), ("cat", "cat", 900), ("mat", "mat", 2500)], "form string, head string, rank int")
    out = analyze(docs, AnalysisConfig(n_levels=3), ranks)
    assert {r.doc_id for r in out["summary"].collect()} == {1, 2} and {r.doc_id: r.error for r in out["skipped"].collect()} == {3: "No tokens found.", 4: "No tokens found."}
    assert out["lfp"].count() == 8 and out["thresholds"].count() == 6 and out["p_lex_s"].count() == 8
    for df in out.values():
        E.assert_private(df)
        df.limit(1).collect()
    few = analyze(docs, skip_below=(100, 2))
    assert {r.doc_id for r in few["summary"].collect()} == {1} and few["skipped"].count() == 3
