import math

import pytest

from lexweave.operators import exposure as X
from lexweave.operators import network as G


def graph(spark):
    nodes = spark.createDataFrame([("n0", "n"), ("n1", "n"), ("n2", "n"), ("v0", "v"), ("a0", "a")], "synset string, pos string")
    edges = spark.createDataFrame([("n1", "n0"), ("n2", "n1"), ("n2", "n0"), ("n2", "gone")], "child string, parent string")
    links = spark.createDataFrame([("bank", "n", "n1"), ("bank", "n", "n2"), ("bank", "v", "v0"), ("blue", "a", "a0"), ("bank", "n", "n1")], "lemma string, pos string, synset string")
    return nodes, edges, links


def test_metrics_and_summary(spark):
    m = G.lemma_metrics(*graph(spark)).cache()
    got = {(r.lemma, r.pos): r for r in m.collect()}
    bank = got["bank", "n"]
    assert (bank.polysemy, bank.depth_min, bank.depth_mean, bank.depth_max) == (2, 1, 1.5, 2) and got["blue", "a"].depth_mean is None
    any_ = {r.lemma: r for r in G.any_pos(m).collect()}
    assert any_["bank"].polysemy == 3 and any_["bank"].depth_mean == 1
    t = spark.createDataFrame([(1, w) for w in ("bank", "bank", "unknown")], "d int, token string")
    s = G.document_summary(t, G.of_pos(m, "n"), ["d"]).first()
    assert s.token_coverage == pytest.approx(2 / 3) and s.depth_token_mean == 1.5
    t = spark.createDataFrame([(1, w) for w in ("bank", "blue", "unknown")], "d int, token string")
    assert G.document_summary(t, G.any_pos(m), ["d"]).first().depth_token_coverage == pytest.approx(1 / 3)
    assert G.missing_synsets(*graph(spark)[::2]).count() == 0


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([("r", "n"), ("a", "n"), ("b", "n")], "synset string, pos string")
    for edges in ([("a", "b"), ("b", "a")], [("a", "r"), ("a", "b"), ("b", "a")]):
        with pytest.raises(ValueError):
            G.depths(nodes, spark.createDataFrame(edges, "child string, parent string"), most=20)


def test_exposure_measures(spark):
    table = spark.createDataFrame([("alpha", 3, 2, 1), ("zeta", 2, 1, 1)], "word string, count long, videos long, channels long")
    totals = spark.createDataFrame([(5, 3, 2, 4)], "n_tokens long, n_videos long, n_channels long, vocabulary long")
    toks = spark.createDataFrame([(1, w) for w in ("alpha", "alpha", "zeta", "unknown")], "d int, token string")
    s = X.document_summary(toks, table, totals, ["d"]).first()
    z = lambda c: math.log10(1e9 * (c + 1) / 9)
    assert s.token_coverage == 0.75 and s.zipf_token_mean == pytest.approx((2 * z(3) + z(2) + z(0)) / 4) and s.zipf_type_mean == pytest.approx((z(3) + z(2) + z(0)) / 3)
    assert X.document_summary(toks.limit(0), table, totals, ["d"]).count() == 0
