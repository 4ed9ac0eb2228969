import itertools

import numpy as np
import pytest

from lexweave.llm import pii as M
from lexweave.llm.pii_table import labelled


@pytest.fixture(scope="module")
def model(spark):
    return M.model(spark)


def agreement(model, rows):
    got = {(d, s, k) for d, s, _, k in M.Decoder(model).mentions([t for t, _ in rows])}
    want = {(i, s, k) for i, (_, marks) in enumerate(rows) for s, _, k in marks}
    return len(got & want) / len(got), len(got & want) / len(want)


def test_unseen_names_and_frames():
    """Trained on one half of the lists, tried on the other: no name, street, host, syllable or frame in common."""
    precision, recall = agreement(M.train(labelled(3000, part=0)), labelled(800, seed=7, part=1))
    assert precision > 0.8 and recall > 0.75


def test_fresh_rows(model):
    precision, recall = agreement(model, labelled(600, seed=77))
    assert precision > 0.9 and recall > 0.9


def test_model_is_stored(spark, model):
    known = dict(M._trained)
    M._trained.clear()
    again = M.model(spark)
    assert again is not model and again.index == model.index and np.array_equal(again.weights, model.weights) and again.vocab == model.vocab
    M._trained.update(known)


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    trans = r.normal(size=(M.L, M.L)).astype(np.float32)
    sizes = np.array([1, 3, 2, 4])
    score = r.normal(size=(sizes.sum(), M.L)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = M.viterbi(score, first, sizes, trans)
    for f, n in zip(first, sizes):
        best = max(itertools.product(range(M.L), repeat=int(n)), key=lambda y: trans[0, y[0]] + sum(score[f + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) + trans[y[-1], 0])
        assert tuple(got[f : f + n]) == best


def test_pruning_changes_nothing(model):
    texts = [t for t, _ in labelled(200, seed=5)]
    short = M.Decoder(model).mentions(texts)
    whole = M.Decoder(model)
    whole.model = M.Model(model.vocab, model.index, model.weights, model.trans)
    whole.model.most = 1e9  # decode every token
    assert short == whole.mentions(texts)


def test_frames(spark):
    text = "Name: Linnea Falkberg\nAddress: 12 Mill Road\nTel: 415-555-0181. Please write to a.b@example.org if the page is missing."
    rows = [(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "— 12 —", "k"), (5, "the cat sat. " * 40_000 + "\n" + text, "k"), (1, text, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.start_at, r.kind) for r in M.mentions(df).collect())
    want = [(text.find(x), k) for x, k in (("Linnea", "person"), ("12 Mill", "address"), ("415", "phone"), ("a.b@", "email"))]
    assert got == sorted([(1, s, k) for s, k in want] * 2 + [(5, 13 * 40_000 + 1 + s, k) for s, k in want])
    red = {r.doc_id: r for r in M.redacted(df).collect()}
    assert red[1].text == "Name: [PERSON]\nAddress: [ADDRESS]\nTel: [PHONE]. Please write to [EMAIL] if the page is missing."
    assert red[2].text is None and red[3].text == "" and red[4].text == "— 12 —" and len(red) == 5
    assert M.mentions(df.limit(0)).count() == 0


def test_listed_words(spark):
    rows = [(i, f"Today the cat saw Marta. Marta ran home{'.' * i}") for i in range(6)] + [(9, None), (10, "ALL IN CAPITALS HERE MARTA")]
    got = M.listed_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(M.word_hashes(["the", "cat", "saw", "today", "ran", "home"]).tolist()) == set(got.tolist())
