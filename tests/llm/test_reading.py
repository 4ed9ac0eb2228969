import random

import numpy as np

from lexweave.llm import reading as G

EASY = "the cat sat on a mat and it was a big red cat".split()
HARD = "although heterogeneous institutional frameworks notwithstanding epistemological considerations".split()


def docs(n=120):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        p = i / n
        s = [" ".join(r.choice(HARD if r.random() < p else EASY) for _ in range(4 + int(14 * p))) + "." for _ in range(12)]
        rows.append((i, " ".join(s).capitalize(), r.choice(["en", None, "EN"]), 9))
        for rater in "ab":
            labels.append((i, rater, min(6, max(1, 1 + int(6 * p) + r.choice([-1, 0, 0, 0, 1])))))
    rows += [(900, None, "en", 9), (901, " ", "en", 9), (902, "— 12 —", None, 9), (903, "der Hund und die Katze ist nicht auf dem Haus", "en", 9), (904, "Книга на столе", None, 9), (905, "the cat " * 60_000, "de", 9), (905, "the cat", "en", 9)]
    labels += [(0, "a", None), (1, "c", 77), (2, None, 1), (3, "a", 1), (3, "a", 1), (900, "a", 2), (9999, "a", 4)]
    return rows, labels


def test_levels(spark):
    rows, labels = docs()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, level int")
    y = spark.createDataFrame(labels, "doc_id long, rater_id string, reading_band int")
    lex = G.lexicon(spark.createDataFrame([(w, i * 100 + 1) for i, w in enumerate(EASY)] + [(None, 1), ("x", None)], "form string, rank_no int"))
    got = {r.doc_id: r for r in G.levels(d.filter("doc_id <> 905 or lang = 'de'"), G.learn(d, y, lex), lex).collect()}
    assert len(got) == len(rows) - 1
    assert [got[i].status for i in range(900, 906)] == ["no_text", "no_words", "no_words", "other_language", "other_language", "ok"]
    score = np.array([got[i].score for i in range(120)])
    assert np.corrcoef(np.argsort(np.argsort(score)), np.arange(120))[0, 1] > 0.95
    order = np.argsort(score)
    assert (np.diff([got[int(i)].level for i in order]) >= 0).all() and got[119].band >= 5 and got[0].band <= 2
    assert G.held_out(d, y, lex)["pair_accuracy"] > 0.8


def test_foreign_at_any_length():
    for n in (5, 1000):
        assert G.foreign("Hund, und, die, der. " * n, "en")
        assert not G.foreign("dog, and, the, of. " * n, "de")


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "the cat sat", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, rater_id string, reading_band int")
    lex = G.lexicon(spark.createDataFrame([], "form string, rank_no int"))
    r = G.levels(d, G.learn(d, none, lex), lex).first()
    assert r.status == "ok" and r.level is None
    assert G.levels(d.limit(0), G.learn(d, none, lex), lex).count() == 0


def test_isotonic():
    x, y = G.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert y.tolist() == [1, 2.5, 4] and x.tolist() == [1, 2.5, 4]
