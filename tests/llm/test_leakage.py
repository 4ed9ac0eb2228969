import random

import numpy as np

from lexweave.llm import leakage as K

VOCAB = [a + b for a in "bcdfgklm" for b in ("an", "el", "it", "ox", "uz")]


def corpus():
    r = random.Random(5)
    say = lambda n: " ".join(r.choices(VOCAB, k=n))
    items = [(i, say(r.randint(8, 45))) for i in range(30)] + [(90, None), (91, ""), (92, "!!"), (93, say(11))]
    docs = []
    for d in range(60):
        words = say(r.randint(0, 80)).split()
        if d % 3 == 0:
            w = items[r.randrange(30)][1].split()
            cut = w[r.randint(0, 5) :][: r.randint(5, 40)]
            words[10:10] = cut
        docs.append((d, ", ".join(words).upper() if d % 5 == 0 else "\n".join(words)))
    docs += [(100, None), (101, ""), (102, "é"), (103, (items[3][1] + " ") * 40), (103, items[4][1])]
    return docs, items


def runs(t):
    return K.Words([K.word_form(t)]).data.decode().replace(",", " ").split() if t else []


def test_exact_windows_against_brute_force(spark):
    docs, items = corpus()
    expected = set()
    for i, t in items:
        iw = runs(t)
        grams = {tuple(iw[k : k + 12]) for k in range(len(iw) - 11)}
        expected |= {(d, i) for d, x in docs for w in [runs(x)] if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11))}
    ddf = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in K.leaks(ddf, idf).collect()}
    assert got == expected and len(expected) > 10
    assert K.leaks(ddf.limit(0), idf).count() == 0 and K.leaks(ddf, idf.limit(0)).count() == 0


def test_recall_with_edits(spark):
    """Recall of the whole operator against brute force over all windows, on altered passages."""
    r = random.Random(1)
    w, edits = 24, 2
    vocab = [f"{a}{b}" for a in VOCAB for b in "abcdefgh"]
    items = [" ".join(r.choices(vocab, k=r.randint(w, w + 6))) for _ in range(120)] + [" ".join(r.choices(vocab, k=k)) for k in (4, 7, 12, 12, 23, 23)]
    docs = []
    for t in items:
        words = t.split()
        for _ in range(r.choice((0, 1, edits))):
            p = r.randrange(len(words))
            if r.random() < 0.5:
                words[p] = r.choice(vocab)
            else:
                words.insert(p, r.choice(vocab))
        docs.append(" ".join([*r.choices(vocab, k=15), *words, *r.choices(vocab, k=15)]))
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    idf = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in K.leaks(ddf, idf, w, edits, short_items=True).collect()}
    want = {}
    for k, t in enumerate(items):  # other pairs have nothing in common
        a, b = (K.Words([K.word_form(x)]).hash for x in (docs[k], t))
        n = min(w, len(b))
        best = min(K.edit_distances(np.repeat(b[j : j + n][None], len(a) - n + 1, 0), np.stack([a[i : i + n] for i in range(len(a) - n + 1)])).min() for j in range(len(b) - n + 1))
        if best <= edits * n // w:
            want[k, k] = int(best)
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) and all(want[x] <= e for x, e in got.items())
    whole = {k for k, _ in got}
    assert {k for k, _ in want if want[k, k] == 0} <= whole


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4]], np.uint64)
    b = np.array([[2, 3, 4, 5], [1, 9, 3, 4]], np.uint64)
    assert K.edit_distances(a, b).tolist() == [2, 1]
