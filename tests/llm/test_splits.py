import random
import re
import unicodedata

import numpy as np
import pytest

from lexweave.llm import splits as P

WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?")
VOCAB = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "nrt"]


def essays(seed=2):
    r = random.Random(seed)
    base = [" ".join(r.choices(VOCAB, k=r.randint(3, 160))) for _ in range(40)]
    rows = []
    for i in range(160):
        t = base[r.randrange(40)].split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            if t:
                t[r.randrange(len(t))] = r.choice(VOCAB)
        text = r.choice([" ", "  ", " "]).join(t)
        text = text.upper() if r.random() < 0.2 else text
        text = r.choice([text, text + ".", text, None if i % 40 == 0 else text, " " if i % 41 == 0 else text])
        rows.append((i, r.choice(["a1", " A1", "b2", None, "", f"u{i}", f"u{i}"]), text, r.choice(["train", "Train\xa0", "test", "\u2003VALIDATION", None, "dev", "training"]), r.choice(["x", None]), i))
    return rows


def brute(rows):
    sets = [(r[0], (r[3] or "").strip().lower(), (r[1] or "").strip().lower(), P.text_form(r[2] or ""), WORD.findall(unicodedata.normalize("NFC", r[2] or "").lower())) for r in rows]
    grams = {s[0]: {tuple(s[4][k : k + 5]) for k in range(len(s[4]) - 4)} for s in sets}
    out = set()
    for a in sets:
        for b in sets:
            if a[1] == "train" and b[1] in P.EVAL_SETS:
                x, y = grams[a[0]], grams[b[0]]
                near = bool(x | y) and len(x & y) >= 0.85 * len(x | y)
                if (a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or near:
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("shard", [6_000_000, 900])
def test_overlaps_are_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    rows = essays()
    df = spark.createDataFrame(rows, "essay_row long, text_id_kaggle string, full_text string, set_name string, source string, word_key int")
    pairs = P.overlaps(df).cache()
    got = [(r.train_row, r.eval_row) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    near = pairs.filter("near_text").collect()
    assert near and all(0.85 <= r.resemblance <= 1 and 5 <= r.longest_match <= r.covered_words for r in near)
    counts = P.overlap_counts(pairs).collect()
    assert sum(r.n_pairs for r in counts) == len(got)


def test_empty(spark):
    schema = "essay_row long, text_id_kaggle string, full_text string, set_name string, source string"
    assert P.overlaps(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a", "x y z", "train", None), (2, "a", None, "test", None)], schema)
    assert [(r.train_row, r.eval_row) for r in P.overlaps(one).collect()] == [(1, 2)]


def test_words():
    r = random.Random(4)
    texts = ["", "don't", "a'b'c d’e’f''g", "'x' y'", "É e\u0301t\u00e9'a\nb'\nc", *("".join(r.choices("ab' ’\n.É", k=r.randint(0, 30))) for _ in range(300))]
    h, doc = P.word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(unicodedata.normalize("NFC", t).lower())]
    assert doc.tolist() == [i for i, _ in words]
    known = dict(zip((w for _, w in words), h.tolist()))
    assert [known[w] for _, w in words] == h.tolist() and len(set(known.values())) == len(known)


def test_suffix_order():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        for _ in range(20):
            s = np.concatenate([r.integers(5, 8, n), [0], r.integers(5, 7, n), [1]])
            assert P._suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_backward_search_counts():
    texts = [w.split() for w in ("a b a b c a b", "b c a b a b a", "x")]
    number = {w: np.uint64(i + 9) for i, w in enumerate("abcx")}
    index = P.TextIndex.unpack(dict(P.TextIndex.pack([bytes([i]) * 16 for i in range(3)], [np.array([number[w] for w in t]) for t in texts])))

    def count(words):
        lo, hi = np.array([0]), np.array([index.n])
        for w in reversed(words):
            lo, hi = index.step(lo, hi, np.searchsorted(index.vocab, [number[w]]) + index.first_word)
        return int(hi[0] - lo[0])

    for n in (1, 2, 3):
        grams = [tuple(t[k : k + n]) for t in texts for k in range(len(t) - n + 1)]
        for g in set(grams):
            assert count(g) == grams.count(g)
    assert count(("c", "c")) == 0


def test_large_evaluation_side_takes_one_pass(spark, monkeypatch):
    """An evaluation side beyond one shard gives the rows of the index, without a pass over the training rows per shard."""
    rows = essays(5)
    df = spark.createDataFrame(rows, "essay_row long, text_id_kaggle string, full_text string, set_name string, source string, word_key int")
    keys = P.split_keys(df).cache()
    every = lambda d: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in d.collect())
    index = every(P.near_copies(df, keys))
    monkeypatch.setattr(P, "SHARD_WORDS", 300)
    routed = P.near_copies(df, keys)
    assert every(routed) == index and len(index) > 5
    assert routed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
