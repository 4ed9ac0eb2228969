import random

import numpy as np

from lexweave.llm import packing as P


def test_counts_equal_the_encoder():
    c = P.counter(P.default_tokenizer())
    for t in ["", " ", "Hello  world\n\n it's 12345!", "é 你好 ½", "a\x1cb c", "x" * 5000, "I'LL i'll"]:
        assert c.count(t) == len(c.encoding.encode_ordinary(t))


def test_best_two_fit():
    r = np.random.default_rng(1)
    for cap, n in ((10, 40), (2048, 3000), (7, 1), (5, 0)):
        sizes = r.integers(1, cap + 1, n)
        boxes = P.best_two_fit(sizes, cap)
        assert sorted(sum(boxes, [])) == sorted(sizes.tolist()) and all(sum(b) <= cap for b in boxes)
    # greedy would take 6 and leave 3 and 3 open; the smallest gives way to two that fit tightly
    assert [sorted(b) for b in P.best_two_fit(np.array([7, 2, 4, 4]), 10)][0] == [2, 7]
    assert len(P.best_two_fit(np.array([5, 4, 3, 2]), 10)) == 2


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 0, 5, 5, 17, 60, 64, 100, 200, 129])) for i in range(300)] + [(7, 64), (7, 64)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    for shard in (1000, 40):
        got = P.pack(df, capacity=64, shard_items=shard).collect()
        placed = [g for g in got if g.container is not None]
        assert len({(g.container, g.position) for g in placed}) == len(placed)
        used = {}
        for g in placed:
            used[g.container] = used.get(g.container, 0) + g.n_tokens
        assert max(used.values()) <= 64
        assert sum(g.n_tokens for g in placed) == sum(n or 0 for _, n in rows)
        assert all(g.n_pieces == max(1, -(-next(n for i, n in rows if i == g.doc_id) // 64)) for g in placed if g.doc_id != 7)
        assert sum(g.container is None for g in got) == sum(not n for _, n in rows)
    assert P.pack(df.limit(0)).count() == 0 and P.fill(P.pack(df.limit(0))).first().n_containers == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "two words", 2)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()} == {1: None, 2: 0, 3: 2}
