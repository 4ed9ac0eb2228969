"""Personal details inside free text (problem 5).

The method: a linear-chain conditional random field over word-shape features, trained here
from the small labelled table of ``pii_table`` and decoded by Viterbi in numpy batches.

A token's score is a sum of rows that depend only on the word types at its place and up to
three places around, so each distinct type is featurized once per worker. Tokens that no
optimal path can label (the gap to "outside" exceeds all that transitions could give back)
cut the text into short runs; only those are decoded, with the same result as decoding all.

Defined results
---------------
* null, blank and wordless texts have no mentions and stay as they are;
* texts of any length are handled whole; repeated rows each give their mentions;
* mentions never overlap; places count code points of the stored text;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.arrays import U64, codes, map_texts, prefix_hash, record_batch, span_hash
from lexweave.llm.canonical import _PLAIN, LOOKALIKE
from lexweave.session import shared_dir
from lexweave.llm.pii_table import CONTENT, CUES, ENGLISH, NUMBERS, WORDS, labelled

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
L = len(LABELS)
REACH = 3
OFFSETS = tuple(range(-REACH, REACH + 1))
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_TOP = 0x20000
_CLASS = np.full(_TOP, _OTHER, np.uint8)
_UPPER = np.zeros(_TOP, bool)
_LOWER = np.arange(_TOP, dtype=np.uint32)
_FOLD = np.arange(_TOP, dtype=np.uint32)  # look-alike and styled letters read as the plain letter
for _cp in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
    _c = chr(_cp)
    _plain = LOOKALIKE.get(_c) or _PLAIN.get(_cp) or _c
    if len(_plain) == 1:
        _FOLD[_cp] = ord(_plain)
    if _c.isspace():
        _CLASS[_cp] = _SPACE
    elif "0" <= _plain <= "9":
        _CLASS[_cp] = _DIGIT
    elif _c.isalpha() or unicodedata.category(_c) in ("Mn", "Mc", "Cf"):
        _CLASS[_cp] = _LETTER
    _UPPER[_cp] = _plain[0].isupper()
    if len(_plain[0].lower()) == 1:
        _LOWER[_cp] = ord(_plain[0].lower())
_CLASS[0x3000] = _SPACE
_CLASS[0x3040:0xE000] = _LETTER


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of lower-case words, as ``Tokens`` makes them of its tokens."""
    arr = codes("\n".join(words))
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size + 1) - 1
    return np.unique(span_hash(prefix_hash(arr), end - size, end)) if len(words) else np.zeros(0, U64)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


_ENGLISH = word_hashes(sorted(ENGLISH))
_AT, _DOT = (word_hashes([w])[0] for w in ("at", "dot"))

#: A place is strange (another language, a list of names) where less than ``FOREIGN_SHARE`` of the words within ``FOREIGN_REACH`` are
#: English words of the table.
FOREIGN_REACH, FOREIGN_SHARE = 7, 0.25


class Tokens:
    """Tokens of texts: letter runs, digit runs, single other signs; with type hashes.

    Digits count as alike. A text (nearly) all in capitals or without any is read without case. A token's type
    also holds what surrounds it: the gap before it, whether its chunk (up to the next space) has an at sign or is
    dotted, the digits in its run of numbers, whether the word is listed, and whether the words around it mostly are not.
    """

    def __init__(self, texts: list[str], listed: np.ndarray):
        arr = codes("\n".join(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        low = np.minimum(arr, _TOP - 1)
        cls = _CLASS[low]
        upper = _UPPER[low]
        letters = np.concatenate([[0], np.cumsum(cls == _LETTER)])
        uppers = np.concatenate([[0], np.cumsum(upper)])
        end = np.minimum(self.bounds[1:], len(arr))
        n, u = letters[end] - letters[self.bounds[:-1]], uppers[end] - uppers[self.bounds[:-1]]
        caseless = (n > 0) & ((u >= 0.9 * n) | (u == 0))
        lower = np.where(cls == _DIGIT, np.uint32(48), np.where(arr < _TOP, _LOWER[low], arr))
        norm = np.where(cls == _DIGIT, np.uint32(48), np.where(arr < _TOP, _FOLD[low], arr))
        for i in np.flatnonzero(caseless):
            norm[self.bounds[i] : end[i]] = lower[self.bounds[i] : end[i]]
        before = np.concatenate([[_SPACE], cls[:-1]]) if len(cls) else cls
        self.start = np.flatnonzero((cls != _SPACE) & ((cls != before) | (cls == _OTHER)))
        after = np.concatenate([cls[1:], [_SPACE]]) if len(cls) else cls
        self.end = np.flatnonzero((cls != _SPACE) & ((cls != after) | (cls == _OTHER))) + 1
        self.norm = norm
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        m = len(self.start)
        if not m:
            self.hash = self.spoken = np.zeros(0, U64)
            self.word = self.small = self.opens = self.free = np.zeros(0, bool)
            return
        gap = self.start - np.concatenate([[0], self.end[:-1]])
        broken = np.concatenate([[0], np.cumsum(arr == 10)])
        newline = broken[self.start] - broken[np.concatenate([[0], self.end[:-1]])] > 0
        glue = np.where(newline, 2, (gap > 0).astype(np.int64))
        glue[np.concatenate([[True], self.doc[1:] != self.doc[:-1]])] = 2
        kind, sign = cls[self.start], norm[self.start]
        spoken = span_hash(prefix_hash(lower), self.start, self.end)
        self.known = (kind == _LETTER) & _among(spoken, listed)
        words = np.flatnonzero(kind == _LETTER)
        # runs of four or more words in capitals are read without case, like a text that is all capitals
        loud = uppers[self.end[words]] - uppers[self.start[words]] == self.end[words] - self.start[words]
        edge = np.flatnonzero(np.concatenate([[True], (loud[1:] != loud[:-1]) | (self.doc[words][1:] != self.doc[words][:-1])])) if len(words) else words
        size = np.diff(np.append(edge, len(words)))
        shouted = words[np.repeat(size >= 4, size) & loud] if len(words) else words
        case = caseless[self.doc].copy()
        case[shouted] = True
        for a, b in zip(self.start[shouted].tolist(), self.end[shouted].tolist()):
            norm[a:b] = lower[a:b]
        # the share of English words among up to FOREIGN_REACH words on either side, within the text
        total = np.concatenate([[0], np.cumsum(_among(spoken[words], _ENGLISH))])
        owner = self.doc[words]
        lo = np.maximum(np.arange(len(words)) - FOREIGN_REACH, np.searchsorted(owner, owner))
        hi = np.minimum(np.arange(len(words)) + FOREIGN_REACH + 1, np.searchsorted(owner, owner, side="right"))
        strange = np.zeros(m, bool)
        strange[words] = (hi - lo >= FOREIGN_REACH) & (total[hi] - total[lo] < FOREIGN_SHARE * (hi - lo))
        follow = np.concatenate([glue[1:], [2]])
        # chunks: tokens without a gap between
        chunk_at = np.flatnonzero(glue > 0)
        chunk = np.cumsum(glue > 0) - 1
        letter_before = np.concatenate([[False], kind[:-1] == _LETTER])
        letter_after = np.concatenate([kind[1:] == _LETTER, [False]])
        dotted = (sign == 46) & (glue == 0) & (follow == 0) & letter_before & letter_after
        bracket = np.concatenate([[False], np.isin(sign[:-1], [40, 60, 91, 123])]) & (glue == 0)
        at = (spoken == _AT) & (bracket | ((glue == 1) & (follow == 1)))
        any_in = lambda flag: np.maximum.reduceat(flag.astype(np.int8), chunk_at) > 0
        later = lambda flag, k: np.concatenate([flag[k:], np.zeros(min(k, len(flag)), bool)])
        marked, dots, ats = any_in((sign == 64) | (at & bracket)), any_in(dotted | (spoken == _DOT)), any_in(at | (sign == 64))
        named = later(ats, 1) & (later(dots, 1) | later(dots, 2) | later(dots, 3))
        shape = np.where(marked, 1, np.where(named, 3, np.where(dots, 2, 0)))[chunk]
        # runs of numbers: digits and the signs that join them
        joins = (sign == 45) | (sign == 40) | (sign == 41) | (sign == 43) | (((sign == 46) | (sign == 47)) & (glue == 0) & (follow == 0))
        numeric = (kind == _DIGIT) | ((kind == _OTHER) & joins)
        starts = numeric & (~np.concatenate([[False], numeric[:-1]]) | (glue == 2) | (sign == 43))
        run = np.cumsum(starts)
        total = np.bincount(run, np.where(kind == _DIGIT, self.end - self.start, 0), run[-1] + 1).astype(np.int64)
        digits = np.where(numeric, np.minimum(total[run], 15), 0)
        self.spoken, self.word, self.free = spoken, kind == _LETTER, ~case
        # written with a capital where a sentence or line begins: not after a short form such as a title or an initial
        small = norm[self.start] == lower[self.start]
        back = lambda x, k: np.concatenate([np.zeros(min(k, m), x.dtype), x[:-k]])[:m]
        ended = np.isin(back(sign, 1), [33, 63]) | ((back(sign, 1) == 46) & back(small & (kind == _LETTER), 2))
        self.small, self.opens = small & ~case, ~small & ~case & ((glue == 2) | (ended & (glue == 1)))
        self.marks = np.stack([glue, case, shape, digits, starts, self.known, strange], axis=1).astype(np.int64)
        code = self.marks @ np.array([1, 4, 8, 32, 1024, 2048, 4096])
        self.hash = span_hash(prefix_hash(norm), self.start, self.end) ^ ((code + 1).astype(U64) * U64(0xD6E8FEB86659FD93))

    def key(self, i: int) -> tuple:
        s = self.norm[self.start[i] : min(self.end[i], self.start[i] + 40)].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return s, *self.marks[i].tolist()


def shape(w: str, case: int) -> str:
    if w[0] == "0":
        return f"d{min(len(w), 9)}"
    if not w[0].isalpha():
        return w[0] if len(w) == 1 else "?"
    if case:
        return "w1" if len(w) == 1 else "w"
    if w.isupper():
        return "X1" if len(w) == 1 else "XX"
    return "Xx" if w[0].isupper() else "x" if w.islower() else "xX"


def type_features(vocab: frozenset[str], w: str, glue: int, case: int, chunk: int, digits: int, first: int, known: int, strange: int) -> list[list[str]]:
    """Feature names of a token type for each place in OFFSETS.

    Words of the table's own vocabulary are features of their own; all other words count by shape and by whether they are
    listed. So no name and no part of one is ever learned by heart.
    """
    s, low = shape(w, case), w.lower()
    letter = w[0].isalpha()
    word = low if not letter or low in vocab else "(listed)" if known else "(other)"
    look = f"{s}|{known}{chunk}"
    run = f"nd={digits}|{first}"
    own = ["bias", f"w={word}", f"sh={look}", f"g={glue}", f"sg={look}|{glue}", f"wg={word}|{glue}", f"ws={word}|{s}", f"n={min(len(w), 8)}|{look}", f"fo={strange}|{look}", run, f"{run}|{s}|{glue}", f"ch={chunk}|{glue}"]
    near = [f"w={word}", f"sh={look}", f"sg={look}|{glue}", f"wg={word}|{glue}", f"ws={word}|{s}", run, f"ch={chunk}|{glue}"]
    far = [f"w={word}", f"sh={look}", f"sg={look}|{glue}", run]
    last = far[:3]
    return [[f"{o}:{x}" for x in (own if o == 0 else near if abs(o) == 1 else far if abs(o) == 2 else last)] for o in OFFSETS]


class Model:
    """Feature weights, transitions (label O stands for the outside of a text) and the pruning bound."""

    def __init__(self, vocab: frozenset[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.vocab, self.index, self.weights, self.trans = vocab, index, weights.astype(np.float32), trans.astype(np.float32)
        t = self.trans
        # the most that a label l between any a and b can gain over O by transitions alone
        self.most = float((t[:, :, None] + t[None, :, :] - (t[:, 0][:, None, None] + t[0, :][None, None, :])).max())

    def rows(self, key: tuple) -> np.ndarray:
        get = self.index.get
        out = np.zeros((len(OFFSETS), L), np.float32)
        for k, names in enumerate(type_features(self.vocab, *key)):
            ids = [i for x in names if (i := get(x)) is not None]
            if ids:
                out[k] = self.weights[ids].sum(axis=0)
        return out


class Decoder:
    """Scores of word types met so far in this worker, and batch decoding."""

    LIMIT = 400_000

    def __init__(self, model: Model, listed: np.ndarray = np.zeros(0, U64)):
        self.model, self.listed = model, np.union1d(listed, word_hashes(sorted(WORDS)))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[int, int] = {}
        self.scores = np.zeros((1024, len(OFFSETS), L), np.float32)  # type 0 is the outside of a text
        self.bound = np.zeros((1024, len(OFFSETS)), np.float32)

    def types(self, tokens: Tokens) -> np.ndarray:
        distinct, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
        if len(self.ids) + len(distinct) > self.LIMIT:
            self.clear()
        ids, get = np.empty(len(distinct), np.int64), self.ids.get
        for k, h in enumerate(distinct.tolist()):
            i = get(h)
            if i is None:
                i = self.ids[h] = len(self.ids) + 1
                if i >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
                self.scores[i] = r = self.model.rows(tokens.key(int(first[k])))
                self.bound[i] = (r[:, 1:] - r[:, :1]).max(axis=1)
            ids[k] = i
        return ids[inverse]

    def mentions(self, texts: list[str]) -> list[tuple[int, int, int, str]]:
        """(text number, start, end, kind), in order."""
        tokens = Tokens(texts, self.listed)
        n = len(tokens.start)
        if not n:
            return []
        ids = self.types(tokens)
        # REACH places of "outside" between texts
        at = np.arange(n) + REACH * (tokens.doc + 1)
        line = np.zeros(at[-1] + REACH + 1, np.int64)
        line[at] = ids
        top = np.zeros(n, np.float32)
        for k, o in enumerate(OFFSETS):
            top += self.bound[:, k][line[at + o]]
        open_ = np.flatnonzero(top > -self.model.most - 1e-3)
        if not len(open_):
            return []
        score = np.zeros((len(open_), L), np.float32)
        for k, o in enumerate(OFFSETS):
            score += self.scores[line[at[open_] + o], k]
        cut = np.flatnonzero((np.diff(open_) != 1) | (tokens.doc[open_[1:]] != tokens.doc[open_[:-1]])) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(open_)]])
        label = viterbi(score, first, last - first, self.model.trans)
        out = []
        kind = (label + 1) // 2
        begin = (label > 0) & (label % 2 == 1)
        inside = (label > 0) & ~begin
        follows = np.zeros(len(label), bool)
        follows[1:] = np.diff(open_) == 1
        follows[first] = False
        same = np.zeros(len(label), bool)
        same[1:] = kind[1:] == kind[:-1]
        starts = np.flatnonzero(begin | (inside & ~(follows & same)))
        goes_on = inside & follows & same
        stop = np.flatnonzero(~goes_on)
        for s in starts:
            e = np.searchsorted(stop, s, side="right")
            e = (stop[e] if e < len(stop) else len(label)) - 1
            i, j = open_[s], open_[e]
            d = tokens.doc[i]
            base = tokens.bounds[d]
            m = trimmed(texts[d], int(tokens.start[i] - base), int(tokens.end[j] - base), KINDS[kind[s] - 1])
            if m and not (out and out[-1][0] == d and out[-1][2] > m[0]):
                out.append((int(d), *m, KINDS[kind[s] - 1]))
        return out


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """Place of a decoded mention brought to whole words, without the signs around them; None where it lacks
    the signs that its kind can't be without (an email its at sign, a number its digits, a name its letters)."""
    while start > 0 and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    opening = "+(" if kind == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in opening):
        start += 1
    if kind == "phone" and text[start : start + 1] == "(" and ")" not in text[start:end]:
        start += 1
    while start < end and not (text[end - 1].isalnum() or text[end - 1] == "." and kind in ("person", "address")):
        end -= 1
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return (start, end) if "@" in s or re.search(r"\bat\b", s, re.I) else None
    enough = {"phone": digits >= 7, "id_number": digits >= 6, "address": len(s) >= 6 and (digits > 0 or s.split()[0].split("-")[0].lower() in NUMBERS), "person": sum(c.isalpha() for c in s) >= 2}
    return (start, end) if enough[kind] else None


def viterbi(score: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of runs of tokens that stand between outside tokens; runs of like length go together."""
    label = np.zeros(len(score), np.int64)
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for lv in np.unique(level):
        runs = np.flatnonzero(level == lv)
        step = max(1, 200_000 // (1 << lv))
        for s in range(0, len(runs), step):
            r = runs[s : s + step]
            f, n = first[r], size[r]
            T = int(n.max())
            best = trans[0] + score[f]
            back = np.zeros((T, len(r), L), np.int8)
            final = np.where((n == 1)[:, None], best + trans[:, 0], 0)
            for t in range(1, T):
                both = best[:, :, None] + trans
                back[t] = both.argmax(axis=1)
                best = both.max(axis=1) + score[np.minimum(f + t, len(score) - 1)]
                done = n == t + 1
                if done.any():
                    final[done] = best[done] + trans[:, 0]
            y = final.argmax(axis=1)
            for t in range(T - 1, -1, -1):
                live = t < n
                label[f[live] + t] = y[live]
                y = np.where(live & (t > 0), back[t][np.arange(len(r)), y], y)
    return label


class _Sums:
    """Sums of rows by group for (group, member) pairs: the members' rows are added up per group."""

    def __init__(self, group: np.ndarray, member: np.ndarray, n: int):
        order = np.argsort(group, kind="stable")
        self.member = member[order]
        self.at, self.start = np.unique(group[order], return_index=True)
        self.n = n

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]), np.float32)
        if len(self.at):
            out[self.at] = np.add.reduceat(rows[self.member], self.start, axis=0)
        return out


def train(rows=None, rounds: int = 60, ridge: float = 0.4, least: int = 4, hold_out: float = 0.25, seed: int = 3) -> Model:
    """Fit by maximum likelihood with a Gaussian prior: full-batch Adam, scaled forward-backward.

    A share ``hold_out`` of the content words is kept out of the vocabulary, so that the model also learns how a
    listed word behaves that it doesn't know.
    """
    rows = labelled() if rows is None else rows
    r = np.random.default_rng(seed)
    vocab = frozenset(w for w in sorted(WORDS) if w not in CONTENT or w in CUES or r.random() >= hold_out)
    texts = [t for t, _ in rows]
    tokens = Tokens(texts, word_hashes(sorted(WORDS)))
    n = len(tokens.start)
    gold = np.zeros(n, np.int64)
    where = tokens.start - tokens.bounds[tokens.doc]
    span = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
    for d, (_, marks) in enumerate(rows):
        for s, e, k in marks:
            i = np.arange(span[d], span[d + 1])
            i = i[(where[i] >= s) & (where[i] < e)]
            gold[i] = 2 * KINDS.index(k) + 2
            gold[i[:1]] -= 1
    distinct, first, ids = np.unique(tokens.hash, return_index=True, return_inverse=True)
    index: dict[str, int] = {}
    pairs: list[list[tuple[int, int]]] = [[] for _ in OFFSETS]
    for t, i in enumerate(first):
        for k, names in enumerate(type_features(vocab, *tokens.key(int(i)))):
            pairs[k] += [(t + 1, index.setdefault(x, len(index))) for x in names]
    # a feature of a few tokens tells nothing
    often = np.zeros(len(index))
    number = np.bincount(ids + 1, minlength=len(distinct) + 1)
    feats = [np.array(p).T for p in pairs]
    for t, f in feats:
        often += np.bincount(f, number[t], len(index))
    new = np.cumsum(often >= least) - 1
    index = {x: int(new[i]) for x, i in index.items() if often[i] >= least}
    feats = [np.stack([t[often[f] >= least], new[f[often[f] >= least]]]) for t, f in feats]
    V = len(distinct) + 1
    score_sums, spread_sums = [_Sums(t, f, V) for t, f in feats], [_Sums(f, t, len(index)) for t, f in feats]
    at = np.arange(n) + REACH * (tokens.doc + 1)
    line = np.zeros(at[-1] + REACH + 1, np.int64)
    line[at] = ids + 1
    around = [line[at + o] for o in OFFSETS]
    order = np.argsort(-(np.diff(span)), kind="stable")
    length = np.diff(span)[order]
    order, length = order[length > 0], length[length > 0]
    T = int(length.max())
    live = [int((length > t).sum()) for t in range(T)]
    rows_at = [span[order[: live[t]]] + t for t in range(T)]
    W, trans = np.zeros((len(index), L)), np.zeros((L, L))
    mom = [np.zeros_like(W), np.zeros_like(W), np.zeros_like(trans), np.zeros_like(trans)]
    gold_trans = np.zeros((L, L))
    head = np.concatenate([[True], tokens.doc[1:] != tokens.doc[:-1]])
    np.add.at(gold_trans, (np.where(head, 0, np.concatenate([[0], gold[:-1]])), gold), 1)
    tail = np.concatenate([head[1:], [True]])
    np.add.at(gold_trans, (gold[tail], 0), 1)
    onehot = np.zeros((n, L))
    onehot[np.arange(n), gold] = 1

    def spread(p: np.ndarray) -> np.ndarray:
        """Sum token rows into feature rows."""
        g = np.zeros((len(index), L))
        for a, sums in zip(around, spread_sums):
            g += sums(np.stack([np.bincount(a, p[:, j], V) for j in range(L)], axis=1))
        return g

    target = spread(onehot)
    for it in range(1, rounds + 1):
        score, small = np.zeros((n, L)), W.astype(np.float32)
        for a, sums in zip(around, score_sums):
            score += sums(small)[a]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        X = np.exp(trans)
        alpha, beta = np.zeros((n, L)), np.zeros((n, L))
        prev = None
        for t in range(T):
            i = rows_at[t]
            a = (X[0] if t == 0 else alpha[prev[: live[t]]] @ X) * e[i]
            alpha[i] = a / a.sum(axis=1, keepdims=True)
            prev = i
        expect = np.zeros((L, L))
        for t in range(T - 1, -1, -1):
            i = rows_at[t]
            nxt = live[t + 1] if t + 1 < T else 0
            b = np.tile(X[:, 0], (len(i), 1))
            if nxt:
                j = rows_at[t + 1]
                v = beta[j] * e[j]
                b[:nxt] = v @ X.T
                z = np.einsum("ba,ba->b", alpha[i[:nxt]], b[:nxt])  # each pair's posteriors are normalized by themselves
                expect += X * ((alpha[i[:nxt]] / z[:, None]).T @ v)
            beta[i] = b / b.max(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=1, keepdims=True)
        expect[0] += post[rows_at[0]].sum(axis=0)
        expect[:, 0] += post[tail].sum(axis=0)
        gw, gt = target - spread(post) - ridge * W, gold_trans - expect - ridge * trans
        rate = 0.25 * (1 - 0.85 * it / rounds)
        for x, g, m, v in ((W, gw, mom[0], mom[1]), (trans, gt, mom[2], mom[3])):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.98**it)) + 1e-6)
    used = np.abs(W).max(axis=1) > 1e-3
    kept = {x: k for k, x in enumerate(x for x, i in index.items() if used[i])}
    return Model(vocab, kept, W[[index[x] for x in kept]], trans)


_trained: dict[str, Model] = {}
_decoders: dict[int, Decoder] = {}


def _stamp() -> str:
    """Names the model by its table and its code."""
    parts = [Path(__file__).read_bytes(), Path(__file__).with_name("pii_table.py").read_bytes()]
    return hashlib.sha256(b"".join(parts)).hexdigest()[:24]


def model(spark: SparkSession) -> Model:
    """The model: from this process, else from the shared folder, else trained on the driver and stored there."""
    path = f"{shared_dir(spark)}/lexweave-models/pii-{_stamp()}"
    if path not in _trained:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            r = spark.read.schema("vocab string, names string, weights binary, trans binary").parquet(path).first()
            weights, trans = np.frombuffer(r.weights, np.float32).reshape(-1, L), np.frombuffer(r.trans, np.float32).reshape(L, L)
            _trained[path] = Model(frozenset(r.vocab.split("\n")), {x: i for i, x in enumerate(r.names.split("\n"))}, weights, trans)
        else:
            m = _trained[path] = train()
            row = ("\n".join(sorted(m.vocab)), "\n".join(m.index), bytearray(m.weights.tobytes()), bytearray(m.trans.tobytes()))
            spark.createDataFrame([row], "vocab string, names string, weights binary, trans binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _trained[path]


def _decoder(shared) -> Decoder:
    pair = shared.value
    if id(pair) not in _decoders:
        _decoders.clear()
        _decoders[id(pair)] = Decoder(*pair)
    return _decoders[id(pair)]


#: Listed words: at most this many, the most frequent of the words that are written small in at least ``SMALL_SHARE`` of their
#: places, or small or at the start of a sentence in at least ``START_SHARE``.
LISTED_WORDS = 500_000
LEAST_COUNT = 4
SMALL_SHARE, START_SHARE = 0.5, 0.92


def word_counts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(hash, times written small, times with a capital that opens a sentence, times) of words where capitals are used."""
    t = Tokens(texts, np.zeros(0, U64))
    use = t.word & t.free
    h, at = np.unique(t.spoken[use], return_inverse=True)
    return h, *(np.bincount(at, w, len(h)).astype(np.int64) for w in (t.small[use], t.opens[use], np.ones(len(at))))


def listed_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the common words of the whole corpus: those that are mostly small, or have capitals only where sentences begin.

    Names are not among them even where some are written small. Counts are made per block of texts before they are
    shuffled; what comes to the driver and goes to the tasks is bounded by ``LISTED_WORDS`` (8 bytes each).
    """
    names = ("h", "small", "opens", "n")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def fn(ids, texts):
        h, *counts = word_counts(texts)
        yield record_batch(schema, [h.view(np.int64), *counts])

    counts = map_texts(_narrow(docs), fn, ", ".join(f"{c} bigint" for c in names)).groupBy("h").agg(*(F.sum(c).alias(c) for c in names[1:]))
    common = (F.col("small") >= SMALL_SHARE * F.col("n")) | (F.col("small") + F.col("opens") >= START_SHARE * F.col("n"))
    rows = counts.filter((F.col("n") >= LEAST_COUNT) & common).orderBy(F.desc("n"), "h").limit(LISTED_WORDS).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(rows.view(U64))


_MENTION = pa.schema([("doc_id", pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("kind", pa.string())])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shared(docs: DataFrame, listed: np.ndarray | None):
    spark = docs.sparkSession
    return spark.sparkContext.broadcast((model(spark), listed_words(docs) if listed is None else listed))


def mentions(docs: DataFrame, listed: np.ndarray | None = None) -> DataFrame:
    """``doc_id, start_at, end_at, kind`` of every mention. ``listed``: hashes of common words, by default those of ``docs``."""
    shared = _shared(docs, listed)

    def fn(ids, texts):
        found = _decoder(shared).mentions(texts)
        if found:
            yield record_batch(_MENTION, [[ids[d] for d, _, _, _ in found], [m[1] for m in found], [m[2] for m in found], [m[3] for m in found]])

    return map_texts(_narrow(docs), fn, "doc_id bigint, start_at bigint, end_at bigint, kind string")


def redacted(docs: DataFrame, listed: np.ndarray | None = None) -> DataFrame:
    """``doc_id, text, n_mentions``: each mention replaced by a placeholder of its kind."""
    shared = _shared(docs, listed)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_mentions", pa.int32())])

    def fn(ids, texts):
        parts = [[0] for _ in texts]
        out = [[] for _ in texts]
        for d, s, e, k in _decoder(shared).mentions(texts):
            out[d] += [texts[d][parts[d][0] : s], PLACEHOLDER[k]]
            parts[d][0] = e
        new = ["".join(o) + t[p[0] :] for o, t, p in zip(out, texts, parts)]
        yield record_batch(schema, [ids, new, [len(o) // 2 for o in out]])

    with_text = map_texts(_narrow(docs), fn, "doc_id bigint, text string, n_mentions int")
    return with_text.unionByName(_narrow(docs).filter("text is null").withColumn("n_mentions", F.lit(0)))
