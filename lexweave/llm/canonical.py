"""One consistent form for text that looks the same (problem 2).

The method: each token's script sets (letters common to several scripts count for all of
them) are intersected. An empty intersection means a mixed-script token; a token of one
non-Latin script whose letters all have a Latin look-alike may be a whole-script
confusable. The spelling is then chosen whose script all letters can be written in, and
all other variants (width, style, ligature, composition, invisible characters, spaces) are
brought to their plain form.

Defined results
---------------
* null stays null, an empty text empty; plain ASCII text is returned as it is.
* a non-Latin token that could be either (all letters have a look-alike) is taken for Latin unless
  it stands in a run of such tokens with one really written in that script, or the words really
  written in it outnumber the Latin ones in its sentence (in its text, if the sentence has neither).
* very long texts are handled whole; there is no state but a bounded token cache.
* repeated rows are handled alike; extra columns are carried through.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other alphabets that look like a plain Latin letter.
CYRILLIC = dict(zip("асԁеһіјӏорԛѕуԝхүѵАВСЕНІЈКМОРЅТУХҺԀԌԚԜӀҮ", "acdehijlopqsywxyvABCEHIJKMOPSTYXHDGQWIY", strict=True))
GREEK = dict(zip("αγικνορτυχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ayikvoptuxcjABEZHIKMNOPTYXC", strict=True))
ARMENIAN = dict(zip("օոսհցզՕՍԼ", "onuhgqOUL", strict=True))
CHEROKEE = dict(zip("ᎪᎬᎳᎷᎻᏃᏚᏢᎢᎡᏙᏒᎫᎥ", "AEWMHZSPTRVRJi", strict=True))
#: Latin letters of other alphabets (phonetic, Turkish) and small capitals are left alone but for these.
LATIN = dict(zip("ɑɡıɩɪʏƖᴏᴠᴡᴢᴄⱭꞬ", "agiiiyIovwzcAG", strict=True))

#: Greek letters that stand alone as signs in formulas; only in a mixed token are they look-alikes.
_GREEK_SIGNS = set("αγικνρτυχ")

LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LATIN
_SCRIPT = {c: s for s, m in (("Cyrl", CYRILLIC), ("Grek", GREEK), ("Armn", ARMENIAN), ("Cher", CHEROKEE), ("Latn", LATIN)) for c in m}
_BACK = {s: {v: k for k, v in reversed(m.items())} for s, m in (("Cyrl", CYRILLIC), ("Grek", GREEK))}

_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Georgian", "Thai")
_SHORT = {"Latin": "Latn", "Cyrillic": "Cyrl", "Greek": "Grek", "Armenian": "Armn", "Cherokee": "Cher"}
_SCX = [(_SHORT.get(s, s), regex.compile(rf"\p{{scx={s}}}")) for s in _SCRIPTS]
#: Writing systems that mix scripts: their letters go together.
_WRITTEN_WITH = {"Han": ("Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",)}
_NEUTRAL = regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")

#: Scripts in which the joiners choose letter shapes, so that they are needed there.
_JOINING = regex.compile(
    r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}]"
)
_RTL = regex.compile(r"[[\p{bc=R}\p{bc=AL}]&&\p{L}]", regex.V1)
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}⃣️0-9#*]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_PHONETIC = re.compile("[ɐɒ-ɠɢ-ʯːˈˌ]")
_TURKISH = re.compile("[ğĞşŞİəƏ]")

_TURNS = {0x200C, 0x200D}
_MARKS = {0x200E, 0x200F, 0x061C, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}


def _invisible(cp: int) -> bool:
    if cp in (0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0):
        return True
    return 0x200B <= cp <= 0x200F or 0x202A <= cp <= 0x202E or 0x2060 <= cp <= 0x206F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE007F or 0xE0100 <= cp <= 0xE01EF or cp == 0x061C


def _plain(cp: int) -> str | None:
    """What a width, style, ligature or space variant stands for; None for any other character."""
    c = chr(cp)
    cat = unicodedata.category(c)
    if cat == "Zs" and cp not in (0x20, 0x1680):
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    d = unicodedata.decomposition(c)
    if not d.startswith("<"):
        return None
    kind = d[1 : d.index(">")]
    if kind in ("font", "wide", "narrow") and cat[0] in "LN":
        return unicodedata.normalize("NFKC", c)
    if kind in ("initial", "medial", "final", "isolated") and cat[0] == "L":
        return unicodedata.normalize("NFKC", c)
    if kind == "compat" and cat[0] == "L" and cp not in (0x00B5, 0x0E33, 0x0EB3, 0x0E33) and (0x0130 < cp < 0x0200 or 0xFB00 <= cp <= 0xFB4F):
        return unicodedata.normalize("NFKC", c)
    return None


_PLAIN = {cp: p for cp in [*range(0x80, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1EF00)] if not 0xD800 <= cp < 0xE000 and (p := _plain(cp)) is not None}


def _ranges(points) -> str:
    out, points = [], sorted(points)
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


_NFC_STARTS = [cp for cp in range(0x80, 0x30000) if not 0xD800 <= cp < 0xE000 and (unicodedata.combining(chr(cp)) or not unicodedata.is_normalized("NFC", chr(cp)) or 0x1160 <= cp <= 0x11FF)]
_HIDDEN = {cp for cp in [*range(0x80, 0x10000), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)] if _invisible(cp)}
#: Any character that may have to change; a text without one is already in the consistent form.
_SUSPECT = re.compile("[" + _ranges({*_PLAIN, *_HIDDEN, *_NFC_STARTS, *map(ord, LOOKALIKE)}) + "]")
_COMPOSE = re.compile("[" + _ranges(_NFC_STARTS) + "]")
_HIDE = re.compile("[" + _ranges(_HIDDEN) + "]")
_ALIKE = re.compile("[" + "".join(LOOKALIKE) + "]")


@lru_cache(maxsize=65536)
def char_scripts(c: str) -> frozenset[str] | None:
    """Scripts in which a letter is used; None if it goes with any script."""
    if c.isascii():
        return frozenset(("Latn",)) if c.isalpha() else None
    if _NEUTRAL.match(c):
        return None
    found = frozenset(s for s, p in _SCX if p.match(c))
    if not found:  # any other script by the first word of the character's name
        found = frozenset((unicodedata.name(c, "unnamed").split()[0],))
    return found | frozenset(x for s in found for x in _WRITTEN_WITH.get(s, ()))


def resolved(token: str) -> frozenset[str] | None:
    """Intersection of the script sets of a token's letters; None if any script will do."""
    out = None
    for c in token:
        s = char_scripts(c)
        if s is not None:
            out = s if out is None else out & s
    return out


@lru_cache(maxsize=65536)
def spelled(token: str) -> tuple[str, str]:
    """(kind, spelling) of a token with a look-alike letter.

    ``mixed``: to be written as ``spelling``; ``whole``: ``spelling`` if it isn't really a word
    of the other script; ``keep``: as it is.
    """
    if _PHONETIC.search(token):
        return "keep", token
    base = unicodedata.normalize("NFD", token)
    scripts = resolved(token)
    foreign = [c for c in base if c in LOOKALIKE or (not c.isascii() and c.isalpha() and char_scripts(c) not in (None, frozenset(("Latn",))))]
    if all(c in LOOKALIKE for c in foreign):
        latin = unicodedata.normalize("NFC", "".join(LOOKALIKE.get(c, c) for c in base))
        if not scripts or "Latn" in scripts:
            return "mixed", latin
        if len(token) == 1 and token in _GREEK_SIGNS:
            return "keep", token
        return "whole", latin
    if not scripts:  # some letters exist in the other script only: spell the whole token in it
        for s, back in _BACK.items():
            if all(char_scripts(c) is None or s in char_scripts(c) or c in back for c in base):
                return "mixed", unicodedata.normalize("NFC", "".join(back.get(c, c) if c.isascii() else c for c in base))
    return "keep", token


@lru_cache(maxsize=65536)
def _really(token: str, script: str) -> bool:
    """Is the token of the script, with a letter that no Latin letter looks like?"""
    s = resolved(token)
    return bool(s) and script in s and any(c not in LOOKALIKE and c.isalpha() for c in token)


_SENTENCE = re.compile(r"[.!?…\n]")


class _Context:
    """Which words of a text are really of a script, and where its sentences are."""

    def __init__(self, text: str, words: list):
        self.words = [m.group() for m in words]
        ends = [m.start() for m in _SENTENCE.finditer(text)]
        self.sentence = [bisect.bisect(ends, m.start()) for m in words]

    def latin(self, k: int) -> bool:
        """A Latin word: all letters are, and it isn't made of look-alikes only."""
        w = self.words[k]
        return w.isascii() or "Latn" in (resolved(w) or ())

    def kept(self, k: int, script: str) -> bool:
        for step in (-1, 1):
            i = k + step
            while 0 <= i < len(self.words) and self.sentence[i] == self.sentence[k] and not self.latin(i):
                if _really(self.words[i], script):
                    return True
                i += step
        lo, hi = bisect.bisect_left(self.sentence, self.sentence[k]), bisect.bisect_right(self.sentence, self.sentence[k])
        for span in (range(lo, hi), range(len(self.words))):
            real = sum(_really(self.words[i], script) for i in span)
            latin = sum(self.latin(i) for i in span)
            if real or latin:
                return real > latin
        return False


def _respell(text: str) -> str:
    words = list(_WORD.finditer(text))
    out, at = [], 0
    turkish = context = None
    for k, m in enumerate(words):
        w = m.group()
        if w.isascii() or not _ALIKE.search(w):
            continue
        kind, new = spelled(w)
        if kind == "keep" or new == w:
            continue
        if kind == "whole":
            context = context or _Context(text, words)
            if context.kept(k, _SCRIPT[next(c for c in w if c in _SCRIPT)]):
                continue
        if "ı" in w:
            if turkish is None:
                turkish = bool(_TURKISH.search(text))
            if turkish:
                continue
        out.append(text[at : m.start()])
        out.append(new)
        at = m.end()
    if not out:
        return text
    out.append(text[at:])
    return "".join(out)


def _needed(text: str, i: int) -> bool:
    cp = ord(text[i])
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if 0xFE00 <= cp <= 0xFE0F:
        return bool(before) and bool(_PICTURE.match(before)) and not before.isalpha()
    if 0xE0100 <= cp <= 0xE01EF:
        return bool(before) and "CJK" in unicodedata.name(before, "")
    if 0xE0000 <= cp <= 0xE007F:  # tags spell out a flag
        return before == "\U0001f3f4" or (bool(before) and 0xE0020 <= ord(before) <= 0xE007E)
    if cp in _TURNS:
        if before and after and _JOINING.match(before) and _JOINING.match(after):
            return True
        return cp == 0x200D and bool(before and after and _PICTURE.match(before) and _PICTURE.match(after)) and not after.isdigit()
    if cp in _MARKS:
        near = text[max(0, i - 3) : i].rstrip()[-1:], text[i + 1 : i + 4].lstrip()[:1]
        return any(x and _RTL.match(x) for x in near)
    return False


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; visibly different text stays different."""
    if text is None or text.isascii() or not _SUSPECT.search(text):
        return text
    if _HIDE.search(text):
        src = text
        text = _HIDE.sub(lambda m: m.group() if _needed(src, m.start()) else "", src)
    text = text.translate(_PLAIN)
    if _COMPOSE.search(text):
        text = unicodedata.normalize("NFC", text)
    if _ALIKE.search(text):
        text = _respell(text)
    return text


@F.pandas_udf(StringType())
def canonical_udf(s):
    return s.map(canonical, na_action="ignore")


def canonical_column(col: Column | str) -> Column:
    """The column in consistent form, for any plan."""
    return canonical_udf(F.col(col) if isinstance(col, str) else col)


_NOT_ASCII = r"[^\x00-\x7F]"


def _changes(id_col: str, columns: list[str]):
    schema = pa.schema([(id_col, pa.int64()), *((f"{c}_clean", pa.string()) for c in columns)])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            cols = [b.column(i + 1).to_pylist() for i in range(len(columns))]
            new = [[canonical(x) for x in c] for c in cols]
            keep = [i for i in range(len(ids)) if any(n[i] != c[i] for n, c in zip(new, cols))]
            data = [[ids[i] for i in keep], *([n[i] for i in keep] for n in new)]
            yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, schema)], schema=schema)

    return run


def changed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``<text_col>_clean`` of the records whose text had to change.

    ASCII texts are sifted out in the scan; only the others reach Python.
    """
    rest = df.select(F.col(id_col).cast("bigint").alias(id_col), text_col).filter(F.col(text_col).rlike(_NOT_ASCII))
    return rest.mapInArrow(_changes(id_col, [text_col]), f"`{id_col}` bigint, `{text_col}_clean` string")


def clean_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its text in consistent form; all rows and columns are kept."""
    plain = df.filter(F.col(text_col).isNull() | ~F.col(text_col).rlike(_NOT_ASCII))
    rest = df.filter(F.col(text_col).rlike(_NOT_ASCII)).withColumn(text_col, canonical_column(text_col))
    return plain.union(rest.select(*(F.col(f"`{c}`") for c in plain.columns)))


def clean_lexicon(df: DataFrame) -> DataFrame:
    """``entry_id, form, heads, changed``: the lexicon in consistent form, heads in order."""

    def run(batches):
        schema = pa.schema([("entry_id", pa.int64()), ("form", pa.string()), ("heads", pa.list_(pa.string())), ("changed", pa.bool_())])
        for b in batches:
            ids, forms, heads = (b.column(i).to_pylist() for i in range(3))
            f2 = [canonical(x) for x in forms]
            h2 = [None if h is None else [canonical(x) for x in h] for h in heads]
            ch = [a != x or y != z for a, x, y, z in zip(forms, f2, heads, h2)]
            yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip([ids, f2, h2, ch], schema)], schema=schema)

    return df.select(F.col("entry_id").cast("bigint"), "form", "heads").mapInArrow(
        run, "entry_id bigint, form string, heads array<string>, changed boolean"
    )


def form_to_heads(lexicon: DataFrame) -> DataFrame:
    """``form, heads, n_entries``: the cleaned lexicon as one map. Entries of one form are merged, its distinct heads in the order
    of the first entry that has them; null forms and heads are left out. Heads are made distinct before a form's are gathered."""
    named = lexicon.filter("form is not null")
    each = named.select("form", "entry_id", F.posexplode("heads").alias("at", "head")).filter("head is not null")
    first = each.groupBy("form", "head").agg(F.min(F.struct("entry_id", "at")).alias("o"))
    heads = first.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("o.entry_id", "o.at", "head"))).alias("l"))
    counts = named.groupBy("form").agg(F.count("*").alias("n_entries"))
    found = F.coalesce(F.transform("l", lambda x: x["head"]), F.array().cast("array<string>"))
    return counts.join(heads, "form", "left").select("form", found.alias("heads"), "n_entries")
