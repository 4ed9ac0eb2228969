"""Token and spelling expressions; all are native columns but for Unicode compatibility forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The lexical token pattern and the wider word pattern of the length check.
TOKEN = "[A-Za-z]+(?:'[A-Za-z]+)?"
WORD_COUNT = "[A-Za-z]+(?:['’][A-Za-z]+)?"
# A form that can be looked up in the exposure table.
LOOKUP = r"^'?\p{L}+(?:['-]\p{L}+)*$"
LOOKUP_MAX = 64
# Derivational suffixes, first match wins.
SUFFIXES = "ization isation ational fulness iveness ability ibility ments ness ment tion sion able ible ally ing ed er est ly ity ize ise ive ous less ful al".split()
# Part-of-speech names.
POS_ALIASES = {
    "n": "n", "noun": "n", "v": "v", "verb": "v", "a": "a", "adj": "a", "adjective": "a", "s": "a", "r": "r", "adv": "r", "adverb": "r",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surfaces(text: Column | str) -> Column:
    """Tokens of a text in their own spelling; an empty array where there is none."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_array(text: Column | str) -> Column:
    return F.transform(surfaces(text), F.lower)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, surface, token``: one row per token, ``pos`` from 1.

    The texts are distributed by ``key`` before they are taken apart, so every later group or
    window on ``key`` (and more) needs no further shuffle.
    """
    docs = docs.select(key, text).filter(F.col(text).isNotNull()).repartition(key)
    each = docs.select(key, F.posexplode(surfaces(text)).alias("at", "surface"))
    return each.select(key, (F.col("at") + 1).cast("bigint").alias("pos"), "surface", F.lower("surface").alias("token"))


def level_of(rank: Column | str) -> Column:
    """Band of a thousand ranks; null stays null."""
    return F.expr("int((__r - 1) div 1000) + 1".replace("__r", f"({rank})")) if isinstance(rank, str) else (F.floor((rank - 1) / 1000) + 1).cast("int")


def flemma_form(c: Column | str) -> Column:
    """Trimmed, lower case, one apostrophe sign."""
    return F.translate(F.lower(F.trim(_col(c))), "’ʼ", "''")


@F.pandas_udf(StringType())
def _lemma_key(s):
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).strip().casefold().replace("_", " ").split()), na_action="ignore")


def lemma_key(c: Column | str) -> Column:
    """Compatibility form, case-folded, underscores and space runs as one space."""
    return _lemma_key(_col(c))


def pos_key(c: Column | str) -> Column:
    """One of n, v, a, r; any other name is an error."""
    low = F.lower(F.trim(_col(c)))
    pairs = F.create_map(*(F.lit(x) for kv in POS_ALIASES.items() for x in kv))
    return F.when(low.isNull(), F.lit(None)).otherwise(F.coalesce(pairs[low], F.raise_error(F.concat(F.lit("unknown part of speech: "), low)).cast("string")))


@F.pandas_udf(StringType())
def _nfkc(s):
    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def _odd_texts(df: DataFrame, text: str, change) -> DataFrame:
    odd = F.col(text).rlike(r"[^\x00-\x7F]")
    plain = df.filter(F.col(text).isNull() | ~odd)
    return plain.unionByName(df.filter(odd).withColumn(text, change(text)))


def compatible_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its text in compatibility form; only non-ASCII texts leave the JVM."""
    return _odd_texts(df, text, _nfkc)


@F.pandas_udf(StringType())
def _nfc(s):
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


_nfc = _nfc.asNondeterministic()  # else the planner repeats it for every use of the text


def composed_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its text in composed form (NFC); only non-ASCII texts leave the JVM."""
    return _odd_texts(df, text, _nfc)


def exposure_text(c: Column | str) -> Column:
    """Lower case with one apostrophe sign (of a text already in compatibility form)."""
    return F.lower(F.translate(_col(c), "ʼ‘’‛", "''''"))


def is_lookup_form(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(LOOKUP) & (F.length(_col(c)) <= LOOKUP_MAX) & (_col(c) == F.lower(_col(c))), F.lit(False))


def word_split(c: Column | str) -> Column:
    """Words of a text by the published Penn Treebank conventions, kept where they can be looked up.

    Sentence-final periods go, clitics (n't 's 'm 'd 'll 're 've) and the fixed contractions are
    split off, hyphens and inner apostrophes stay.
    """
    s = exposure_text(c)
    s = F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}'.\-\s]|--+", " ")
    s = F.regexp_replace(s, r"\.(?=[\s']|$)", " ")
    s = F.regexp_replace(s, r"(?<=[^\s'])(n't)(?=[\s]|$)", " $1")
    s = F.regexp_replace(s, r"(?<=[^\s'])('(?:s|m|d|ll|re|ve))(?=\s|$)", " $1")
    s = F.regexp_replace(s, r"(?<=[^\s'])'(?=\s|$)", " ")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(can)(not)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(gon|wan)(na)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(got)(ta)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(gim|lem)(me)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(d)('ye)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])(more)('n)(?![\p{L}'\-])", "$1 $2")
    s = F.regexp_replace(s, r"(?<![\p{L}'\-])('t)(is|was)(?![\p{L}'\-])", "$1 $2")
    return F.filter(F.split(F.trim(s), r"\s+"), is_lookup_form)


def suffix_of(c: Column | str) -> Column:
    """First suffix of the list that ends a form of five letters or more."""
    low = F.lower(_col(c))
    hit = F.coalesce(*(F.when(low.endswith(s), F.lit(s)) for s in SUFFIXES))
    return F.when(F.length(low) >= 5, hit)


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}]", "")


def is_uppercase(c: Column | str) -> Column:
    x = _letters(_col(c))
    return (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))


def is_capitalized(c: Column | str) -> Column:
    x = _letters(_col(c))
    first = F.substring(x, 1, 1)
    return (F.length(x) > 1) & (first == F.upper(first)) & (first != F.lower(first)) & ~(x == F.upper(x))


def clean_double(c: Column | str) -> Column:
    """NaN as null."""
    return F.when(F.isnan(_col(c)), F.lit(None)).otherwise(_col(c))


def canonical_double(c: Column | str) -> Column:
    """NaN as null, infinities refused, twelve decimals half-even, no negative zero."""
    x = clean_double(c)
    bad = F.abs(x) == F.lit(float("inf"))
    y = F.bround(x, 12)
    return F.when(bad, F.raise_error(F.lit("infinite value")).cast("double")).when(y == 0, F.lit(0.0)).otherwise(y)
