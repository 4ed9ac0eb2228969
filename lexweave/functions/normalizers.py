"""Normalizers: surface forms to heads, as joins on the distinct vocabulary.

Each takes a frame with a ``token`` column of distinct forms and returns ``token, head``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions.text import flemma_form
from lexweave.session import small_or_not

# Irregular forms by head.
IRREGULAR = """
be: am are been being is was were
do: did does done
have: had has
go: went gone
make: made
take: took taken
come: came
see: seen
give: gave given
know: knew known
think: thought
tell: told
become: became
show: shown
feel: felt
bring: brought
begin: began begun
keep: kept
hold: held
write: wrote written
stand: stood
hear: heard
mean: meant
meet: met
run: ran
pay: paid
sit: sat
speak: spoken
lead: led
grow: grew grown
lose: lost
fall: fallen
send: sent
build: built
understand: understood
draw: drew drawn
break: broke broken
spend: spent
rise: risen
drive: drove driven
buy: bought
wear: wore worn
choose: chose chosen
swim: swam swum
drink: drank drunk
eat: ate eaten
forget: forgot forgotten
fly: flew flown
throw: threw thrown
win: won
teach: taught
catch: caught
sleep: slept
sell: sold
say: said
child: children
foot: feet
goose: geese
man: men
mouse: mice
tooth: teeth
woman: women
analysis: analyses
crisis: crises
criterion: criteria
phenomenon: phenomena
thesis: theses
good: best better
bad: worse worst
"""
# Forms with several heads, kept as they are; singular words in -s; bases of contractions in 's.
AMBIGUOUS = "axes bore bound fell found lay left leaves people rose saw spoke wound".split()
SINGULAR_S = "as bias bus canvas chaos cosmos gas lens news offs physics politics series species status this thus".split()
CONTRACTED = "he here how it she that there this what when where who why".split()


def irregular_pairs() -> list[tuple[str, str]]:
    out = [(f, f) for f in AMBIGUOUS]
    for line in IRREGULAR.strip().splitlines():
        head, forms = line.split(": ")
        out += [(f, head) for f in forms.split()]
    return out


def word_form(vocab: DataFrame) -> DataFrame:
    return vocab.select("token", F.lower("token").alias("head"))


def static_map(vocab: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """``pairs(form, head, order)``: the last mapping of a form wins; other forms stay."""
    last = pairs.groupBy(F.lower("form").alias("token")).agg(F.max_by("head", order).alias("to"))
    return vocab.join(small_or_not(last), "token", "left").select("token", F.coalesce("to", "token").alias("head"))


def lexicon(entries: DataFrame) -> DataFrame:
    """``form, heads`` of a form-to-heads table: one row per form, all its heads, sorted."""
    one = entries.select(flemma_form("form").alias("form"), F.explode("heads").alias("h")).select("form", flemma_form("h").alias("h"))
    good = one.filter("form is not null and form <> '' and h is not null and h <> ''")
    return good.groupBy("form").agg(F.sort_array(F.collect_set("h")).alias("heads"))


def candidates(word: Column | str) -> Column:
    """Ordered spelling candidates of an inflected form; none is chosen here."""
    w = F.col(word) if isinstance(word, str) else word
    n = F.length(w)

    def cut(k: int, add: str = "") -> Column:
        s = F.substring(w, F.lit(1), n - k)
        return F.concat(s, F.lit(add)) if add else s

    def undoubled(k: int) -> Column:
        """The stem without its doubled final consonant, or null."""
        s = cut(k)
        a, b = F.substring(s, F.length(s), F.lit(1)), F.substring(s, F.length(s) - 1, F.lit(1))
        return F.when((F.length(s) >= 4) & (a == b) & ~a.isin(*"aeiou"), cut(k + 1))

    rules = []

    def rule(suffix: str, longer: int, *forms: Column, also: Column | None = None) -> None:
        ok = w.endswith(suffix) & (n > longer)
        ok = ok & also if also is not None else ok
        rules.extend(F.when(ok, f) for f in forms)

    rule("ies", 4, cut(3, "y"), cut(1))
    rule("ves", 4, cut(3, "f"), cut(3, "fe"), cut(1))
    rule("es", 3, cut(2), cut(1))
    rule("s", 3, cut(1), also=~w.rlike("(?:ss|us|is)$") & ~w.isin(*SINGULAR_S))
    rule("ied", 4, cut(3, "y"))
    rule("ed", 4, cut(2), cut(1), undoubled(2))
    rule("ying", 5, cut(4, "ie"))
    rule("ing", 5, cut(3), cut(3, "e"), undoubled(3))
    rule("ier", 4, cut(3, "y"))
    rule("iest", 5, cut(4, "y"))
    rule("er", 4, undoubled(2), cut(2, "e"))
    rule("est", 5, undoubled(3), cut(3, "e"))
    kept = F.array_distinct(F.filter(F.array(*rules), lambda x: x.isNotNull() & (F.length(x) >= 2)))
    return F.when((n < 3) | w.contains("'"), F.array().cast("array<string>")).otherwise(kept)


def flemma(vocab: DataFrame, entries: DataFrame | None = None, extra_heads: DataFrame | None = None) -> DataFrame:
    """``token, head`` by precedence: irregular, form table, possessive, known head, the one valid candidate, surface.

    ``entries(form, heads)`` is a form-to-heads table, ``extra_heads(head)`` further known heads.
    Only the distinct vocabulary is looked up; large head lists fall back to shuffled joins.
    """
    spark = vocab.sparkSession
    irregular = spark.createDataFrame(irregular_pairs(), "word string, irregular string")
    table = lexicon(entries) if entries is not None else spark.createDataFrame([], "form string, heads array<string>")
    heads = table.select(F.explode("heads").alias("head"))
    if extra_heads is not None:
        heads = heads.union(extra_heads.select(flemma_form("head")).filter("head is not null and head <> ''"))
    heads, table = small_or_not(heads.distinct()), small_or_not(table)

    def resolve(frame: DataFrame, possessive: bool) -> DataFrame:
        """``token, word`` to ``token, word, head, known``; possessives only where asked for."""
        f = frame.join(F.broadcast(irregular), "word", "left").join(table.withColumnRenamed("form", "word"), "word", "left")
        f = f.join(heads.select(F.col("head").alias("word"), F.lit(True).alias("known")), "word", "left")
        rules = candidates("word")
        if possessive:
            base = F.expr("substring(word, 1, length(word) - 2)")
            ok = F.col("word").endswith("'s") & (F.length("word") > 3) & ~base.isin(*CONTRACTED)
            rules = F.concat(rules, F.when(ok, F.array(base)).otherwise(F.array().cast("array<string>")))
        each = f.filter("irregular is null and heads is null and known is null").select("token", F.explode(rules).alias("head")).distinct()
        valid = each.join(heads, "head", "left_semi")
        if possessive:
            plural = frame.filter("word like '%s''' and length(word) > 3").select("token", F.expr("substring(word, 1, length(word) - 1)").alias("word"))
            inner = resolve(plural, False).filter("head <> word or known")
            valid = valid.select("token", "head").unionByName(inner.select("token", "head")).distinct()
        single = valid.groupBy("token").agg(F.count("*").alias("k"), F.first("head").alias("one")).filter("k = 1")
        out = f.join(single, "token", "left")
        head = (
            F.when(F.col("irregular").isNotNull(), F.col("irregular"))
            .when(F.col("heads").isNotNull(), F.when(F.size("heads") == 1, F.col("heads")[0]).otherwise(F.col("word")))
            .when(F.col("known"), F.col("word"))
            .otherwise(F.coalesce("one", "word"))
        )
        final = out.select("token", "word", head.alias("head"))
        return final.join(heads.select("head", F.lit(True).alias("known")), "head", "left").select("token", "word", "head", F.coalesce("known", F.lit(False)).alias("known"))

    return resolve(vocab.select("token", flemma_form("token").alias("word")).distinct(), True).select("token", "head")


def simple_lemmatizer() -> Callable[[DataFrame], DataFrame] | None:
    """A third-party lemmatizer where it is installed, else None."""
    try:
        import simplemma
    except ImportError:
        return None
    from pyspark.sql.types import StringType

    lemma = F.pandas_udf(lambda s: s.map(lambda x: simplemma.lemmatize(x, lang="en") or x, na_action="ignore"), StringType())
    return lambda vocab: vocab.select("token", F.coalesce(lemma("token"), "token").alias("head"))


def normalizer(name: str, **tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """By name: ``flemma`` (entries, extra_heads), ``static`` (pairs), ``surface`` / ``word_form``, ``simplemma``."""
    low = name.strip().lower().replace("-", "_")
    if low in ("flemma", "open_flemma", "project_flemma"):
        return lambda v: flemma(v, tables.get("entries"), tables.get("extra_heads"))
    if low in ("surface", "surface_form", "word_form"):
        return word_form
    if low in ("static", "antbnc"):
        return lambda v: static_map(v, tables["pairs"], tables.get("order", "order"))
    if low == "simplemma" and (f := simple_lemmatizer()):
        return f
    raise ValueError(f"unknown or missing normalizer: {name}")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
