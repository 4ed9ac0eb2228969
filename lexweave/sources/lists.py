"""Readers of word lists, lexical graphs and reference tables: files to frames with fixed schemas.

Lists come as ``form, head, rank, level``. Where an order decides (first occurrence wins), it is
the order of lines in the file and of the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions.normalizers import first_row


def _level(c: str = "rank") -> Column:
    return (F.floor((F.col(c) - 1) / 1000) + 1).cast("int")


def _lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, line_no, line`` of small text files (each is read whole, so its lines keep their order)."""
    t = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file"), "value")
    return t.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))


def _first_wins(df: DataFrame, order: list[str]) -> DataFrame:
    return first_row(df, ["form"], order).select("form", "head", F.col("rank").cast("int"), _level().alias("level"))


def ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``rank,word`` or ``rank,"word (variant, variant)"``; others are skipped; variants share the rank."""
    rows = _lines(spark, path).select("file", "line_no", F.from_csv("line", F.lit("r string, w string")).alias("x")).filter(F.trim("x.r").rlike("^[0-9]+$") & F.col("x.w").isNotNull())
    w = F.lower(F.trim("x.w"))
    head = F.trim(F.regexp_extract(w, r"^([^(]*)", 1))
    inside = F.regexp_extract(w, r"\(([^)]*)\)", 1)
    forms = F.filter(F.concat(F.array(head), F.split(inside, r"[,\s]+")), lambda f: f != "")
    each = rows.select("file", "line_no", F.trim("x.r").cast("int").alias("rank"), F.posexplode(forms).alias("k", "form"))
    return _first_wins(each.withColumn("head", F.col("form")), ["file", "line_no", "k"])


def ranked_with_forms(spark: SparkSession, stats_path: str, forms_path: str | None = None, lemma: str = "Lemma", rank: str = "SFI Rank") -> DataFrame:
    """A statistics CSV with lemma and rank columns, and rows ``head,form,...`` that add forms to ranked heads."""
    s = spark.read.option("header", True).option("comment", "#").csv(stats_path).select(F.lower(F.trim(F.col(f"`{lemma}`"))).alias("head"), F.trim(F.col(f"`{rank}`")).alias("r"))
    ranked = s.filter(F.col("r").rlike("^[0-9]+$") & (F.col("head") != "")).groupBy("head").agg(F.min(F.col("r").cast("int")).alias("rank"))
    own = ranked.select(F.col("head").alias("form"), "head", "rank", F.lit(-1).alias("line_no"), F.lit(0).alias("k"))
    if forms_path is not None:
        f = _lines(spark, forms_path).filter(~F.col("line").startswith("##")).select("line_no", F.split(F.lower("line"), ",").alias("c"))
        each = f.select(F.trim(F.col("c")[0]).alias("head"), "line_no", F.posexplode(F.slice("c", 2, 10_000)).alias("k", "form")).withColumn("form", F.trim("form")).filter("form <> ''")
        own = own.unionByName(each.join(ranked, "head").select("form", "head", "rank", "line_no", "k"))
    return _first_wins(own, ["line_no", "k", "rank", "head"])


def headword_bands(spark: SparkSession, path: str) -> DataFrame:
    """Files ``... 1st 1000.txt``: the band is the number in the name, the rank the physical line within it."""
    rows = _lines(spark, path, "*.txt").withColumn("band", F.regexp_extract("file", r"(\d+)(?:st|nd|rd|th)", 1)).filter("band <> ''").withColumn("form", F.lower(F.trim("line"))).filter("form <> ''")
    return _first_wins(rows.select("form", F.col("form").alias("head"), ((F.col("band").cast("int") - 1) * 1000 + F.col("line_no") + 1).alias("rank"), "band", "line_no"), ["rank"])


def family_table(df: DataFrame, order: str) -> DataFrame:
    """Columns found by prefix (List, Headword, Related, Total); list ``3k``, related ``word (n), word (n)``; rank clamps within its thousand."""
    pick = lambda p: next((c for c in df.columns if c.strip().lower().startswith(p)), None)
    names = {p: pick(p) for p in ("list", "headword", "related", "total")}
    if any(names[p] is None for p in ("list", "headword", "related")):
        raise ValueError("List, Headword and Related columns are needed")
    k = F.lower(F.trim(F.col(f"`{names['list']}`")))
    rows = df.filter(k.rlike("^[0-9]+k$")).select(F.regexp_extract(k, r"^(\d+)k$", 1).cast("int").alias("level"), F.lower(F.trim(F.col(f"`{names['headword']}`"))).alias("head"), F.coalesce(F.col(f"`{names['related']}`"), F.lit("")).alias("related"), F.col(order).alias("ord"))
    n = F.least(F.row_number().over(W.partitionBy("level").orderBy("ord")), F.lit(1000))
    ranked = rows.withColumn("rank", (F.col("level") - 1) * 1000 + n)
    forms = F.filter(F.concat(F.array("head"), F.transform(F.regexp_extract_all(F.lower("related"), F.lit(r"([a-z'\-]+)\s*\("), F.lit(1)), F.trim)), lambda f: f != "")
    each = ranked.select("head", "rank", "ord", F.posexplode(forms).alias("k", "form"))
    return _first_wins(each, ["rank", "ord", "k"])


def collisions(listed_forms: DataFrame) -> DataFrame:
    """Forms that several heads claim (before the first one wins)."""
    return listed_forms.groupBy("form").agg(F.count_distinct("head").alias("heads")).filter("heads > 1")


def baseword_files(spark: SparkSession, path: str) -> DataFrame:
    """Family files: an unindented word opens a family, indented ones are members (a leading one opens its own).

    The level is the place of the file in the order of the numbers in the names; ranks clamp
    within a thousand; first occurrence wins.
    """
    raw = _lines(spark, path).withColumn("num", F.coalesce(F.nullif(F.regexp_extract(F.lower("file"), r"basewrd(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("file", r"^(\d+)", 1), F.lit(""))).cast("int"))
    words = raw.withColumn("word", F.lower(F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z']*)", 1))).filter("word <> ''")
    order = words.select("file", "num").distinct().withColumn("level", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("num").asc_nulls_last(), "file")))
    x = words.join(F.broadcast(order.select("file", "level")), "file")
    w = W.partitionBy("file").orderBy("line_no")
    opens = ~F.col("line").rlike(r"^\s") | (F.row_number().over(w) == 1)
    x = x.withColumn("opens", opens)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("head", F.last(F.when(F.col("opens"), F.col("word")), True).over(upto)).withColumn("n", F.sum(F.col("opens").cast("int")).over(upto))
    rank = (F.col("level") - 1) * 1000 + F.least(F.col("n"), F.lit(1000))
    return _first_wins(x.select(F.col("word").alias("form"), "head", rank.alias("rank"), "level", "line_no"), ["level", "line_no"])


def family_index(spark: SparkSession, path: str, bands: int = 25) -> DataFrame:
    """``form, head, rank, band, family_ordinal`` of exactly ``bands`` band files; tab-led lines are members, a trailing `` 0`` goes."""
    raw = _lines(spark, path).withColumn("band", F.regexp_extract(F.lower("file"), r"basewrd(\d+)", 1).cast("int")).filter("trim(line) <> ''")
    got = [r[0] for r in raw.select("band").distinct().limit(bands + 1).collect()]
    if sorted(got, key=lambda b: (b is None, b)) != list(range(1, bands + 1)):
        raise ValueError(f"band files 1 to {bands} are needed")
    x = raw.select("band", "line_no", F.col("line").startswith("\t").alias("member"), F.lower(F.regexp_replace(F.trim(F.translate("line", "\t", "")), r"\s+0$", "")).alias("form"))
    w = W.partitionBy("band").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("head", F.last(F.when(~F.col("member"), F.col("form")), True).over(w)).withColumn("family_ordinal", F.sum(F.when(F.col("member"), 0).otherwise(1)).over(w).cast("int"))
    if not x.filter("head is null").isEmpty():
        raise ValueError("a member comes before any head")
    one = first_row(x, ["form"], ["band", "line_no"])
    return one.select("form", "head", ((F.col("band") - 1) * 1000 + F.col("family_ordinal")).alias("rank"), "band", "family_ordinal").orderBy("form")


def index_faults(index: DataFrame, bands: int = 25, per_band: int = 1000) -> DataFrame:
    """One row per broken rule of a family index: ``rule, n``; empty where it is sound."""
    heads = index.filter("form = head")
    per = index.groupBy("band", "family_ordinal").agg(F.count_distinct("head").alias("h"))
    rules = {
        "repeated_form": index.groupBy("form").count().filter("count > 1"),
        "several_heads": per.filter("h > 1"),
        "rank": index.filter(F.col("rank") != (F.col("band") - 1) * 1000 + F.col("family_ordinal")),
        "head_missing": index.join(heads.select("head", "rank").distinct(), ["head", "rank"], "left_anti"),
        "families_in_band": per.groupBy("band").count().filter(F.col("count") != per_band),
        "bands": index.agg(F.count_distinct("band").alias("b")).filter(F.col("b") != bands),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


def wordnet_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes(synset, pos), edges(child, parent), links(lemma, pos, synset)`` of a lexical-markup XML file; streams by element."""
    rel = "SynsetRelation array<struct<_relType: string, _target: string>>"
    syn = spark.read.format("xml").option("rowTag", "Synset").schema(f"_id string, _partOfSpeech string, {rel}").load(path)
    pos = lambda c: F.when(F.col(c) == "s", "a").otherwise(F.col(c))
    nodes = syn.select(F.col("_id").alias("synset"), pos("_partOfSpeech").alias("pos"))
    edges = syn.select(F.col("_id").alias("child"), F.explode("SynsetRelation").alias("r")).filter(F.col("r._relType").isin("hypernym", "instance_hypernym")).select("child", F.col("r._target").alias("parent"))
    ent = spark.read.format("xml").option("rowTag", "LexicalEntry").schema("Lemma struct<_writtenForm: string, _partOfSpeech: string>, Sense array<struct<_synset: string>>").load(path)
    links = ent.select(F.col("Lemma._writtenForm").alias("lemma"), pos("Lemma._partOfSpeech").alias("pos"), F.explode("Sense._synset").alias("synset"))
    return nodes, edges, links


METRICS = "lemma string, pos string, polysemy int, depth_sense_count int, hypernym_depth_min double, hypernym_depth_mean double, hypernym_depth_max double"


def checked_csv(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A CSV table (plain or gz) with exactly the header of the schema and unique keys; anything else is an error."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys {keys}")
    return df


def lemma_metrics(spark: SparkSession, path: str) -> DataFrame:
    return checked_csv(spark, path, METRICS, ["lemma", "pos"])


def exposure_tsv(spark: SparkSession, path: str, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records (typed or with a reason) and the ``[TOTAL]`` row of an unquoted table with a header; xz files are unpacked in the worker."""
    from lexweave.sources import records

    header = ["word", "count", "videos", "channels", *(f"count:{c}" for c in categories)]
    if path.endswith(".xz"):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unpack_xz, "line_no bigint, raw_line string")
    else:
        raw = _lines(spark, path).select(F.col("line_no").cast("bigint"), F.col("line").alias("raw_line"))
    body = raw.filter((F.col("line_no") > 0) & (F.col("raw_line") != "")).select(F.col("line_no").alias("line_id"), F.lit("f").alias("feed_id"), "line_no", "raw_line")
    if raw.filter(F.col("line_no") == 0).filter(F.col("raw_line") == "\t".join(header)).isEmpty():
        raise ValueError("the header is not the expected one")
    feeds = spark.createDataFrame([("f", "\t", "none", header)], "feed_id string, delim string, quote_mode string, header_cols array<string>")
    parsed = records.parse_lines(body, feeds)
    return parsed, parsed.filter("word = '[TOTAL]'")


def _unpack_xz(batches):
    import io
    import lzma

    import pandas as pd

    for pdf in batches:
        for content in pdf["content"]:
            with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", newline="\n") as f:
                chunk, start = [], 0
                for line in f:
                    chunk.append(line.rstrip("\n"))
                    if len(chunk) == 50_000:
                        yield pd.DataFrame({"line_no": range(start, start + len(chunk)), "raw_line": chunk})
                        start, chunk = start + len(chunk), []
                if chunk:
                    yield pd.DataFrame({"line_no": range(start, start + len(chunk)), "raw_line": chunk})


def unsorted_words(table: DataFrame, order: str) -> DataFrame:
    """Rows of an artifact whose word does not follow the one before; empty where it is sorted and unique.

    Neighbours are compared per file stretch of ``order`` values, so no single task sees all rows.
    """
    x = table.select("word", F.col(order).alias("o")).withColumn("part", F.floor(F.col("o") / 100_000))
    inner = x.withColumn("before", F.lag("word").over(W.partitionBy("part").orderBy("o")))
    ends = x.groupBy("part").agg(F.max_by("word", "o").alias("last")).select((F.col("part") + 1).alias("part"), "last")
    joined = inner.join(ends, "part", "left").withColumn("before", F.coalesce("before", "last"))
    return joined.filter(F.col("before") >= F.col("word")).select("o", "before", "word")


class ListCatalog:
    """Lists by name: loaders are called when a list is asked for; a list that may not be used is refused."""

    def __init__(self) -> None:
        self._loaders: dict[str, tuple[Callable[[SparkSession], DataFrame], str, bool]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame], licence: str, usable: bool = True) -> None:
        self._loaders[name] = (loader, licence, usable)

    def names(self) -> list[tuple[str, str, bool]]:
        return [(n, licence, ok) for n, (_, licence, ok) in sorted(self._loaders.items())]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(name)
        loader, _, usable = self._loaders[name]
        if not usable:
            raise PermissionError(f"{name} may not be used here")
        return loader(spark)
