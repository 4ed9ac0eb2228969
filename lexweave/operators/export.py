"""Result tables and files: summaries, descriptives, long forms, JSON, artifacts, and the privacy check."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexweave.config import AnalysisConfig
from lexweave.functions.text import canonical_double

#: Field names that would carry text or tokens out of an analysis.
PRIVATE = ("a_tokens", "raw_tokens", "raw_surfaces", "text")


def private_fields(kind: DataType, path: str = "") -> list[str]:
    """Paths of fields that must not leave: the private names and any that begin with an underscore."""
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            here = f"{path}.{f.name}".lstrip(".")
            if f.name in PRIVATE or f.name.startswith("_"):
                out.append(here)
            out += private_fields(f.dataType, here)
        return out
    if isinstance(kind, ArrayType):
        return private_fields(kind.elementType, path)
    if isinstance(kind, MapType):
        return private_fields(kind.valueType, path)
    return []


def assert_private(df: DataFrame) -> DataFrame:
    if found := private_fields(df.schema):
        raise ValueError(f"private fields in an output: {found}")
    return df


def summary(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per key; the first part decides which keys there are."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def descriptives(wide: DataFrame, measures: list[str]) -> DataFrame:
    """Per measure: n, missing, mean, sd (null under two values), and the interpolated quartiles."""
    rows = wide.select(*(F.col(m).cast("double").alias(m) for m in measures)).unpivot([], measures, "measure", "value").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = rows.groupBy("measure").agg(F.count("value").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return agg.select("measure", "n", "missing", "mean", "sd", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def threshold_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    text = F.when(F.col("level").isNull(), "not reached by selected list").otherwise(F.concat(F.lit("K"), F.col("level").cast("string")))
    return found.select(*keys, "threshold", text.alias("reached"))


def fit_rows(p_lex: DataFrame, s: DataFrame, keys: list[str]) -> DataFrame:
    """Four rows per key: rate, segments, fitted rank, whether it is capped."""
    both = p_lex.join(s, keys, "left")
    each = F.array(
        F.struct(F.lit("P_Lex lambda").alias("measure"), F.col("lambda").alias("value"), F.lit("").alias("note")),
        F.struct(F.lit("P_Lex segments").alias("measure"), F.col("n_segments").cast("double").alias("value"), F.lit("whole segments").alias("note")),
        F.struct(F.lit("S").alias("measure"), F.col("s").alias("value"), F.when(F.col("s").isNull(), "too few tokens").otherwise("").alias("note")),
        F.struct(F.lit("S capped").alias("measure"), F.col("capped").cast("double").alias("value"), F.when(F.col("capped"), "not interpretable").otherwise("").alias("note")),
    )
    return both.select(*keys, F.inline(each))


def metadata(keys_frame: DataFrame, config: AnalysisConfig, version: str = "1") -> DataFrame:
    """Per key one row per setting and note, values as JSON."""
    pairs = [("version", version), *config.items(), *((f"note_{i + 1}", n) for i, n in enumerate(config.notes()))]
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(json.dumps(v, ensure_ascii=False)).alias("value")) for k, v in pairs))
    return keys_frame.select("*", F.inline(each))


def canonical(df: DataFrame) -> DataFrame:
    """All doubles in canonical form."""
    return df.select(*(canonical_double(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def payload(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: each row as a JSON object, nulls written out, doubles canonical; made where the rows are."""
    x = canonical(assert_private(df))
    body = F.to_json(F.struct(*x.columns), {"ignoreNullFields": "false"})
    return x.select(*keys, body.alias("json"))


def pretty(text: str) -> str:
    """A payload as indented text with a final newline."""
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n"


def fingerprint(df: DataFrame, *cols: str) -> Column | DataFrame:
    """One row ``rows, fingerprint``: independent of row order and partitioning, repeated rows count.

    Each row's SHA-256 is cut into four words that are added up modulo 2**64, so the content is
    never gathered in one place.
    """
    cols = cols or tuple(df.columns)
    h = F.sha2(F.to_json(F.struct(*(F.col(c) for c in cols)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.select(*(w.alias(f"w{i}") for i, w in enumerate(words))).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(8)))
    return sums.select("rows", F.sha2(F.concat_ws("-", "rows", *(F.col(f"w{i}").cast("string") for i in range(8))), 256).alias("fingerprint"))


def write_artifact(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """A sorted gz-CSV table. Range-partitioned files by default; one file where a consumer needs it and the table is small."""
    out = df.coalesce(1).sortWithinPartitions(*order) if single_file else df.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575


def sheets(tables: dict[str, DataFrame], path: str | None = None) -> dict[str, DataFrame]:
    """The sheets of a workbook as frames, checked; written as an XLSX file only where the writer is installed.
    A table that does not fit a sheet is an error: nothing is written, and no row is left out."""
    for t in tables.values():
        assert_private(t)
    if path is not None:
        import importlib.util

        for name, t in tables.items():
            if t.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
                raise ValueError(f"table {name} has more than {SHEET_ROWS} rows and does not fit a sheet; use the frames")
        if importlib.util.find_spec("openpyxl") is None:
            raise RuntimeError("openpyxl is not installed; use the frames")
        import pandas as pd

        with pd.ExcelWriter(path) as w:
            for name, t in tables.items():
                t.toPandas().to_excel(w, sheet_name=name[:31], index=False)
    return tables
