"""Text files and archives as document tables, with limits that are checked before anything is unpacked."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArchiveLimits:
    members: int = 1000
    member_bytes: int = 5_000_000
    total_bytes: int = 50_000_000
    ratio: float = 200.0


def text_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """``name, n_bytes, text, warning``: one row per file; only ``.txt`` gives text, invalid UTF-8 becomes the replacement sign.

    Same names get `` (2)``, `` (3)`` in order of their paths.
    """
    from pyspark.sql import Window as W

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.select("path", "length", "content", name.alias("base")).withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("path")))
    label = F.when(F.col("k") > 1, F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base"))
    txt = F.lower("base").endswith(".txt")
    large = F.lit(False) if most_bytes is None else F.col("length") > most_bytes
    warning = F.when(~txt, "not a text file").when(large, "too large")
    return f.select(label.alias("name"), F.col("length").alias("n_bytes"), F.when(warning.isNull(), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), warning.alias("warning"))


def safe_name(name: str) -> str | None:
    """A member name without tricks, or None."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0]:
        return None
    return clean


def zip_texts(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits(), strict: bool = False) -> DataFrame:
    """``archive, member, text, warning`` of the ``.txt`` members, sorted by name within the archive; opened in the workers.

    Number, declared sizes and compression ratio are checked from the directory of the archive.
    With ``strict`` a member of invalid UTF-8 is refused instead of repaired; system folders of
    archivers are passed over.
    """

    def run(batches):
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    infos = [i for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(where, None, None, "not an archive")], columns=["archive", "member", "text", "warning"])
                    continue
                if len(infos) > limits.members or sum(i.file_size for i in infos) > limits.total_bytes:
                    yield pd.DataFrame([(where, None, None, "archive over its limits")], columns=["archive", "member", "text", "warning"])
                    continue
                for i in sorted(infos, key=lambda x: x.filename):
                    base = posixpath.basename(i.filename)
                    if i.filename.startswith("__MACOSX/") or base.startswith("._"):
                        continue
                    name = safe_name(i.filename)
                    if name is None:
                        rows.append((where, i.filename, None, "unsafe name"))
                    elif not name.lower().endswith(".txt"):
                        rows.append((where, name, None, "ignored"))
                    elif i.file_size > limits.member_bytes or i.file_size > limits.ratio * max(1, i.compress_size):
                        rows.append((where, name, None, "member over its limits"))
                    else:
                        data = z.read(i)
                        try:
                            rows.append((where, name, data.decode("utf-8", "strict" if strict else "replace"), None))
                        except UnicodeDecodeError:
                            rows.append((where, name, None, "invalid UTF-8"))
                yield pd.DataFrame(rows, columns=["archive", "member", "text", "warning"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, text string, warning string")
