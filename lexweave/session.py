"""Session helpers shared by every operator: tables, shared work folders, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where nothing is named, a
    temporary folder is used on a local master only, and set as the checkpoint folder of the
    session; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        got = sc._jsc.sc().getCheckpointDir()
        path = got.get() if got.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A new path for a table written between steps, below the shared folder; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/lexweave/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the work tables of this process; also done when it ends. Frames that read them are void then."""
    while _tables:
        spark, name = _tables.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session has ended, and its catalog with it
            break
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


atexit.register(release)


def materialize(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (in folders ``by`` some columns) and read it back: the lineage ends there,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, what)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """Write rows that lie in ``buckets`` partitions by ``key``, each sorted by it, as a bucketed table in the shared
    folder; joins and aggregates by the key read it without a shuffle. ``release`` drops it."""
    spark = df.sparkSession
    name, path = f"{what}_{uuid.uuid4().hex}", work_path(spark, what)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


#: A side may be broadcast when it has at most this many rows of fixed width.
BROADCAST_ROWS = 500_000


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count proves it small, else unchanged.

    The count stops at ``limit + 1`` rows, so the check itself stays cheap; beyond the
    limit the join falls back to the shuffled plan that Spark picks.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def data_dir(default: str = "/root/testdata/sf0.001") -> str:
    return os.environ.get("LEXWEAVE_DATA", default)
