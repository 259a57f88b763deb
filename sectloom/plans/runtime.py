"""Session settings, table reading and lineage cuts shared by all operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session made by this library; a session that exists keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` overrides them."""
    b = SparkSession.builder.master(master).appName("sectloom")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs in one process (tests) a local folder is made and set; on a cluster
    an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = sc._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sectloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that no later stage depends on
    executors that made it. Safe against the loss of executors, unlike a local checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sectloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table made by :func:`cut` once nothing reads it any more, and lets Spark drop
    shuffle files that only it held."""
    path = getattr(df, "_sectloom_path", None)
    if not path:
        return
    spark = df.sparkSession
    u = urlparse(path)
    if u.scheme == "file" or (not u.scheme and spark.sparkContext.master.startswith("local")):
        shutil.rmtree(u.path, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_bound(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def forget(df: DataFrame) -> None:
    """Lets Spark delete shuffle files whose data no living plan refers to."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
