"""Written intermediates in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local master, as in tests, gets one of its own; on
    a cluster that is an error, as executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="chronolake-"))
        where = _own[0]
    return where.rstrip("/")


def written(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; with ``clean`` the shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if clean:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: their names, lengths and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]
