"""What Python workers need, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is ever broadcast, by the size of its written Parquet files.
BROADCAST_BYTES = 3 << 20


def shipped(spark: SparkSession) -> None:
    """Gives executors this package, unless PYTHONPATH already does."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_termweave_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="termweave-src-")  # the driver serves this file to the executors
    with zipfile.ZipFile(f"{d}/termweave_src.zip", "w") as z:
        for p in (root / "termweave").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{d}/termweave_src.zip")
    sc._termweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session in one JVM may go without: it gets a local one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termweave-")
        sc.setCheckpointDir(base)
        base = f"file://{base}"
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termweave_path = path
    return out


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below path, whatever file system it is in."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small_side(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, written; with a broadcast hint if its files are within limit, else left to a shuffle join (AQE splits hot keys)."""
    out = written(df, name)
    if stored_bytes(df.sparkSession, out._termweave_path) <= limit:
        path, out = out._termweave_path, F.broadcast(out)
        out._termweave_path = path
    return out
