"""What a query needs from the session before it runs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = Path(__file__).resolve().parent
ROOT = str(PACKAGE.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from its folder in a local session, on a cluster from a zip that Spark ships.

    Texts go to them in smaller batches than by default, which would be some tens of megabytes for each task on either side."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":  # no choice of the user's
        spark.conf.set(BATCH, "2000")
    if re.fullmatch(r"local(\[.*\])?", context.master):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif not getattr(context, "_lexiscope_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lexiscope.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        context.addPyFile(path)
        context._lexiscope_shipped = True
    return spark


#: Bytes of input for each core below which a table of texts is dealt out to all cores, and bytes of a part of a larger one whose splits are uneven.
SPREAD, PART = 8 << 20, 32 << 20
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. A small one of texts may lie in a single split, and a large one in a few row groups, which no split
    cuts: its rows are spread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in TEXTS:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SPREAD * cores:
        return df.repartition(cores)
    if uneven(df, cores):
        # by a hash of the row, so that a task that is run again deals alike and nothing is sorted for it
        return df.repartition(max(2 * cores, size // PART), F.xxhash64(*df.columns))
    return df


def uneven(df: DataFrame, cores: int) -> bool:
    """Whether a split has more than twice a core's share of the rows; only the files' footers are read."""
    rows = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    return (rows["most"] or 0) * cores > 2 * (rows["n"] or 0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, as a whole URI. Where that setting is absent, a local session (as in tests) gets a temporary one and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = own_dir()
    return whole_uri(spark, f"{base.rstrip('/')}/lexiscope/{uuid.uuid4().hex}")


def whole_uri(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers and writers take it, with the scheme of the default file system where it has none."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


@cache
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, its size is known to the planner, and an executor that is lost takes nothing along."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the shared one."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df. Only for a df that no later plan reads: what came of it has been written itself."""
    delete(df.sparkSession, df.written_to)
