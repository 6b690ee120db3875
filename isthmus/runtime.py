"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if only the driver's sys.path holds it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, or a local one where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        if not set_to and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="isthmus-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, stored in the shared folder, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plan(df: DataFrame) -> DataFrame:
    """cut_lineage for loops: the result's plan knows rows and schema only.

    A checkpoint otherwise keeps the constraints, partitioning and ordering of its plan, and in loops of joins and CASE
    expressions those grow from round to round until planning takes longer than the work.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    jdf = df._jdf
    bare = spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False)
    return DataFrame(bare, spark).checkpoint(eager=True)


_TABLES: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Like cut_lineage, by a Parquet table in the shared folder, whose reads have exchanges of their own and file statistics."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` makes inside are deleted at the end; what is computed from them must be written by then."""
    mark = len(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES[mark:]:
            delete(spark, path)
        del _TABLES[mark:]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
