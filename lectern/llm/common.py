"""Helpers shared by the operators: checkpoints, unused column names, gapless numbering."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words in every operator here.
SPACE = r"\x20\x09-\x0D"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The top-level column of that name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of an Arrow batch between Spark and Python: both sides hold some batches for each running task.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to BATCH_BYTES; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key) if c.isdigit()) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def plain_names(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow under plain_names(), in and out: PySpark looks the columns up by name, which fails for names with dots or back-ticks."""
    bound_batches(df.sparkSession)
    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain_names(len(schema)), schema.fields, strict=True)])
    return df.toDF(*plain_names(len(df.columns))).mapInArrow(run, plain).toDF(*schema.names)


def sub_buckets(n_rows: int, per_root: float) -> int:
    """Buckets per group that grow with the root of the rows: neither a bucket's rows nor a group's buckets get large."""
    return max(1, math.ceil(math.sqrt(n_rows) / per_root))


def running_base(sums: DataFrame, group: list[str], order: list[str], value: str, base: str) -> DataFrame:
    """For each row the sum of value over the rows before it in its group."""
    before = Window.partitionBy(*map(col, group)).orderBy(*map(col, order)).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(base, F.coalesce(F.sum(col(value)).over(before), F.lit(0)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet copies in the shared folder, for tables that are read several times before the operator returns.

    Unlike checkpoint files they are compressed and pruned by column. clear() deletes them; use them for
    nothing that the returned DataFrame still has to read.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        bound_batches(spark)
        self.spark, self.made = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.clear()

    def store(self, df: DataFrame, release: bool = False) -> DataFrame:
        """A copy of df; release: what it was made from has left large shuffle files."""
        path = shared_path(self.spark, "scratch")
        self.made.append(path)
        df.write.parquet(path)
        if release:
            self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark drop shuffle files that no table needs any more; it does so as its driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.made:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.made = []
        self.release()
