"""The folder that driver and executors share: written tables that cut lineage, and sides of joins whose size is known."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes in one Arrow batch sent to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def tune(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that long texts don't fill a worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, "1000000000").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def columns_of(df: DataFrame) -> list[Column]:
    """Every column of df, whatever it is called."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where none is set and all runs in one process, one of our own."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = folder = tempfile.mkdtemp(prefix="quill-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _OWN[sc.applicationId]


_OWN: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; the session's go when it ends."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    if (folder := sc._jsc.sc().getCheckpointDir().get()) not in _CHECKPOINTS:  # of this application alone
        _CHECKPOINTS.add(folder)
        atexit.register(remove_folder, df.sparkSession, folder)
    return df.checkpoint()


_CHECKPOINTS: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the shared folder, which goes with the session.

    Read back, it has the sizes of its files and columns that can be pruned. DataFrame.checkpoint()
    keeps the estimates of the plan that it cuts, and those of joins are products: after some rounds of
    an iteration the optimizer multiplies numbers of millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    atexit.register(remove_folder, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that written() has made and that are there still.
TABLES: list[str] = []


def remove_tables(spark: SparkSession, since: int) -> None:
    """Take away the tables written after the first since ones: for whoever has written out all that reads them."""
    for path in TABLES[since:]:
        remove_folder(spark, path)
    del TABLES[since:]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Take away a folder of any file system that Spark knows; nothing once the session has ended."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is not None and context is not None and not context.sc().isStopped():
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)


#: Bytes of a side that is broadcast, at most, by its values' sizes, with 16 bytes a row and column besides.
BROADCAST_BYTES = 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: fixed for numbers, by their length for strings, binaries and arrays."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for c, (_, kind) in zip(columns_of(df), df.dtypes, strict=True):
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def side(df: DataFrame, cut=checkpoint) -> DataFrame:
    """A checkpointed side of a join by a key that may be hot: broadcast if its bytes are summed to be few, else left so that Spark can split both sides' skewed partitions."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df
