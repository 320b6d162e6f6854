"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that is hinted for a broadcast after its rows were counted.
BROADCAST_ROWS = 200_000
#: Rows of one file of a staged table whose size is known beforehand; rows are short.
ROWS_A_FILE = 500_000
#: Rows of one file of a table that is dealt out anew; few, so that tasks stay many.
SHORT_ROWS_A_FILE = 20_000
#: Tables of `passing`: path and a weak reference to the listing of files that every plan over the table holds.
_unread: list[tuple[str, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, named by spark.checkpoint.dir.

    Only a session on one machine (local, local[...]) without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    own = tempfile.mkdtemp(prefix="linkgrove-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/linkgrove/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().toString() for s in found or []]


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here.

    Lost executors can only cost tasks of the running job, never this table. `rows`,
    if given, is about how many rows come: the files are as many as they need, not as
    many as there happen to be shuffle partitions. The folder is removed when the
    driver's Python ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    atexit.register(_forget, spark, path)
    return out


def passing(df: DataFrame, name: str) -> DataFrame:
    """Like `staged`, but the table goes once no plan can read it any more, at a later `passing` or `free_shuffles`.

    For wide tables that a lazy result still reads when its operator has long returned.
    """
    spark = df.sparkSession
    drop_unread(spark)
    out = staged(df, name)
    listing = out._jdf.queryExecution().analyzed().relation().location()
    _unread.append((out.stage_path, spark.sparkContext._jvm.java.lang.ref.WeakReference(listing)))
    return out


def drop_unread(spark: SparkSession) -> None:
    """Drop the tables of `passing` whose plans the driver has collected."""
    for entry in [e for e in _unread if e[1].refersTo(None)]:
        _unread.remove(entry)
        drop_path(spark, entry[0])


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` short rows dealt out anew, to stage as few files as they fill, whatever the number of shuffle partitions.

    For each file that Hadoop writes to a local folder, an executor starts processes that set its permissions.
    """
    return df.repartition(max(1, -(-rows // SHORT_ROWS_A_FILE)))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session may have ended before
        pass


def unstage(df: DataFrame) -> None:
    """Drop a staged table that no later plan reads."""
    drop_path(df.sparkSession, df.stage_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, and tables of `passing`, of plans that nothing refers to any more.

    Spark notices unused shuffles only when the driver collects garbage, which a
    driver with little to do may not do for long. Python's references reach the JVM
    with the next call, hence two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    drop_unread(spark)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table whose counted rows are within `most`."""
    return F.broadcast(df) if rows <= most else df
