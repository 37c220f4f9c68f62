"""Tables written once and read again, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this process, which only a local session can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


#: Rows of numbers to a file, about.
FILE_ROWS = 1_000_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: it is made once however often it is read, and the
    lineage ends there, so a lost executor costs no more than the tasks that it ran. `rows`: a bound on the number of its rows,
    where one is known; a table of few small rows then goes into few files, though no fewer than tasks run at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast. Spark takes a table for as large as its compressed files and the rows of an
    explode for as few as went in, so by its own check it collects tables at the driver that do not fit there."""
    return df.hint("merge")


#: Bytes of the files read to a partition, about, where rows are dealt by a key that all of a query's work goes by.
PART_BYTES = 4 << 20


def spread(rows: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """`rows` dealt by `keys` into as many partitions as the files of `source` (or `rows`) ask for, if the session's number is less
    than that: what a task holds then does not grow with the tables. Joins and groups by the keys need no other shuffle."""
    spark = rows.sparkSession
    size = int(str((source or rows)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(-(-size // PART_BYTES), 20_000)
    return rows.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
