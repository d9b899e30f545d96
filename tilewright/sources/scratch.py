"""Tables in the shared folder that cut lineage between the steps of an operator.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset and Spark runs
in one process, as in tests, a folder of our own is made and set on the context.  Staged tables go when the
application ends, or when ``release`` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tilewright-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Size of an Arrow batch that goes to a Python worker, where the session doesn't say; documents can be long.
#: By setting: Spark's default, and what is set instead.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def lean(df: DataFrame) -> DataFrame:
    """``df``, with its session sending small Arrow batches unless it was told a size.  The batch size is the
    session's, not the frame's, so the setting stays; one that was made on purpose is left alone."""
    conf = df.sparkSession.conf
    told = conf.getAll
    for name, (_, small) in BATCH.items():
        if name not in told:
            conf.set(name, small)
    return df


def _folder(spark: SparkSession) -> str:
    """Where the application's tables go; removed with the application."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/tilewright/{context.applicationId}"
    if path not in _removed_at_end:
        _removed_at_end.add(path)
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
    return path


_removed_at_end: set[str] = set()


def release(spark: SparkSession) -> None:
    """Removes all staged tables; frames that read them are of no use afterwards."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(place, True)
    _removed_at_end.discard(_folder(spark))


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so that a lost executor costs no
    more than the tasks that read the table.  ``by``: partition columns of the table."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Up to so many keys are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one column of ``dropped``; those with a null key stay."""
    return _by_key(df, key, dropped, "left_anti")


def only(df: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``kept``."""
    return _by_key(df, key, kept, "left_semi")


def fresh(name: str, df: DataFrame) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _by_key(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    name = fresh("matched_key", df)
    keys = stage(keys.toDF(name).distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, F.col(key) == F.col(name), how)
