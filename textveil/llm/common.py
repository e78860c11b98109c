"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, as in tests, see
    ``shared_folder``. Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have Spark delete
    checkpoints that nothing refers to any more.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Keys that are looked up in a broadcast: fewer than this, as each holds more than such a part of the rows.
HOT_KEYS = 10_000
#: Rows of one key that a task takes in any case: below, two branches of a plan would cost more than they save.
KEY_ROWS = 20_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``key_rows`` how many of ``rows`` have it.

    Keys of more than ``total / HOT_KEYS`` rows, which are fewer than ``HOT_KEYS``, are looked up in a
    broadcast of theirs, so that no task gets all rows of a hub; all others meet by a shuffle.
    """
    most = max(KEY_ROWS, total // HOT_KEYS)
    if total <= most:
        return rows.join(table.drop("key_rows"), key)
    hot = F.broadcast(table.where(F.col("key_rows") > most).drop("key_rows"))
    cool = table.where(F.col("key_rows") <= most).drop("key_rows")
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(table.where(F.col("key_rows") > most).select(key)), key, "left_anti").join(cool, key))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` equals in any case."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer tasks than there are cores, dealt out by a key; any larger one as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def nulls_to_empty(column):
    """The values of an Arrow string column as one array of strings without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if column.type != pa.string() else column
    return pc.fill_null(column, "") if column.null_count else column


def pieces(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given byte lengths into runs of about ``most`` bytes, one row at least."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver has it, if it is not installed there.

    Rows of whole texts are large: a batch of a thousand bounds what a worker and its executor hold. The
    setting stays with the session, as queries run when their caller asks for rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    import textveil

    root = os.path.dirname(os.path.dirname(os.path.abspath(textveil.__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where the session names none and runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """A table written as Parquet in a folder that all executors share, and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table that was stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
