"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary one that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if context._jsc.sc().getCheckpointDir().isDefined():
            folder = context._jsc.sc().getCheckpointDir().get()
        elif context.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="flowspark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/flowspark-{name}-{uuid.uuid4().hex}"


def long_ids(docs, id_col: str):
    """The id column as long doc_id, for operators whose files or places hold whole numbers; other kinds are refused."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"this operator needs whole-number ids, and {id_col!r} is {kind}; number the documents first")
    return docs[id_col].cast("long").alias("doc_id")


def written(df, name: str):
    """df, written as Parquet to the shared folder and read again: a cut in the lineage that lost executors can't lose."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._flowspark_path = path
    return out


def discard(table) -> None:
    """Deletes a ``written`` table, once what was made of it is written itself."""
    fs, at = hadoop_fs(table.sparkSession, table._flowspark_path)
    fs.delete(at, True)


def clear(spark: SparkSession) -> int:
    """Deletes all tables and files that operators have left in the shared folder, for when no result is still to be read; returns how many folders there were."""
    folder = shared_dir(spark)
    fs, at = hadoop_fs(spark, folder)
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("flowspark-")] if fs.exists(at) else []
    for path in found:
        fs.delete(path, True)
    return len(found)


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
