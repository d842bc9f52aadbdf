"""Lineage cuts: intermediate tables written to the folder that all executors share; and what operators agree on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one for a local session, and an error
    for any other: executors on other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """What operators cut within goes to one folder of the shared one, whose path this gives: they read it until their
    result is written, and then drop() removes it."""
    path = f"{shared_dir(spark)}/cuts-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that folder() gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hidden(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed c0_, c1_, ... so that none clashes with a column that an operator adds, and the new
    names of those wanted. toDF(*df.columns) names them back."""
    names = [f"c{i}_" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(w)] for w in wanted]


def integer(df: DataFrame, key: str) -> None:
    """Keys are integers: any other type is an error at once, not a cast that loses rows when the job runs."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"the key {key} must be of an integer type, not {kind.simpleString()}")


def keyed(df: DataFrame, key: str) -> DataFrame:
    """The rows of df that have a key, which must be an integer. Rows without one name no document: the operators that
    call this give no row for them."""
    integer(df, key)
    return df.where(F.col(key).isNotNull())


def join_one(rows: DataFrame, table: DataFrame, on: str, most: int = 1000) -> DataFrame:
    """rows joined with table, which has one row for each key `on` and says in _n how many of rows have it.

    A key with more than 1 / most of all rows would hold up the task that it is dealt to, so such keys go by a
    broadcast, at most `most` of them whatever the input; the others by an ordinary join.
    """
    total = table.agg(F.sum("_n")).first()[0] or 0
    hot = table.where(F.col("_n") * most > total)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(table.where(F.col("_n") * most <= total), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest).drop("_n")
