"""Stored tables that change: rewrites of the touched partitions with a commit, and appends that count once.

A table is a folder of versions and a folder of commits. A commit is one small JSON file, `_commits/<number>.json`, that
lists for each partition the folder holding its rows; it is made under another name and renamed, which a file system
does wholly or not at all and only if no such commit is there yet. Readers take the last commit. So a task or a driver
that fails leaves the old state, files that were read are never overwritten, and two writers cannot both make the next version:
the one that comes second starts again from the new state. The listing grows with the table's partitions, not its rows.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULL = "__null__"


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one for a local session, and an error
    for any other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Table:
    """A table of rows in partitions by one column, below `path` in any store that Spark reads.

    Nulls of the partition column are a partition of their own. Methods that change rows return how many.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, by: str) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # commits ----------------------------------------------------------------------------------------------------------

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/_commits/{version:012d}.json"

    def version(self) -> int:
        """The number of the last commit, 0 for a table without one."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[:12]) for n in names if n.endswith(".json")], default=0)

    def state(self, version: int | None = None) -> dict:
        """{partitions: {value: [folder, ...]}, batches: {sink: last batch}} of a version (the last one)."""
        version = self.version() if version is None else version
        if not version:
            return {"partitions": {}, "batches": {}}
        text = "\n".join(r[0] for r in self.spark.read.text(self._commit_path(version), wholetext=True).collect())
        return json.loads(text)

    def _commit(self, version: int, state: dict) -> None:
        made = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        target = self._path(self._commit_path(version))
        # a rename on to a commit that is there fails in HDFS; in stores where it would replace the file, ask first
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise Conflict(f"version {version} of {self.path} is taken")

    # rows -------------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None, only: list | None = None) -> DataFrame:
        """The rows of a version (the last one); of some values of the partition column, if given: other partitions
        are not even listed."""
        parts = self.state(version)["partitions"]
        wanted = parts if only is None else {k: parts[k] for k in map(self._name, only) if k in parts}
        folders = [f"{self.path}/{f}" for fs in wanted.values() for f in fs]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    @staticmethod
    def _name(value) -> str:
        return _NULL if value is None else f"={value}"

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """The rows in a folder of their own; {partition: folders}. The column stays in the files, so that folders can
        be read by name and keep its type."""
        folder, key = f"data/{uuid.uuid4().hex}", F.when(F.col(self.by).isNull(), F.lit(_NULL)).otherwise(F.concat(F.lit("="), F.col(self.by).cast("string")))
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("_part", F.base64(F.encode(key, "utf-8")))
        # large partitions are split over tasks, small ones share one; base64 with a safe alphabet names the folder
        rows = rows.withColumn("_part", F.translate("_part", "+/=\r\n", "-_.")).hint("rebalance", "_part")
        rows.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        out = {}
        for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")):
            name = s.getPath().getName()
            if name.startswith("_part="):
                out[_decoded(name[6:])] = [f"{folder}/{name}"]
        return out

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows added; batch: (sink, number) of a stream's batch, which is added once however often it is given.
        Returns the number of rows, 0 for a batch that was there."""
        while True:
            version = self.version()
            state = self.state(version)
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return 0
            new = self._write(df)
            rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for fs in new.values() for f in fs]).count() if new else 0
            parts = dict(state["partitions"])
            for k, fs in new.items():
                parts[k] = parts.get(k, []) + fs
            try:
                self._commit(version + 1, {"partitions": parts, "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})})
                return rows
            except Conflict:
                continue

    def _rewrite(self, touched: Column, change: Callable[[DataFrame], DataFrame], only: list | None) -> int:
        """The partitions that hold touched rows, written anew by change(); the others keep their files."""
        while True:
            version = self.version()
            state = self.state(version)
            counts = self.read(version, only).where(touched).groupBy(self.by).agg(F.count("*").alias("n")).collect()
            if not counts:
                return 0
            names = [self._name(r[self.by]) for r in counts]
            rows = self.read(version, [r[self.by] for r in counts])
            new = self._write(change(rows))
            parts = {k: fs for k, fs in state["partitions"].items() if k not in names} | new
            try:
                self._commit(version + 1, state | {"partitions": parts})
                return sum(r["n"] for r in counts)
            except Conflict:
                continue

    def fill(self, column: str, value: Column, only: list | None = None) -> int:
        """`value` where the column is null, in some partitions or all; returns the number of rows filled. Partitions
        without a null are not written. Rows whose value is null as well stay as they are, and count."""
        empty = F.col(column).isNull()
        return self._rewrite(empty, lambda df: df.withColumn(column, F.when(empty, value).otherwise(F.col(column))), only)

    def delete(self, where: Column, only: list | None = None) -> int:
        """Rows of which the condition is true go; returns how many."""
        return self._rewrite(where, lambda df: df.where(~F.coalesce(where, F.lit(False))), only)

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Files that none of the last `keep` versions holds and that are `hours` old go; returns how many folders."""
        last = self.version()
        kept = {f.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for fs in self.state(v)["partitions"].values() for f in fs}
        gone, data = 0, self._path(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in kept and s.getModificationTime() < (time.time() - hours * 3600) * 1000:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def _decoded(name: str) -> str:
    import base64

    return base64.b64decode(name.translate(str.maketrans("-_.", "+/="))).decode()
