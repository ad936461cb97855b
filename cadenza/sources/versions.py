"""Tables in versions: a reader sees the last committed one, whole, whatever is being written or has failed.

A table is a folder of data folders, each written once, and of commits: small JSON files numbered from 1 that say which data
folders make up the table, by part. A commit takes its name by a rename that fails where the name exists (as HDFS's does), so
of two writers that began from one version one gets a Conflict. A commit also notes the last batch of every writer, so that
a batch that comes again changes nothing.
Files are reached as Spark reaches them (Hadoop's file systems); the driver handles names and counts only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed the next version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        """schema: of the rows; buckets: parts that upserts rewrite one by one."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = StructType.fromDDL(schema)
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """The numbers of the commits that are kept, ascending."""
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json")]

    def commit_of(self, version: int | None = None) -> dict:
        """A commit (default: the last one); an empty table's for none."""
        version = version or max(self.versions(), default=0)
        if not version:
            return {"version": 0, "parts": {}, "batches": {}}
        stream = self._fs.open(self._at(f"commits/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the last one)."""
        return self._rows([f for own in self.commit_of(version)["parts"].values() for f in own])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _commit(self, was: dict, parts: dict, writer: str | None, batch: int | None) -> int:
        version = was["version"] + 1
        batches = was["batches"] | ({writer: batch} if writer is not None else {})
        text = json.dumps({"version": version, "parts": parts, "batches": batches})
        name = self._at(f"commits/{version:012d}.json")
        temporary = self._at(f".writing-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(name.getParent())
        # A commit appears whole: a name that is there is never replaced.
        if self._fs.exists(name) or not self._fs.rename(temporary, name):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} of {self.path}")
        return version

    @staticmethod
    def _done(was: dict, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch <= was["batches"].get(writer, -1)

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{folder}")
        return folder

    def replace(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """df as the whole table."""
        was = self.commit_of()
        return was["version"] if self._done(was, writer, batch) else self._commit(was, {"all": [self._write(df)]}, writer, batch)

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """df's rows added to the table."""
        was = self.commit_of()
        if self._done(was, writer, batch):
            return was["version"]
        return self._commit(was, was["parts"] | {"all": [*was["parts"].get("all", []), self._write(df)]}, writer, batch)

    def upsert(self, df: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None, batch: int | None = None) -> int:
        """The table with merge(old, new) in place of the buckets of keys that df has rows in; the others stay as they are.
        A table is written by upserts alone or by none."""
        was = self.commit_of()
        if self._done(was, writer, batch):
            return was["version"]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        staged = self._write(df)  # computed once: what it is merged with is chosen by it
        new = self._rows([staged])
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        old = self._rows([f for b in touched for f in was["parts"].get(str(b), [])])
        folder = f"data/{uuid.uuid4().hex}"
        rows = merge(old, new).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", bucket)
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = set(self._names(folder))
        parts = was["parts"] | {str(b): [f"{folder}/bucket={b}"] if f"bucket={b}" in made else [] for b in touched}
        version = self._commit(was, parts, writer, batch)
        self._fs.delete(self._at(staged), True)
        return version

    def compact(self) -> int:
        """The rows of a table of appends in one folder."""
        was = self.commit_of()
        return self._commit(was, {"all": [self._write(self.read())]}, None, None)

    def trim(self, keep: int = 10) -> None:
        """Removes all commits but the last `keep`, and the data that none of them names. Not to be run beside a writer:
        data that isn't committed yet would go."""
        numbers = self.versions()
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"commits/{n:012d}.json"), False)
        named = {f.split("/")[1] for n in numbers[-keep:] for own in self.commit_of(n)["parts"].values() for f in own}
        for name in self._names("data"):
            if name not in named:
                self._fs.delete(self._at(f"data/{name}"), True)
