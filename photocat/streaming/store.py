"""Result tables that streams write and others read: folders by micro-batch and bucket, and a record per commit.

A micro-batch writes its rows aside, into folders no reader knows, and then puts one small record in place that names
them. Readers open only what records name, so a half written, killed or repeated attempt is never seen, and what was
committed before stays readable. A repeated micro-batch replaces its own record. Rows are spread over ``buckets`` folders by a
hash of ``key``; a reader that needs some keys opens only the folders of their buckets.

    root/rows/<attempt>/bucket=<k>/part-*.parquet      root/commits/<batch>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    """One committed micro-batch: the folder of its attempt, and the buckets it has rows in."""

    batch: int
    attempt: str
    buckets: list[int]


class Folder:
    """A folder in whatever store the cluster uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, inside: str = "") -> list[str]:
        at = self._path(inside)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def holds_any(self, inside: str = "") -> bool:
        return self.fs.listStatusIterator(self._path(inside)).hasNext()

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file aside and move it into its place in one step, over an older one."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        context.rename(context.makeQualified(self._path(aside)), context.makeQualified(self._path(name)), _overwrite(self.jvm))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _overwrite(jvm):
    """The one-element array of rename options that the Java method takes."""
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    options[0] = kind.getField("OVERWRITE").get(None)
    return options


class ResultStore:
    """Rows of ``schema``, written by micro-batch. ``key``: the columns whose hash gives a row's bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Iterable[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, list(key), buckets
        self.folder = Folder(spark, root)

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def write_aside(self, rows: DataFrame, batch: int) -> Commit:
        """Write the rows where no reader looks. They are rebalanced by bucket: small ones are one file, large ones several."""
        attempt = f"{batch:012d}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket_of()).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.root}/rows/{attempt}")
        found = [int(n.removeprefix("bucket=")) for n in self.folder.names(f"rows/{attempt}") if n.startswith("bucket=")]
        return Commit(batch, attempt, sorted(found))

    def commit(self, done: Commit) -> None:
        """From here on readers see these rows, in place of those of an earlier attempt at the same micro-batch."""
        self.folder.put(f"commits/{done.batch:012d}.json", json.dumps(done._asdict()))

    def write(self, rows: DataFrame, batch: int) -> None:
        self.commit(self.write_aside(rows, batch))

    def commits(self) -> list[Commit]:
        """What is committed, by micro-batch: a small record each, and none but this many folders is ever listed."""
        return [Commit(**json.loads(self.folder.read(f"commits/{n}"))) for n in self.folder.names("commits") if n.endswith(".json")]

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The committed rows, of some buckets only if given, and of micro-batches before ``before``."""
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.root}/rows/{c.attempt}/bucket={k}"
            for c in self.commits() if before is None or c.batch < before
            for k in c.buckets if wanted is None or k in wanted
        ]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_in(self, rows: DataFrame) -> list[int]:
        """The buckets these rows belong to: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("k")).distinct().collect())

    def merge(self) -> None:
        """Make one micro-batch of all so far, so that readers open one file a bucket again. Its number is that of the last one;
        earlier records go only after the merged one is in place, and readers between the two see rows twice at most, never
        none: call it while nothing reads, as ``clean``."""
        done = self.commits()
        if len(done) < 2:
            return
        merged = self.write_aside(self.read(), done[-1].batch)
        self.commit(merged)
        for c in done[:-1]:
            self.folder.remove(f"commits/{c.batch:012d}.json")

    def clean(self) -> None:
        """Remove what no record names: attempts that were killed, replaced or merged. Call it while nothing writes or reads."""
        used = {c.attempt for c in self.commits()}
        for name in self.folder.names("rows"):
            if name not in used:
                self.folder.remove(f"rows/{name}")
        for name in self.folder.names("commits"):
            if not name.endswith(".json"):
                self.folder.remove(f"commits/{name}")
