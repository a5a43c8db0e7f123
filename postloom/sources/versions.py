"""Tables of one folder that change together: buckets of Parquet and a log of versions.

Rows of a table lie in buckets by the hash of their keys. A change reads and rewrites the buckets that its rows fall into and
writes them beside the old ones; then one small log file, version n + 1, names every table's buckets. The file is created only if it
isn't there, so of two writers that began from one version one succeeds and the other gets Conflict and begins again. Until then nothing
is visible, and whoever has read a version can read on in it, as folders are never changed.

The log's entry has a line a bucket, as many as there are buckets, however many rows they hold. `old_folders` names those that versions
before a given one alone use, for whoever cleans up.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table; so few are listed without a job of their own.
BUCKETS = 32


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._hadoop(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def entry(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "batches": {}}
        text = self.spark.read.text(f"{self.path}/_versions/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, schema: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest if None), or some of its buckets."""
        known = self.entry(self.latest() if version is None else version)["tables"].get(table, {"folders": {}})
        folders = [f for b, f in known["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def begin(self) -> Change:
        return Change(self, self.latest())

    def put(self, version: int, entry: dict) -> None:
        """Create a version's entry, whole or not at all, unless it is there."""
        name = f"{self.path}/_versions/{version:012d}.json"
        fs, target = self._hadoop(name)
        fs.mkdirs(target.getParent())
        if urlparse(self.path).scheme in ("", "file"):
            plain = urlparse(name).path
            staged = f"{os.path.dirname(plain)}/.{uuid.uuid4().hex}"
            with open(staged, "w", encoding="utf-8") as f:
                json.dump(entry, f)
            try:
                os.link(staged, plain)  # fails if it is there
            except FileExistsError:
                raise Conflict(f"version {version} was committed by another change") from None
            finally:
                os.unlink(staged)
            return
        try:
            out = fs.create(target, False)
        except Exception as e:  # Hadoop's FileAlreadyExistsException
            if fs.exists(target):
                raise Conflict(f"version {version} was committed by another change") from e
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def old_folders(self, before: int) -> set[str]:
        """Folders that only versions below `before` use."""
        used = lambda vs: {f for v in vs for t in self.entry(v)["tables"].values() for f in t["folders"].values()}
        every = self.versions()
        return used(v for v in every if v < before) - used(v for v in every if v >= before)


class Change:
    """Changes to some tables, from one version on, that become visible together."""

    def __init__(self, tables: VersionedTables, base: int):
        self.tables, self.base = tables, base
        self.entry = tables.entry(base)

    def has_seen(self, stream: str, number: int) -> bool:
        """Whether a batch of this number has been committed for a stream."""
        return self.entry["batches"].get(stream, -1) >= number

    def read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as this change began."""
        return self.tables.read(table, schema, self.base, buckets)

    def merge(self, table: str, schema: str, keys: list[str], rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
        """Replace the buckets that rows fall into by how(old rows of those buckets, rows); gives which ones. how keeps a key's rows in its bucket."""
        known = self.entry["tables"].setdefault(table, {"buckets": buckets, "folders": {}})
        bucket = bucket_of(keys, known["buckets"])
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return []
        new = how(self.read(table, schema, touched), rows)
        folder = f"{table}/{uuid.uuid4().hex}"
        names = [f.name for f in self.tables.spark.createDataFrame([], schema).schema]
        new.select(*names, bucket.alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.tables.path}/{folder}")
        known["folders"].update({str(b): f"{folder}/_bucket={b}" for b in touched})
        return touched

    def commit(self, stream: str | None = None, number: int = 0) -> int:
        """Make the changes visible as the next version; Conflict if there is one already."""
        if stream is not None:
            self.entry["batches"][stream] = number
        self.tables.put(self.base + 1, self.entry)
        return self.base + 1
