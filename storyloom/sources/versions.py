"""Tables of rows by key with versions: an upsert rewrites the buckets of its keys and nothing else.

A table is a folder of versions, each a Parquet folder partitioned by bucket, written by one Spark job. A bucket is a hash of
the key. A version holds its touched buckets whole, so a reader takes each bucket from the newest version that has it; a
version counts once its job has committed, and a failed one is passed over. Deleted keys stay as marked rows until ``compact``
writes all buckets anew. Only names of folders and numbers of buckets come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import last_wins

_NAME = re.compile(r"v(\d{6,})-(\d+)-(full|part)$")


class VersionedTable:
    """``key``: the columns that name a row. ``buckets``: how many a new table has; an existing one keeps its own until compacted.

    Null keys are keys like others. Versions are numbered from 0; two writers of one version collide, and the later fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self._buckets = spark, path.rstrip("/"), list(key), buckets

    def _list(self, path: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def _folders(self) -> dict[int, tuple[str, int, bool]]:
        """All versions, committed or not: number -> (folder, buckets, full)."""
        found = (_NAME.match(s.getPath().getName()) for s in self._list(self.path))
        return {int(m[1]): (f"{self.path}/{m[0]}", int(m[2]), m[3] == "full") for m in found if m}

    def _committed(self, version: int | None = None) -> list[tuple[int, str, int, bool]]:
        """Committed versions up to one, from the newest full one on."""
        done = []
        for n, (folder, buckets, full) in sorted(self._folders().items(), reverse=True):
            if (version is None or n <= version) and any(s.getPath().getName() == "_SUCCESS" for s in self._list(folder)):
                done.append((n, folder, buckets, full))
                if full:
                    break
        return done[::-1]

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        return [n for n, (folder, *_) in sorted(self._folders().items()) if any(s.getPath().getName() == "_SUCCESS" for s in self._list(folder))]

    def places(self, version: int | None = None) -> dict[int, str]:
        """Which folder holds each bucket as of a version."""
        found = {}
        for _, folder, _, _ in self._committed(version):
            for s in self._list(folder):
                name = s.getPath().getName()
                if name.startswith("__bucket="):
                    found[int(name.split("=")[1])] = f"{folder}/{name}"
        return found

    def _rows(self, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """Rows with their marks, of some buckets or all; None for a table without a version. Versions may differ in columns: those of the newest come first, and what a row lacks is null."""
        done = self._committed(version)
        if not done:
            return None
        by_folder: dict[str, list[str]] = {}
        for bucket, place in self.places(version).items():
            if only is None or bucket in only:
                by_folder.setdefault(place.rsplit("/", 1)[0], []).append(place)
        parts = [self.spark.read.parquet(*sorted(places)) for _, places in sorted(by_folder.items(), reverse=True)]
        if not parts:  # an empty table, or none of its buckets asked for
            return self.spark.read.parquet(f"{self.path}/columns/v{done[-1][0]:06d}")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version (the newest); None if there is none up to it."""
        rows = self._rows(version)
        return None if rows is None else rows.where(~F.col("__deleted")).drop("__deleted")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key]), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int, full: bool) -> int:
        number = max(self._folders(), default=-1) + 1
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns/v{number:06d}")  # a version without rows has no other file
        dealt = rows.withColumn("__bucket", self._bucket(buckets)).hint("rebalance", "__bucket")
        dealt.write.mode("errorifexists").partitionBy("__bucket").parquet(f"{self.path}/v{number:06d}-{buckets}-{'full' if full else 'part'}")
        return number

    def _apply(self, changes: DataFrame) -> int:
        done = self._committed()
        if not done:
            return self._write(changes, self._buckets, True)
        buckets = done[-1][2]
        touched = {r[0] for r in changes.select(self._bucket(buckets).alias("b")).distinct().collect()}  # as many as buckets at most
        if not touched:
            return done[-1][0]
        old = self._rows(only=touched)
        same = F.lit(True)
        for k in self.key:
            same = same & old[k].eqNullSafe(F.col(f"__new_{k}"))
        gone = changes.select(*[F.col(k).alias(f"__new_{k}") for k in self.key])
        return self._write(changes.unionByName(old.join(gone, same, "left_anti"), allowMissingColumns=True), buckets, False)

    def upsert(self, rows: DataFrame, sequence: str | Column) -> int:
        """Insert or replace rows by key, and give the number of the new version; of rows of equal key the last by ``sequence`` counts. No rows make no version, but in a new table."""
        return self._apply(last_wins(rows, self.key, sequence).withColumn("__deleted", F.lit(False)))

    def replace(self, rows: DataFrame, sequence: str | Column) -> int:
        """Start anew with these rows; older versions stay readable."""
        return self._write(last_wins(rows, self.key, sequence).withColumn("__deleted", F.lit(False)), self._buckets, True)

    def delete(self, keys: DataFrame) -> int:
        """Mark keys as deleted; keys that the table does not hold change nothing that is read."""
        return self._apply(keys.select(*self.key).distinct().withColumn("__deleted", F.lit(True)))

    def compact(self, buckets: int | None = None) -> int | None:
        """Write the newest rows as a full version, with another number of buckets if one is given; older versions stay readable."""
        rows = self._rows()
        if rows is None:
            return None
        return self._write(rows.where(~F.col("__deleted")), buckets or self._committed()[-1][2], True)
