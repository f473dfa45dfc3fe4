"""Stored tables by key, in versions: an upsert rewrites the parts it touches and then switches to them.

A table is a folder::

    data/<write>/__part=<p>/   Parquet files of one write, never changed afterwards
    versions/<n>/             one row of JSON: the columns, and for each part the write that holds it

A part is a hash bucket of the key (tables without a date) or a month.  An upsert reads the touched parts of the newest version,
merges, writes them under a new write, and at last adds version n + 1.  A version counts once Spark has committed it
(``_SUCCESS``), so a reader sees all parts of a write or none, a failed write leaves the old rows, and an upsert that is
repeated gives the same table.  The columns are those of the version, so no footer has to be read to know them.

There is one writer at a time: a second one that adds the same version number fails.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from backline.session import checkpoint_dir
from backline.sources.merging import upsert, upsert_placed

BUCKETS = 64
SLOT = 8 << 20  # bytes of Parquet; a larger part is divided over tasks when an upsert writes it again


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    parts: dict[str, str]  # part -> write


class StoredTable:
    """A keyed table below ``path``; at most a few thousand parts, which the driver knows by name."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], part: Column | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path, list(key)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(buckets)) if part is None else part
        self.part = F.coalesce(bucket.cast("string"), F.lit("none"))
        self._fs = None

    # --- versions ---------------------------------------------------------------------------

    def _paths(self, folder: str) -> list:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        self._fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        done = [p for p in self._paths("versions") if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or the given one; None if the table has none."""
        numbers = self._numbers()
        if not numbers or (number is not None and number not in numbers):
            return None
        number = numbers[-1] if number is None else number
        row = self.spark.read.schema("columns string, parts string").json(f"{self.path}/versions/{number:010d}").first()
        return Version(number, T.StructType.fromJson(json.loads(row.columns)), json.loads(row.parts))

    def _commit(self, number: int, schema: T.StructType, parts: Mapping[str, str]) -> None:
        one = self.spark.createDataFrame([(schema.json(), json.dumps(parts))], "columns string, parts string")
        one.coalesce(1).write.json(f"{self.path}/versions/{number:010d}")

    # --- rows -------------------------------------------------------------------------------

    def read(self, parts: Sequence[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of the newest (or given) version, of the given parts or all; None if there is no table yet."""
        now = self.version(version)
        return None if now is None else self._rows(now, parts)

    def _rows(self, now: Version, parts: Sequence[str] | None) -> DataFrame:
        chosen = [f"{self.path}/data/{w}/__part={p}" for p, w in sorted(now.parts.items()) if parts is None or p in set(parts)]
        return self.spark.read.schema(now.schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], now.schema)

    def parts_of(self, rows: DataFrame) -> list[str]:
        """Names of the parts that the rows belong to."""
        return [r[0] for r in rows.select(self.part.alias("p")).distinct().collect()]

    def upsert(self, delta: DataFrame, merge: Mapping | None = None) -> int:
        """Lay ``delta`` (one row per key) over the table; returns the number of the new version.

        Columns that the delta lacks keep their values, columns that are new are null in the other rows;
        ``merge[c](new, old)`` decides between two values, otherwise the new one counts.
        """
        now, write = self.version(), uuid.uuid4().hex
        if now is None:
            self._write(delta, write)
            touched = [p.getName().removeprefix("__part=") for p in self._paths(f"data/{write}") if p.getName().startswith("__part=")]
            if touched:
                self._commit(1, delta.schema, {p: write for p in touched})
            return 1 if touched else 0
        # read for the parts it touches and again for its rows: compressed files, not a checkpoint of uncompressed rows
        staged = f"{checkpoint_dir(self.spark)}/delta-{write}"
        delta.write.parquet(staged)
        try:
            return self._lay_over(now, self.spark.read.schema(delta.schema).parquet(staged), staged, write, merge)
        finally:
            self._remove(staged)

    def _lay_over(self, now: Version, delta: DataFrame, staged: str, write: str, merge: Mapping | None) -> int:
        counts = {r["p"]: r["count"] for r in delta.groupBy(self.part.alias("p")).count().collect()}
        if not counts:
            return now.number
        more = [f for f in delta.schema.fields if f.name not in now.schema.fieldNames()]
        schema = T.StructType([*now.schema.fields, *more])
        old = self._rows(now, list(counts)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
        if self._keyed(delta):
            placed = upsert_placed(old, delta, self.key, {"__part": self.part, "__slot": self._slot(now, counts, staged)}, merge)
            placed.drop("__slot").write.partitionBy("__part").parquet(f"{self.path}/data/{write}")
        else:
            self._write(upsert(old, delta, self.key, merge), write)
        self._commit(now.number + 1, schema, now.parts | {p: write for p in counts})
        return now.number + 1

    def _write(self, rows: DataFrame, write: str) -> None:
        # parts of any size: large ones are divided over tasks, small ones share a task
        rows.withColumn("__part", self.part).hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{self.path}/data/{write}")

    def _keyed(self, delta: DataFrame) -> bool:
        """Whether the part follows from the key, so that a row stays in its part whatever is laid over it."""
        try:
            return bool(delta.select(*self.key).select(self.part).schema)
        except AnalysisException:
            return False

    def _slot(self, now: Version, counts: Mapping[str, int], staged: str) -> Column:
        """The key's slot in its part: a part has one for every ``SLOT`` bytes of its old files and its share of the new ones."""
        each = self._bytes(staged) / sum(counts.values())
        size = {p: n * each + (self._bytes(f"{self.path}/data/{now.parts[p]}/__part={p}") if p in now.parts else 0) for p, n in counts.items()}
        slots = [x for p, b in sorted(size.items()) if b > SLOT for x in (F.lit(p), F.lit(math.ceil(b / SLOT)))]
        if not slots:
            return F.lit(0)
        return F.pmod(F.hash(*self.key), F.coalesce(F.try_element_at(F.create_map(*slots), self.part), F.lit(1)))

    def _bytes(self, folder: str) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def _remove(self, folder: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def forget(self, parts: Sequence[str]) -> None:
        """A new version without the given parts."""
        now = self.version()
        if now is not None and (left := {p: w for p, w in now.parts.items() if p not in set(parts)}) != now.parts:
            self._commit(now.number + 1, now.schema, left)

    def vacuum(self, keep: int = 1) -> int:
        """Remove versions before the last ``keep`` and the files that no kept version names; returns the files' folders removed.

        Only folders written before the newest version are touched, so run it when no writer is busy.
        """
        numbers = self._numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {(w, p) for v in kept for p, w in v.parts.items()}
        gone = 0
        for write in self._paths("data"):
            folders = [s.getPath() for s in self._fs.listStatus(write) if s.isDirectory()]
            dead = [f for f in folders if (write.getName(), f.getName().removeprefix("__part=")) not in named]
            for f in [write] if len(dead) == len(folders) else dead:
                self._fs.delete(f, True)
            gone += len(dead)
        for path in self._paths("versions"):
            if numbers[:-keep] and int(path.getName()) in numbers[:-keep]:
                self._fs.delete(path, True)
        return gone


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def by_month(spark: SparkSession, path: str, key: Sequence[str], day: str, spread: Sequence[str] = (), buckets: int = 1) -> StoredTable:
    """A table whose parts are the months of ``day``, each divided into ``buckets`` by the hash of the columns ``spread``."""
    month = month_of(day)
    if spread:
        month = F.concat_ws("-", month, F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("string"))
    return StoredTable(spark, path, key, month)
