"""Tables of keyed rows that change by small commits: new rows and lists of what goes, in buckets, merged by readers.

A version is one small file that names the data files of each bucket.  Writers put data files first and then publish the
next version; a version that exists can't be published again, so of two writers one begins anew on top of the other.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import hadoop_fs, remove

#: Entries of lists of what goes up to this many are broadcast; more are joined by a shuffle.
BROADCAST_GONE = 1_000_000
#: Writers that meet try again so often.
TRIES = 20


class Conflict(Exception):
    """Another writer has published the version."""


@dataclass(frozen=True)
class DataFile:
    """A file of a bucket; ``run`` is the version that brought it, ``gone`` tells rows from lists of what goes."""

    bucket: int
    run: int
    gone: bool
    name: str
    bytes: int


@dataclass(frozen=True)
class Version:
    """``gone`` is the number of entries in lists of what goes; ``state`` is the caller's, published with the rows."""

    number: int
    files: tuple[DataFile, ...]
    gone: int
    state: dict


class KeyedTable:
    """Rows by ``key`` (a column of ``schema``), of which a key may have many, told apart by ``member`` if that is given.

    ``put`` replaces all rows of its keys, ``delete`` takes keys or single members out, ``insert`` adds rows of keys that
    aren't there.  A change writes files for the buckets of its keys and nothing else.  Where a bucket has lists of what
    goes, readers leave out the rows that an earlier version brought; ``merge`` writes buckets of many files anew.  ``expire`` removes versions and files that no kept version names.

    Null keys are a key like others.  Rows of one key are dealt to several files if they are very many.  The driver holds
    names of files only: as many as buckets and changes since they were merged.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, member: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.member, self.buckets = spark, path.rstrip("/"), key, member, buckets
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        names = [key, *([member] if member else [])]
        self.entry = StructType([self.schema[n] for n in names])

    # Versions.

    def _numbers(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """A version, the latest by default; version 0 is empty."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return Version(0, (), 0, {})
        fs, p = hadoop_fs(self.spark, f"{self.path}/versions/{number:010d}.json")
        stream = fs.open(p)
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["buckets"] != self.buckets:
            raise ValueError(f"the table has {found['buckets']} buckets, not {self.buckets}")
        return Version(number, tuple(DataFile(*f) for f in found["files"]), found["gone"], found["state"])

    def _publish(self, version: Version) -> None:
        """Make a version visible, unless one of its number is: a rename that doesn't overwrite."""
        files = [[f.bucket, f.run, f.gone, f.name, f.bytes] for f in version.files]
        value = {"buckets": self.buckets, "files": files, "gone": version.gone, "state": version.state}
        fs, draft = hadoop_fs(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        _, final = hadoop_fs(self.spark, f"{self.path}/versions/{version.number:010d}.json")
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        plain = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration()).rename(draft, final, plain)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version.number} is there") from error
            raise

    # Data files.

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows as files by bucket.  Adaptive planning splits buckets that are very large."""
        dealt = rows.withColumn("__bucket", self.bucket(self.key)).hint("rebalance", "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")

    def _files(self, folder: str, run: int, gone: bool) -> list[DataFile]:
        fs, top = hadoop_fs(self.spark, f"{self.path}/data/{folder}")
        out = []
        if fs.exists(top):
            walk = fs.listFiles(top, True)
            while walk.hasNext():
                f = walk.next()
                name = f.getPath().getName()
                if name.endswith(".parquet"):
                    part = f.getPath().getParent().getName()
                    out.append(DataFile(int(part.removeprefix("__bucket=")), run, gone, f"{folder}/{part}/{name}", f.getLen()))
        return out

    def _read(self, files: list[DataFile], schema: StructType, numbered: bool) -> DataFrame:
        """Rows of data files, with the version that brought them (``__run``) if asked for."""
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f.name}" for f in files))
        if numbered:
            folders = sorted({(f.name.split("/")[0], f.run) for f in files})
            run = F.create_map(*(F.lit(x) for pair in folders for x in pair))
            folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/__bucket=", 1)
            rows = rows.select("*", run[folder].alias("__run"))
        return rows

    # Readers.

    def read(self, version: Version | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default, or those of some buckets."""
        v = self.version() if version is None else version
        files = [f for f in v.files if buckets is None or f.bucket in buckets]
        newest = {}
        for f in files:
            if f.gone:
                newest[f.bucket] = max(f.run, newest.get(f.bucket, 0))
        plain = [f for f in files if not f.gone and f.run >= newest.get(f.bucket, 0)]
        older = [f for f in files if not f.gone and f.run < newest.get(f.bucket, 0)]
        parts = [self._read(plain, self.schema, False)] if plain else []
        if older:
            parts.append(self._left(self._read(older, self.schema, True), self._read([f for f in files if f.gone], self.entry, True), v.gone))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def _left(self, rows: DataFrame, gone: DataFrame, entries: int) -> DataFrame:
        """Rows that no later list names."""
        names = [f.name for f in self.entry]
        last = gone.groupBy(*names).agg(F.max("__run").alias("__gone")).select(*(F.col(n).alias(f"__{i}") for i, n in enumerate(names)), "__gone")

        def without(rows: DataFrame, last: DataFrame, on: Column) -> DataFrame:
            last = F.broadcast(last) if entries <= BROADCAST_GONE else last
            return rows.join(last, on & (F.col("__run") < F.col("__gone")), "left_anti")

        key = F.col(self.key).eqNullSafe(F.col("__0"))
        if not self.member:
            return without(rows, last, key).drop("__run")
        rows = without(rows, last.where("__1 is null"), key)
        return without(rows, last.where("__1 is not null"), key & (F.col(self.member) == F.col("__1"))).drop("__run")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys (one column), from their buckets alone."""
        keys = keys.select(F.col(keys.columns[0]).alias("__key")).distinct()
        rows = self.read(buckets=self._touched(keys, "__key"))
        return rows.join(keys, rows[self.key].eqNullSafe(keys["__key"]), "left_semi")

    def _touched(self, rows: DataFrame, key: str | None = None) -> set[int]:
        return {r[0] for r in rows.select(self.bucket(key or self.key)).distinct().collect()}  # as many as buckets

    def changes(self, before: Version, after: Version | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows that came, rows that went) from one version to another, whatever was merged between them, by some columns if
        those are named.  Only buckets whose files differ are read."""
        after = self.version() if after is None else after
        touched = {f.bucket for f in {*before.files} ^ {*after.files}}
        merged = {f.bucket for f in {*before.files} - {*after.files}}
        old, new = [], []
        if touched - merged:  # what both versions have in a file stays, unless a later list names it
            added = [f for f in after.files if f.bucket in touched - merged and f not in {*before.files}]
            new.append(self.read(Version(after.number, tuple(added), after.gone, {})))
            if gone := [f for f in added if f.gone]:
                old.append(self._named(self.read(before, {f.bucket for f in gone}), self._read(gone, self.entry, False), after.gone))
        if merged:
            old.append(self.read(before, merged))
            new.append(self.read(after, merged))
        if not old:
            old.append(self.spark.createDataFrame([], self.schema))
        old, new = (reduce(DataFrame.unionByName, x).select(*(columns or self.schema.names)) for x in (old, new))
        return (new.exceptAll(old), old.exceptAll(new)) if before.files else (new, old)

    def _named(self, rows: DataFrame, gone: DataFrame, entries: int) -> DataFrame:
        """Rows that a list names."""
        names = [f.name for f in self.entry]
        listed = gone.distinct().select(*(F.col(n).alias(f"__{i}") for i, n in enumerate(names)))
        on = F.col(self.key).eqNullSafe(F.col("__0"))
        if self.member:
            on = on & (F.col("__1").isNull() | (F.col(self.member) == F.col("__1")))
        return rows.join(F.broadcast(listed) if entries <= BROADCAST_GONE else listed, on, "left_semi")

    # Writers.

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, state: dict | None = None, base: Version | None = None) -> Version:
        """Publish rows that come and entries (key, and member, null for all of them) that go from what was there before.

        On top of ``base`` the change is tried once, and a :class:`Conflict` is the caller's; without it, it goes on top of
        whatever is there.  Files of a change that isn't published are removed.
        """
        folder, names = uuid.uuid4().hex, [f.name for f in self.schema]
        try:
            if rows is not None:
                self._write(rows.select(*names), f"r{folder}")
            if gone is not None:
                self._write(gone.select(*(f.name for f in self.entry)), f"g{folder}")
            found = self._files(f"g{folder}", 0, True)
            entries = self._read(found, self.entry, False).count() if found else 0  # by the files' ends alone
            for left in reversed(range(TRIES if base is None else 1)):
                now = self.version() if base is None else base
                run = now.number + 1
                there = {f.bucket for f in now.files if not f.gone}
                lists = [f for f in self._files(f"g{folder}", run, True) if f.bucket in there]  # elsewhere nothing can go
                files = [*now.files, *self._files(f"r{folder}", run, False), *lists]
                try:
                    made = Version(run, tuple(files), now.gone + entries * bool(lists), now.state if state is None else state)
                    self._publish(made)
                    return made
                except Conflict:
                    if not left:
                        raise
        except BaseException:
            for kind in "rg":
                remove(self.spark, f"{self.path}/data/{kind}{folder}")
            raise

    def put(self, rows: DataFrame, state: dict | None = None) -> Version:
        """Rows in place of all of the same keys."""
        keys = rows.select(self.key).distinct()
        return self.change(rows, keys.withColumn(self.member, F.lit(None).cast(self.schema[self.member].dataType)) if self.member else keys, state)

    def delete(self, keys: DataFrame, state: dict | None = None) -> Version:
        """Take out all rows of the keys (one column)."""
        entries = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        if self.member:
            entries = entries.withColumn(self.member, F.lit(None).cast(self.schema[self.member].dataType))
        return self.change(gone=entries, state=state)

    def replace(self, rows: DataFrame, state: dict | None = None) -> Version:
        """Rows in place of all that is there, whoever wrote it."""
        folder = f"r{uuid.uuid4().hex}"
        try:
            self._write(rows.select(*self.schema.names), folder)
            for left in reversed(range(TRIES)):
                now = self.version()
                try:
                    made = Version(now.number + 1, tuple(self._files(folder, now.number + 1, False)), 0, now.state if state is None else state)
                    self._publish(made)
                    return made
                except Conflict:
                    if not left:
                        raise
        except BaseException:
            remove(self.spark, f"{self.path}/data/{folder}")
            raise

    def missing(self, keyed: DataFrame) -> tuple[DataFrame, Version]:
        """Those rows of ``keyed`` whose key isn't there, and the version that was looked at.  The buckets of its keys are read."""
        base = self.version()
        there = self.read(base, self._touched(keyed)).select(F.col(self.key).alias("__there")).distinct()
        return keyed.join(there, keyed[self.key].eqNullSafe(there["__there"]), "left_anti"), base

    def insert(self, rows: DataFrame, base: Version) -> Version:
        """Add rows of keys that weren't there in ``base``, a row for each.  Rows are made once, whoever writes meanwhile: after
        a conflict, those that another writer has added are left out of what was written."""
        draft = f"{self.path}/draft/{uuid.uuid4().hex}"
        rows.select(*(f.name for f in self.schema)).write.parquet(draft)
        try:
            made = self.spark.read.schema(self.schema).parquet(draft)
            for left in reversed(range(TRIES)):
                try:
                    return base if made.isEmpty() else self.change(made, base=base)
                except Conflict:
                    if not left:
                        raise
                    made, base = self.missing(made)
        finally:
            remove(self.spark, draft)

    # Upkeep.

    def merge(self, files: int = 8) -> Version:
        """Write buckets anew that have more files than ``files``, lists of what goes included; so what changes cost is
        shared by many.  With 0, all buckets are."""
        for left in reversed(range(TRIES)):
            base = self.version()
            number: dict[int, int] = {}
            for f in base.files:
                number[f.bucket] = number.get(f.bucket, 0) + 1
            worn = {b for b, n in number.items() if n > files}
            if not worn:
                return base
            folder = f"r{uuid.uuid4().hex}"
            self._write(self.read(base, worn), folder)
            kept = [f for f in base.files if f.bucket not in worn]
            try:
                gone = base.gone if any(f.gone for f in kept) else 0
                made = Version(base.number + 1, (*kept, *self._files(folder, base.number + 1, False)), gone, base.state)
                self._publish(made)
                return made
            except BaseException as error:
                remove(self.spark, f"{self.path}/data/{folder}")
                if not left or not isinstance(error, Conflict):
                    raise

    def expire(self, keep: int = 1, age: float = 3600) -> None:
        """Remove all but the ``keep`` latest versions, and data files that none of those names and that are older than ``age``
        seconds: younger ones may be another writer's."""
        numbers = self._numbers()
        for n in numbers[: max(0, len(numbers) - keep)]:
            remove(self.spark, f"{self.path}/versions/{n:010d}.json")
        named = {f.name for n in numbers[-keep:] for f in self.version(n).files}
        fs, top = hadoop_fs(self.spark, f"{self.path}/data")
        if not fs.exists(top):
            return
        before, walk = (time.time() - age) * 1000, fs.listFiles(top, True)
        while walk.hasNext():
            f = walk.next()
            name = str(f.getPath()).rpartition("/data/")[2]
            if name not in named and f.getModificationTime() <= before:
                fs.delete(f.getPath(), False)
