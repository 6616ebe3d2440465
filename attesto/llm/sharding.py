"""Immutable shards under a versioned manifest, merged by size tiers."""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workspace import hadoop_fs, remove

#: Merged files have about TARGET_BYTES; a tier is merged when it holds FANOUT files or more.
TARGET_BYTES, FANOUT = 128 << 20, 4
#: Files up to this size are tier 0; each further tier is FANOUT times larger.
SMALL_BYTES = 1 << 20
#: Groups that one job merges, a task each, and jobs that run side by side.
MERGES, JOBS = 256, 4
#: How often a commit is tried anew after another writer came first.
TRIES = 20
#: Names of files up to this many (some 20 MB) are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 200_000


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int


@dataclass(frozen=True)
class Version:
    """A version of the table: for each tier the file that lists its shards.  Version 0 is the table before its first
    commit; it has no schema."""

    number: int
    schema: str | None
    lists: dict[int, str]

    def columns(self) -> StructType:
        if self.schema is None:
            raise ValueError("the table has no version")
        return StructType.fromJson(json.loads(self.schema))


def tier(size: int, fanout: int = FANOUT, small: int = SMALL_BYTES) -> int:
    return 0 if size <= small else math.ceil(math.log(size / small, fanout) - 1e-9)


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups of files to merge: within a tier that has enough files below half the target, runs in order of size
    that add up to the target at most."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target // 2:
            tiers.setdefault(tier(s.bytes, fanout), []).append(s)
    out = []
    for t in sorted(tiers):
        if len(tiers[t]) < fanout:
            continue
        group, size = [], 0
        for s in sorted(tiers[t], key=lambda s: (s.bytes, s.file)):
            if group and size + s.bytes > target:
                out.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        out.append(group)
    return [g for g in out if len(g) > 1]


def _union(parts: list[DataFrame]) -> DataFrame:
    """One table of many, as a balanced tree: each step looks at its two halves only."""
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class ShardStore:
    """A table as immutable Parquet files.  A version is a small file in ``path``/manifests that names, for each tier, a
    list of shards; a commit writes anew only the lists of tiers that it changes.

    Writers put files below ``path``/data first and then commit a version by a rename that fails if the version
    exists, so readers see all of a change or nothing.  The later of two writers tries again on top of the earlier
    one; merged shards that another writer has taken out meanwhile are planned anew.  Files of a job or a commit that
    failed are removed, or, if the writer itself was lost, by ``expire`` with an age.  The driver holds names and
    sizes of files only.

    Rows are stored as they come: nulls in any column, repeated rows, empty and very long texts stay as they are, and
    nothing is sorted or dropped.  An arrival without rows makes a version without new shards.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout

    # Versions.

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _get(self, name: str):
        fs, p = hadoop_fs(self.spark, f"{self.path}/manifests/{name}")
        source = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _put(self, name: str, value) -> None:
        fs, p = hadoop_fs(self.spark, f"{self.path}/manifests/{name}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def version(self, number: int | None = None) -> Version:
        """A version, the latest by default."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return Version(0, None, {})
        found = self._get(f"v{number:08d}.json")
        return Version(number, found["schema"], {int(t): f for t, f in found["lists"].items()})

    def shards(self, version: Version | int | None = None, below: int | None = None) -> list[Shard]:
        """The shards of a version, or those of tiers that hold shards of fewer than ``below`` bytes."""
        v = version if isinstance(version, Version) else self.version(version)
        lists = [v.lists[t] for t in sorted(v.lists) if below is None or t <= tier(below, self.fanout)]
        return [Shard(*s) for name in lists for s in self._get(name)]

    def commit(self, base: Version, schema: str, added: list[Shard], removed: frozenset[str] = frozenset()) -> Version:
        """The version after ``base``; :class:`Conflict` if there is one already."""
        lists, wrote = dict(base.lists), []
        new = {t: [s for s in added if tier(s.bytes, self.fanout) == t] for t in {tier(s.bytes, self.fanout) for s in added}}
        for t in sorted({*lists, *new} if removed else new):
            old = self._get(lists[t]) if t in lists else []
            now = [s for s in old if s[0] not in removed] + [[s.file, s.bytes] for s in new.get(t, ())]
            if now == old:
                continue
            lists.pop(t, None)
            if now:
                lists[t] = f"tier-{t}-{uuid.uuid4().hex}.json"
                self._put(lists[t], now)
                wrote.append(lists[t])
        number, temporary = base.number + 1, f".{uuid.uuid4().hex}"
        self._put(temporary, {"version": number, "schema": schema, "lists": lists})
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, source = hadoop_fs(self.spark, f"{self.path}/manifests/{temporary}")
        _, final = hadoop_fs(self.spark, f"{self.path}/manifests/v{number:08d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, final, options)
        except Exception as error:
            for name in [temporary, *wrote]:
                remove(self.spark, f"{self.path}/manifests/{name}")
            if fs.exists(final):
                raise Conflict(f"version {number} is taken") from error
            raise
        return Version(number, schema, lists)

    # Changes.

    def _written(self, folder: str) -> list[Shard]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/data/{folder}")
        return [Shard(f"{folder}/{x.getPath().getName()}", x.getLen()) for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")]

    def _add(self, folders: list[str], schema: StructType) -> int:
        """Commit each folder's files as a version, on top of whatever came first."""
        done = 0
        try:
            for done, folder in enumerate(folders):
                rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/data/{folder}")
                shards = [] if rows.isEmpty() else self._written(folder)
                for left in reversed(range(TRIES)):
                    base = self.version()
                    if base.schema is not None and base.columns() != schema:
                        raise ValueError("the arrival's columns aren't the table's")
                    try:
                        number = self.commit(base, schema.json(), shards).number
                        break
                    except Conflict:
                        if not left:
                            raise
                if not shards:
                    remove(self.spark, f"{self.path}/data/{folder}")
        except Exception:
            for folder in folders[done:]:
                remove(self.spark, f"{self.path}/data/{folder}")
            raise
        return number

    def _fits(self, schema: StructType) -> None:
        base = self.version()
        if base.schema is not None and base.columns() != schema:
            raise ValueError("the arrival's columns aren't the table's")

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards, one for each task that has rows; returns the new version."""
        self._fits(rows.schema)
        folder = f"run-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return self._add([folder], rows.schema)

    def append_each(self, rows: DataFrame, arrival: Column) -> int:
        """Add several arrivals that were read together: one job writes them, the rows of each value of ``arrival`` (a
        number) become a run and a version of their own, in order.  Returns the last version."""
        self._fits(rows.schema)
        run, column = f"run-{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        rows.withColumn(column, arrival).write.option("compression", "zstd").partitionBy(column).parquet(f"{self.path}/data/{run}")
        fs, p = hadoop_fs(self.spark, f"{self.path}/data/{run}")
        names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        if not names:
            remove(self.spark, f"{self.path}/data/{run}")
            return self.append(rows.limit(0))

        def place(name: str) -> tuple[bool, int]:  # rows without a number come last
            number = name.partition("=")[2]
            return (False, int(number)) if re.fullmatch(r"-?\d+", number) else (True, 0)

        return self._add([f"{run}/{name}" for name in sorted(names, key=place)], rows.schema)

    def compact(self) -> int:
        """Merge tiers until none has enough small files; returns the latest version.  Each round is one version.

        A group is read and written by one task of at most the target's size; one job merges MERGES groups, as many
        tasks, and JOBS jobs run side by side.  Rows never shuffle, whatever their keys.
        """
        while True:
            base = self.version()
            groups = plan(self.shards(base, self.target // 2), self.target, self.fanout)
            if not groups:
                return base.number
            folders = [f"merge-{uuid.uuid4().hex}" for _ in range(0, len(groups), MERGES)]

            def merge(i: int, base=base, groups=groups, folders=folders) -> list[Shard]:
                parts = [self._rows(base.columns(), g).coalesce(1) for g in groups[i * MERGES : (i + 1) * MERGES]]
                _union(parts).write.option("compression", "zstd").parquet(f"{self.path}/data/{folders[i]}")
                return self._written(folders[i])

            try:
                with ThreadPoolExecutor(JOBS) as pool:
                    new = [s for part in pool.map(merge, range(len(folders))) for s in part]
                gone = frozenset(s.file for g in groups for s in g)
                for left in reversed(range(TRIES)):
                    try:
                        self.commit(base, base.schema, new, gone)
                        break
                    except Conflict:
                        base = self.version()
                        if not left or not gone <= {s.file for s in self.shards(base)}:
                            raise
            except Conflict:  # another writer merged some of them: what was made is of no use
                for folder in folders:
                    remove(self.spark, f"{self.path}/data/{folder}")
            except Exception:
                for folder in folders:
                    remove(self.spark, f"{self.path}/data/{folder}")
                raise

    def expire(self, keep: int = 1, orphans_after: float | None = None) -> None:
        """Delete the versions before the latest ``keep``, and the lists and shards that only they name; with an age in
        seconds, also files of that age that no version names, as a writer leaves that was lost before its commit."""
        versions = [self.version(n) for n in self.versions()]
        old, live = versions[:-keep], versions[-keep:]
        lists = {f for v in live for f in v.lists.values()}
        shards = {s[0] for name in lists for s in self._get(name)}
        gone = {f for v in old for f in v.lists.values()} - lists
        files = {s[0] for name in gone for s in self._get(name)} - shards
        for name in [f"manifests/v{v.number:08d}.json" for v in old] + [f"manifests/{f}" for f in gone] + [f"data/{f}" for f in files]:
            remove(self.spark, f"{self.path}/{name}")
        if orphans_after is not None:
            fs, top = hadoop_fs(self.spark, f"{self.path}/data")
            found, before = fs.listFiles(top, True), (time.time() - orphans_after) * 1000
            while found.hasNext():
                x = found.next()
                name = x.getPath().toUri().getPath()[len(top.toUri().getPath()) + 1 :]
                if name not in shards and x.getModificationTime() <= before:
                    fs.delete(x.getPath(), False)

    # Reading.

    def _rows(self, kind: StructType, shards: list[Shard]) -> DataFrame:
        # Without the lookup option, the folder of an arrival would be read as a column.
        files = [f"{self.path}/data/{s.file}" for s in shards]
        return self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        v = self.version(version)
        return self._rows(v.columns(), self.shards(v))

    def located(self, version: int | None = None, shard: str = "__shard", level: str = "__tier") -> DataFrame:
        """The rows of a version with ``shard``, the place of their file in the version's list, and ``level``, its tier.  If
        the table has a column of such a name, underscores are put before it."""
        v = self.version(version)
        shards = self.shards(v)
        rows = self._rows(v.columns(), shards)
        for name in rows.columns:
            while name.lower() in (shard.lower(), level.lower()):
                shard, level = f"_{shard}", f"_{level}"
        file, own = f"file_{uuid.uuid4().hex}", f"own_{uuid.uuid4().hex}"
        # The table has a row for each file, which the driver lists anyway; it is sent to all tasks if there are few.
        places = [(s.file, i, tier(s.bytes, self.fanout)) for i, s in enumerate(shards)]
        table = self.spark.createDataFrame(places, f"`{file}` string, `{shard}` int, `{level}` int")
        named = rows.withColumn(own, F.regexp_extract(F.input_file_name(), "^.*/data/(.*)$", 1))
        return named.join(F.broadcast(table) if len(places) <= BROADCAST_FILES else table, F.col(own) == F.col(file), "left").drop(own, file)
