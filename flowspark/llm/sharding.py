"""Sharding by size-tiered compaction over a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hadoop_fs

#: Size that shards grow to.
TARGET_BYTES = 64 << 20
#: Shards are of one tier if their sizes lie within this factor.
TIER_FACTOR = 4
#: A tier is merged once it has this many shards.
FAN_IN = 4
#: Rows of a shard as it arrives, and how many arrivals a whole table is dealt into.
ARRIVAL_ROWS = 4096
ARRIVALS = 8
#: Shards that one part of a manifest lists.
PART_SHARDS = 8192
#: Versions that stay readable.
KEEP_VERSIONS = 2


@dataclass(frozen=True)
class Shard:
    """An immutable Parquet file of the store."""

    path: str
    n_bytes: int


@dataclass(frozen=True)
class Part:
    """An immutable file of the manifest that lists some shards."""

    path: str
    shards: tuple[Shard, ...]


@dataclass(frozen=True)
class Manifest:
    """A version of the store: its shards, in parts that versions share."""

    version: int = 0
    parts: tuple[Part, ...] = ()

    @property
    def shards(self) -> tuple[Shard, ...]:
        return tuple(s for p in self.parts for s in p.shards)


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class ShardStore:
    """Documents in immutable Parquet shards, listed by numbered manifests in a folder that all executors share.

    A version is committed by renaming a complete file to ``manifest/<version>.json``, which fails if that name exists,
    so readers see all of a version or none, and of two writers one gets ``Conflict``; the folder must be on a file
    system with atomic renames, not a bare object store. A version names parts of the list, of which a commit writes
    only those that change. The driver holds a line for each shard, and never rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, root = hadoop_fs(spark, self.folder)
        self.fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _load(self, name: str):
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, data) -> None:
        out = self.fs.create(self._path(name), False)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("part", ".")))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, by default the newest; version 0 is empty."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return Manifest()
        data = self._load(f"manifest/{version:08d}.json")
        return Manifest(data["version"], tuple(Part(p, tuple(Shard(**s) for s in self._load(p))) for p in data["parts"]))

    def commit(self, before: Manifest, gone: set[Shard], new: list[Shard]) -> Manifest:
        """The version after `before`, without the shards that go and with the new ones behind the others, or Conflict."""
        parts, loose = [], []
        for part in before.parts:
            rest = [s for s in part.shards if s not in gone]
            if len(rest) == len(part.shards) and 2 * len(rest) > PART_SHARDS:
                parts.append(part)
            else:
                loose += rest
        loose += new
        for at in range(0, len(loose), PART_SHARDS):
            own = tuple(loose[at : at + PART_SHARDS])
            parts.append(Part(f"manifest/part-{uuid.uuid4().hex}.json", own))
            self._save(parts[-1].path, [asdict(s) for s in own])
        after = Manifest(before.version + 1, tuple(parts))
        draft, final = f"manifest/.{uuid.uuid4().hex}", self._path(f"manifest/{after.version:08d}.json")
        self._save(draft, {"version": after.version, "parts": [p.path for p in parts]})
        if self.fs.exists(final) or not self.fs.rename(self._path(draft), final):
            self.fs.delete(self._path(draft), False)
            raise Conflict(f"version {after.version} is taken")
        return after

    def _files(self, folder: str) -> list[Shard]:
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder))]
        return [Shard(f"{folder}/{n}", size) for n, size in sorted(found) if n.endswith(".parquet")]

    def append(self, rows: DataFrame, rows_per_shard: int = 0) -> Manifest:
        """Writes rows as small shards, one or more for each of their partitions, and commits them after those that are there."""
        return self.add(self.write(rows, rows_per_shard))

    def write(self, rows: DataFrame, rows_per_shard: int = 0, target_bytes: int = 0) -> list[Shard]:
        """Writes rows as shards that no version lists yet; with target_bytes, none is larger unless it holds one row only."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        if rows_per_shard:
            writer = writer.option("maxRecordsPerFile", rows_per_shard)
        writer.parquet(f"{self.folder}/{folder}")
        return [piece for s in self._files(folder) for piece in (self._cut(s, target_bytes) if target_bytes else [s])]

    def _cut(self, shard: Shard, target_bytes: int) -> list[Shard]:
        if shard.n_bytes <= target_bytes:
            return [shard]
        rows = self.spark.read.parquet(f"{self.folder}/{shard.path}")
        n = rows.count()
        if n <= 1:
            return [shard]
        return self.write(rows.coalesce(1), max(1, n // (2 * -(-shard.n_bytes // target_bytes))), target_bytes)

    def add(self, new: list[Shard]) -> Manifest:
        """Commits written shards after those that are there."""
        while True:  # other writers' shards stay; only the list is made anew
            try:
                return self.commit(self.manifest(), set(), new)
            except Conflict:
                time.sleep(0.05)

    def read(self, manifest: Manifest, shards: list[Shard] | tuple[Shard, ...] | None = None) -> DataFrame:
        """Rows of a version's shards, or of some of them."""
        shards = manifest.shards if shards is None else shards
        if not shards:
            raise ValueError("an empty version has no schema")
        return self.spark.read.parquet(*(f"{self.folder}/{s.path}" for s in shards))

    def compact(self, target_bytes: int = TARGET_BYTES) -> Manifest:
        """Merges tiers of similarly sized shards, a round and a version at a time, until `plan` finds none; returns the last version.

        A round is one job. Each merged shard is written by one task that reads its inputs, which together have at most
        target_bytes, one after the other: no row is shuffled. Inputs are deleted by `vacuum`, not here, so older
        versions stay readable. Where the scan can't be made to read as many inputs in a task, no shard would go away;
        then nothing is committed.
        """
        while tiers := plan(self.manifest().shards, target_bytes):
            new = self.write(self._packed(tiers, target_bytes))
            if len(new) >= sum(map(len, tiers)):
                self.fs.delete(self._path(new[0].path.rpartition("/")[0]), True)
                break
            self._replace({s for tier in tiers for s in tier}, new)
        return self.manifest()

    def _packed(self, tiers: list[list[Shard]], target_bytes: int) -> DataFrame:
        """The rows of each tier, in partitions of whole shards of up to target_bytes together: the scan packs its files so."""
        session = self.spark.newSession()  # settings of its own
        for key, value in {
            "spark.sql.files.maxPartitionBytes": target_bytes, "spark.sql.files.openCostInBytes": 1, "spark.sql.files.minPartitionNum": 1,
            "spark.sql.files.maxPartitionNum": 1 << 30, "spark.sql.unionOutputPartitioning": "false",
        }.items():
            session.conf.set(key, str(value))
        schema = self.read(self.manifest(), tiers[0][:1]).schema
        return reduce(DataFrame.union, (session.read.schema(schema).parquet(*(f"{self.folder}/{s.path}" for s in tier)) for tier in tiers))

    def _replace(self, gone: set[Shard], new: list[Shard]) -> None:
        while True:
            now = self.manifest()
            if not gone <= set(now.shards):
                raise Conflict("another writer has merged the same shards")
            try:
                self.commit(now, gone, new)
                return
            except Conflict:
                time.sleep(0.05)

    def vacuum(self, keep_versions: int = KEEP_VERSIONS) -> int:
        """Deletes files that none of the last versions lists, and older manifests; returns the number of shards deleted.

        Not to be run beside a writer, whose files no version lists yet.
        """
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep_versions:]]
        wanted = {s.path for m in kept for s in m.shards}
        n = 0
        data = self._path("data")
        for folder in [s.getPath().getName() for s in self.fs.listStatus(data)] if self.fs.exists(data) else []:
            files = [f"data/{folder}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(f"data/{folder}"))]
            stale = [f for f in files if f not in wanted and f.endswith(".parquet")]
            n += len(stale)
            if not any(f in wanted for f in files):
                self.fs.delete(self._path(f"data/{folder}"), True)
            else:
                for f in stale:
                    self.fs.delete(self._path(f), False)
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"manifest/{v:08d}.json"), False)
        parts = {p.path for m in kept for p in m.parts}
        for name in [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]:
            if name.startswith("part-") and f"manifest/{name}" not in parts:
                self.fs.delete(self._path(f"manifest/{name}"), False)
        return n


def plan(shards: tuple[Shard, ...], target_bytes: int) -> list[list[Shard]]:
    """Tiers to merge: of shards below half the target, those whose sizes differ by at most TIER_FACTOR, if there are FAN_IN or more.

    The smallest shard that no tier has yet begins the next one. Shards of half the target and more are done.
    """
    tiers: list[list[Shard]] = []
    for s in sorted((s for s in shards if 2 * s.n_bytes < target_bytes), key=lambda s: (s.n_bytes, s.path)):
        if tiers and s.n_bytes <= TIER_FACTOR * max(1, tiers[-1][0].n_bytes):
            tiers[-1].append(s)
        else:
            tiers.append([s])
    return [tier for tier in tiers if len(tier) >= FAN_IN]


def sharded(docs: DataFrame, folder: str, *, target_bytes: int = TARGET_BYTES, rows_per_shard: int = ARRIVAL_ROWS, arrivals: int = ARRIVALS) -> tuple[ShardStore, Manifest]:
    """Adds docs to the store in folder by small arrivals, compacts its tiers after each, and drops what the last KEEP_VERSIONS versions don't need.

    One job writes shards of up to rows_per_shard rows, none above target_bytes unless it is a single row; they are
    committed arrival by arrival. What stays below half the target are fewer than FAN_IN shards of each tier, until more
    arrive. Rows are kept as they are, whatever their columns hold: nulls, texts of any length, repeated rows. An empty
    table makes a version whose shards hold its schema and no rows. Column names must differ by more than case, as
    Parquet asks; others are refused.
    """
    if len({c.lower() for c in docs.columns}) < len(docs.columns):
        raise ValueError("shards can't keep columns whose names differ in case only")
    store = ShardStore(docs.sparkSession, folder)
    new = store.write(docs, rows_per_shard, target_bytes)
    each = max(1, -(-len(new) // arrivals))
    for at in range(0, len(new), each):
        store.add(new[at : at + each])
        store.compact(target_bytes)
    store.vacuum()
    return store, store.manifest()


def placements(store: ShardStore, manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Where a version keeps each row: doc_id, version, shard (file name), row (place in the shard), shard_bytes; read back from the shards.

    A shard is read from its start to its end by one task or more, each of which knows the places of its rows.
    """
    rows = store.read(manifest)
    meta = rows.metadataColumn("_metadata")
    return rows.select(
        rows[id_col].alias("doc_id"), F.lit(manifest.version).cast("long").alias("version"), meta["file_name"].alias("shard"),
        meta["row_index"].alias("row"), meta["file_size"].alias("shard_bytes"),
    )
