"""Sharding by size-tiered compaction: arrivals become small immutable runs, similarly sized runs merge into files of a
target size, and every change commits a new version of the manifest.

A store is a folder: ``runs/<name>`` holds Parquet files that never change, ``manifest/v<number>.json`` lists the runs of a
version. A version is written under another name and renamed, and a rename onto an existing version fails; so a version
appears whole or not at all, and of two writers that start from the same version one has to begin again: an append adds its
runs, all in one version, to whatever the newest version holds; a merge is made anew if one of its sources is gone. Nothing
that a version names is deleted but by ``vacuum``, which spares recent versions and young folders. Merging reads and
writes without a shuffle: scan splits are gathered, not dealt anew. A run whose files have reached half the target is
sealed; so each row is rewritten about log(target / arrival) / log(fanout) times and never again.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.base_bytes, self.fanout = target_bytes, base_bytes, fanout
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at("manifest"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- manifest ----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        v = self.version() if version is None else version
        if v == 0:
            return []
        return json.loads("".join(r[0] for r in self.spark.read.text(str(self._at(f"manifest/v{v:08d}.json")), wholetext=True).collect()))["runs"]

    def commit(self, runs: list[dict], after: int) -> int:
        """Make ``runs`` the version that follows ``after``."""
        part, final = self._at(f"manifest/.{uuid.uuid4().hex}.part"), self._at(f"manifest/v{after + 1:08d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": after + 1, "runs": runs}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        try:
            files.rename(part, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise ConcurrentCommit(f"version {after + 1} exists") from e
            raise
        return after + 1

    def _commit(self, change: Callable[[list[dict]], list[dict] | None], tries: int = 100) -> int | None:
        """Commit what ``change`` makes of the newest version's runs, again and again while others commit first; None if it makes nothing."""
        for _ in range(tries):
            version = self.version()
            runs = change(self.runs(version))
            if runs is None:
                return None
            try:
                return self.commit(runs, version)
            except ConcurrentCommit:
                continue
        raise ConcurrentCommit(f"others have committed first {tries} times")

    # -- runs --------------------------------------------------------------------------------------------------------

    def _describe(self, name: str) -> dict:
        found = self._fs.getContentSummary(self._at(f"runs/{name}"))
        size, files = found.getLength(), sum(1 for s in self._fs.listStatus(self._at(f"runs/{name}")) if s.getPath().getName().endswith(".parquet"))
        return {"run": name, "bytes": size, "files": files, "tier": self._tier(size)}

    def _tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base_bytes, self.fanout))) if size > self.base_bytes else 0

    def sealed(self, run: dict) -> bool:
        return run["bytes"] >= run["files"] * self.target_bytes / 2

    def _folder(self) -> str:
        """A folder of its own, named after the version that it is made from."""
        return f"{self.version() + 1:08d}-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Add rows as a run, or as one run for each value of the column ``arrival``, which is not stored. All runs are committed as
        one version, so the rows are in it once or not at all; without rows nothing is committed. Returns the version reached."""
        base = self._folder()
        writer = rows.write.option("compression", "zstd")
        if arrival is None:
            names = [f"{base}/all"]
            writer.parquet(str(self._at(f"runs/{base}/all")))
        else:
            writer.partitionBy(arrival).parquet(str(self._at(f"runs/{base}")))
            names = sorted(f"{base}/{s.getPath().getName()}" for s in self._fs.listStatus(self._at(f"runs/{base}")) if s.isDirectory() and "=" in s.getPath().getName())
        made = [run for run in map(self._describe, names) if run["files"]]
        return self._commit(lambda runs: [*runs, *made]) if made else self.version()

    def compact(self, at_once: int = 4) -> int:
        """Merge while a tier holds ``fanout`` unsealed runs, ``at_once`` merges at a time. Merges whose sources another writer has
        merged meanwhile are dropped. Returns the version reached."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for run in self.runs():
                if not self.sealed(run):
                    tiers.setdefault(run["tier"], []).append(run)
            due = [tier[k : k + self.fanout] for _, tier in sorted(tiers.items()) for k in range(0, len(tier) - self.fanout + 1, self.fanout)]
            if not due:
                return self.version()
            with ThreadPoolExecutor(at_once) as pool:
                merged = list(pool.map(self._merge, due, [self._folder() for _ in due]))

            def swap(runs: list[dict], due=due, merged=merged) -> list[dict] | None:
                here, new, gone = {r["run"] for r in runs}, [], set()
                for sources, run in zip(due, merged, strict=True):
                    if here >= (names := {r["run"] for r in sources}):
                        new.append(run)
                        gone |= names
                return [*(r for r in runs if r["run"] not in gone), *new] if new else None

            self._commit(swap)

    def _merge(self, due: list[dict], folder: str) -> dict:
        n = max(1, round(sum(r["bytes"] for r in due) / self.target_bytes))
        self._read(due).coalesce(n).write.option("compression", "zstd").parquet(str(self._at(f"runs/{folder}/merged")))
        merged = self._describe(f"{folder}/merged")
        merged["tier"] = max(merged["tier"], 1 + max(r["tier"] for r in due))  # a merged run never meets its sources' tier
        return merged

    def vacuum(self, keep_versions: int = 10, age_seconds: float = 86_400) -> None:
        """Delete run folders that none of the last ``keep_versions`` versions names and that are older than ``age_seconds``: sources of
        merges, and leftovers of writers that died before their commit. The age must exceed the longest write and read;
        manifests of earlier versions go too."""
        last = self.version()
        kept = range(max(1, last - keep_versions + 1), last + 1)
        named = {r["run"].split("/")[0] for v in kept for r in self.runs(v)}
        before = (time.time() - age_seconds) * 1000
        for s in self._fs.listStatus(self._at("runs")) if self._fs.exists(self._at("runs")) else []:
            if s.getPath().getName() not in named and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._at("manifest")):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:-5]) < kept.start:
                self._fs.delete(s.getPath(), False)

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[str(self._at(f"runs/{r['run']}")) for r in runs])

    def read(self) -> DataFrame | None:
        """Rows of the current version with their file as ``_metadata.file_path``; None while it has none."""
        runs = self.runs()
        return self._read(runs) if runs else None


def compacted(docs: DataFrame, path: str, arrivals: int = 16, target_bytes: int = 128 << 20) -> DataFrame:
    """Append ``docs`` as ``arrivals`` runs, dealt by a hash of doc_id and text, compact them, and read the store back: all
    columns of ``docs`` and ``shard`` (shard1, ... if there is such a column), the version and part number of the file that holds the row. Every row is stored as it is, whatever is null or
    repeated. An empty table gives an empty result."""
    store = ShardStore(docs.sparkSession, path, target_bytes)
    taken = {c.lower() for c in docs.columns}
    key, shard = (next(f"{name}{i or ''}" for i in range(len(taken) + 1) if f"{name}{i or ''}" not in taken) for name in ("arrival", "shard"))
    store.append(docs.withColumn(key, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)).cast("int")), key)
    store.compact()
    rows = store.read()
    if rows is None:
        return docs.limit(0).withColumn(shard, F.lit(None).cast("string"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.regexp_replace("_metadata.file_path", r"^.*/runs/(\d+)-[^/]*/([^/]*)/part-(\d+)-.*$", "$1/$2/$3").alias(shard))
