"""Versions of several tables that change together: data folders, and a manifest that names them, swapped last.

A commit writes each new table to a folder of its own and then one small manifest; readers follow the highest manifest,
so they see all tables of a commit or none. A commit carries the number of its batch, and a batch that is already in the
store is not committed again: run twice, it changes nothing. Data of a commit that failed before its manifest is never
read, and written over when the batch runs again. Two writers can't both make one version: the second rename fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, lowest first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, batch and the folder of each table; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "batch": -1, "tables": {}}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        return json.loads(self.spark.read.text(f"{self.root}/manifests/v{version:09d}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, or None where that version has none."""
        folder = self.manifest(version)["tables"].get(table)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/{folder}")

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> int:
        """The version that holds the batch: a new one with these tables in place of those of the version before, or the
        last one if the batch is in the store already. Batches are numbered upwards."""
        now = self.manifest()
        if batch <= now["batch"]:
            return now["version"]
        version = now["version"] + 1
        folders = dict(now["tables"])
        for name, df in tables.items():
            folders[name] = f"data/{name}/batch-{batch:09d}"
            df.write.mode("overwrite").parquet(f"{self.root}/{folders[name]}")
        self._swap(version, json.dumps({"version": version, "batch": batch, "tables": folders}, sort_keys=True))
        return version

    def _swap(self, version: int, text: str) -> None:
        draft, final = (self._path(f"{self.root}/manifests/{n}") for n in (f"draft-{version:09d}", f"v{version:09d}.json"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} was committed by another writer")

    def expire(self, keep: int) -> list[str]:
        """Delete manifests but the last `keep`, and data folders that none of the rest names; the folders deleted."""
        known = self.versions()
        gone, stay = (known[:-keep], known[-keep:]) if keep > 0 else ([], known)
        used = {f for v in stay for f in self.manifest(v)["tables"].values()}
        old = {f for v in gone for f in self.manifest(v)["tables"].values()} - used
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:09d}.json"), False)
        for f in old:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)
        return sorted(old)
