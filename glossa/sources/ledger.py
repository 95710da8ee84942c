"""Append-only tables of runs: each run's rows appear at once, and once.

A run writes its rows to a folder of its own and then publishes them by creating one small entry named after the run.
Creating an entry that exists fails, so of several attempts at a run (a retry, a second driver) one is published and the others are
never read.  Readers take the folders named by the entries; a run that failed in between has none, and its rows are not seen.
Nothing that was published is written again.

The entries lie next to the data on any Hadoop file system that creates files atomically; they are one file of a few bytes for each run, and are
merged by ``compact``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Ledger:
    """An append-only table below ``root`` whose runs have names without slashes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> dict[str, dict]:
        """The published runs and their entries, in order of publication time, then name."""
        folder = self._path(f"{self.root}/entries")
        if not self._fs.exists(folder):
            return {}
        found = [(f.getModificationTime(), f.getPath().getName()) for f in self._fs.listStatus(folder) if not f.getPath().getName().startswith(".")]
        entries = {name: self._read(name) for _, name in sorted(found)}
        # a compacted entry stands for the runs that it lists; these may still lie beside it
        gone = {run for e in entries.values() for run in e.get("merged", [])}
        return {name: e for name, e in entries.items() if name not in gone}

    def has(self, run: str) -> bool:
        return run in self.runs() or any(run in e.get("merged", []) for e in self.runs().values())

    def commit(self, run: str, rows: DataFrame, note: dict | None = None) -> bool:
        """Write the rows and publish them as ``run``; False, and nothing to see, if that run was published before."""
        if "/" in run or not run or run.startswith("."):
            raise ValueError(f"not a name of a run: {run!r}")
        if self.has(run):
            return False
        folder = f"data/{run}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._publish(run, {"folder": folder, "schema": rows.schema.json(), **(note or {})})

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """All published rows; None (or no rows of ``schema``) before the first run."""
        runs = self.runs()
        if not runs:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.read_of(list(runs.values()), schema)

    def read_of(self, entries: list[dict], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or T.StructType.fromJson(json.loads(entries[-1]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{e['folder']}" for e in entries])

    def compact(self, run: str, merge) -> bool:
        """Publish ``merge(all rows)`` in place of the runs so far; a reader sees either those runs or their merger."""
        before = self.runs()
        if len(before) < 2:
            return False
        rows = merge(self.read_of(list(before.values())))
        merged = [*before, *[r for e in before.values() for r in e.get("merged", [])]]
        folder = f"data/{run}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._publish(run, {"folder": folder, "schema": rows.schema.json(), "merged": merged})

    def _publish(self, run: str, entry: dict) -> bool:
        # written aside and renamed, so that an entry is whole when it is seen; a rename onto an entry that exists fails
        aside = self._path(f"{self.root}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.root}/entries"))
        target = self._path(f"{self.root}/entries/{run}")
        return not self._fs.exists(target) and bool(self._fs.rename(aside, target))

    def _read(self, run: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/entries/{run}"))
        try:
            data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(data)
