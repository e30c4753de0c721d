"""Several tables that change together: one manifest a version.

Rows are written to new folders first, by bucket of a key; a version comes to
be when its manifest, which names the folders of every table, is renamed into
place.  Renaming fails where the file is there already, so of two writers on one
version one gets `Conflict`.  Readers take a version and keep it: what later
versions write is elsewhere, what a failed writer left is named by no manifest.

A change appends rows, or replaces buckets whole; other buckets stay as they are
and are not read.  A manifest may note how far a source has been taken in, in
the same step, so a batch that runs again after a failure is known.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(PySparkException):
    """Another writer has made this version."""


class Snapshots:
    """Tables under a folder, at one version (none: the latest there is)."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self._conf)
        known = self.versions()
        self.version = version if version is not None else (known[-1] if known else 0)
        if self.version and self.version not in known:
            raise KeyError(f"no version {self.version}")
        self.manifest = json.loads(self._text(self._manifest(self.version))) if self.version else {"buckets": buckets, "marks": {}, "tables": {}}

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _manifest(self, version: int) -> str:
        return f"manifests/{version:010d}.json"

    def _text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("manifests") if n.endswith(".json")]

    def mark(self, source: str) -> int:
        """How far a source has been taken in; -1 if not at all."""
        return self.manifest["marks"].get(source, -1)

    def bucket_of(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest["buckets"])).cast("int")

    def buckets(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that rows fall in; there are few."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None if it was never written."""
        held = self.manifest["tables"].get(table)
        if held is None:
            return None
        folders = [f for b, fs in held["parts"].items() if buckets is None or int(b) in buckets for f in fs]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2) -> int:
        """Drop all versions but the last `keep`, and folders that none of these names; no writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            self.fs.delete(self.path(self._manifest(v)), False)
        used = set()
        for v in known[-keep:]:
            tables = json.loads(self._text(self._manifest(v)))["tables"]
            used |= {f.split("/bucket=")[0] for t in tables.values() for fs in t["parts"].values() for f in fs}
        gone = [f"data/{t}/{n}" for t in self.names("data") for n in self.names(f"data/{t}") if f"data/{t}/{n}" not in used]
        for f in gone:
            self.fs.delete(self.path(f), True)
        return len(gone)


class Change:
    """What the next version has in place of, or beside, an earlier one's rows."""

    def __init__(self, base: Snapshots):
        self.base = base
        self.manifest = json.loads(json.dumps(base.manifest))

    def _write(self, table: str, rows: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        held = self.manifest["tables"].get(table)
        schema = StructType.fromJson(held["schema"]) if held else StructType.fromJson(json.loads(json.dumps(rows.schema.jsonValue())))
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema), self.base.bucket_of(key).alias("bucket"))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.base.root}/{folder}")
        for f in schema:
            f.nullable = True
        self.manifest["tables"].setdefault(table, {"schema": schema.jsonValue(), "parts": {}})
        parts = {n.split("=")[1]: f"{folder}/{n}" for n in self.base.names(folder) if n.startswith("bucket=")}
        read = self.base.spark.read.schema(schema)
        written = read.parquet(*(f"{self.base.root}/{f}" for f in parts.values())) if parts else self.base.spark.createDataFrame([], schema)
        return written, parts

    def append(self, table: str, rows: DataFrame, key: str) -> DataFrame:
        """Add rows; returns them as written."""
        written, parts = self._write(table, rows, key)
        held = self.manifest["tables"][table]["parts"]
        for b, f in parts.items():
            held.setdefault(b, []).append(f)
        return written

    def replace(self, table: str, rows: DataFrame, key: str, buckets: list[int] | None = None) -> DataFrame:
        """These rows instead of what the buckets hold (none given: all); rows of other buckets are an error of the caller."""
        written, parts = self._write(table, rows, key)
        held = self.manifest["tables"][table]["parts"]
        for b in list(held) if buckets is None else map(str, buckets):
            held.pop(b, None)
        held.update({b: [f] for b, f in parts.items()})
        return written

    def commit(self, mark: tuple[str, int] | None = None) -> int:
        """Make the next version; Conflict if it is there."""
        if mark:
            self.manifest["marks"][mark[0]] = mark[1]
        base = self.base
        version = base.version + 1
        draft = base.path(f"manifests/.draft-{uuid.uuid4().hex}")
        out = base.fs.create(draft, False)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        rename = base._jvm.org.apache.hadoop.fs.Options.Rename
        never_over = base.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        target = base.path(base._manifest(version))
        try:
            base._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), base._conf).rename(draft, target, never_over)
        except Exception as error:
            base.fs.delete(draft, False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"version {version} of {base.root} is there already") from error
            raise
        return version
