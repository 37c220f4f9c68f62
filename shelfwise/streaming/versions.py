"""Keyed tables in versions: a batch makes the next version of all its tables at once, or none."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.staging import drop, remove, staged


class Table(NamedTuple):
    schema: str
    keys: tuple[str, ...]


class VersionedStore:
    """Tables of one folder. Their rows lie in buckets by a hash of the key; a version is a small file that names the folder of
    each bucket of each table, and the version with the greatest number is the current one. A commit writes the buckets
    that its rows touch anew, beside the old ones, and then renames its version file into place; a run that dies
    before that leaves the version before it current. A batch is known by its source and number, and one that is in
    already changes nothing, so batches may be tried again. One writer at a time; readers need not wait."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = 16):
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        path, system = self._path(name)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def version(self) -> int:
        """The current version's number; 0 before any commit."""
        return max((int(n) for n in self._children(f"{self.folder}/versions") if n.isdigit()), default=0)

    def _manifest(self, number: int) -> dict:
        if not number:
            return {"batches": {}, "tables": {t: {} for t in self.tables}}
        path, system = self._path(f"{self.folder}/versions/{number:010d}")
        file = system.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def committed(self, source: str, number: int) -> bool:
        """Whether this batch, or a later one of its source, is in."""
        return self._manifest(self.version())["batches"].get(source, -1) >= number

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the current one by default."""
        found = self._manifest(self.version() if version is None else version)["tables"][table]
        return self._rows(table, found.values())

    def _rows(self, table: str, folders) -> DataFrame:
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, source: str, number: int, changes: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> bool:
        """Put in rows, each in place of the one of equal key, after taking out the keys in `removed`. False, and nothing is done,
        if the batch is in. A table's rows must have keys that are neither null nor repeated."""
        now = self.version()
        manifest = self._manifest(now)
        if manifest["batches"].get(source, -1) >= number:
            return False
        for table in self.tables:
            rows, gone = changes.get(table), (removed or {}).get(table)
            if rows is not None or gone is not None:
                manifest["tables"][table] |= self._merged(table, manifest["tables"][table], rows, gone)
                manifest["tables"][table] = {b: f for b, f in manifest["tables"][table].items() if f}
        manifest["batches"][source] = number
        temporary, system = self._path(f"{self.folder}/unfinished/{uuid.uuid4().hex}")
        file = system.create(temporary, False)
        file.write(bytearray(json.dumps(manifest).encode()))
        file.close()
        final, _ = self._path(f"{self.folder}/versions/{now + 1:010d}")
        system.mkdirs(final.getParent())
        if system.exists(final) or not system.rename(temporary, final):
            raise RuntimeError(f"another writer has made version {now + 1} of {self.folder}")
        return True

    def _merged(self, table: str, old: dict[str, str], rows: DataFrame | None, gone: DataFrame | None) -> dict[str, str]:
        """The folders of the buckets that change; empty where no row is left."""
        schema, keys = self.tables[table]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        new = self.spark.createDataFrame([], schema) if rows is None else rows
        new = staged(new.select(*self._rows(table, []).columns).withColumn("bucket", bucket), "changes")
        replaced = new.select(*keys, "bucket")
        if gone is not None:
            replaced = replaced.unionByName(gone.select(*keys).withColumn("bucket", bucket))
        touched = [str(r.bucket) for r in replaced.select("bucket").distinct().collect()]  # as many as there are buckets at most
        kept = self._rows(table, [old[b] for b in touched if b in old]).withColumn("bucket", bucket).join(replaced.drop("bucket"), list(keys), "left_anti")
        folder = f"{self.folder}/{table}/{uuid.uuid4().hex}"
        kept.unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        drop(new)
        made = set(self._children(folder))
        return {b: f"{folder}/bucket={b}" if f"bucket={b}" in made else "" for b in touched}

    def forget(self, keep: int = 1) -> None:
        """Delete what only versions before the last `keep` hold."""
        numbers = [int(n) for n in self._children(f"{self.folder}/versions") if n.isdigit()]
        live = {f for n in numbers[-keep:] for t in self._manifest(n)["tables"].values() for f in t.values()}
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.folder}/versions/{n:010d}")
        for table in self.tables:
            for made in self._children(f"{self.folder}/{table}"):
                for b in self._children(f"{self.folder}/{table}/{made}"):
                    folder = f"{self.folder}/{table}/{made}/{b}"
                    if b.startswith("bucket=") and folder not in live:
                        remove(self.spark, folder)
