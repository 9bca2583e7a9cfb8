"""Dataset versions: every applied chain is a new Parquet folder plus a manifest row.

The base table is never touched.  Manifest rows are only ever appended: undoing
a version appends its removal, so a job that dies half-way leaves the earlier
state readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sievework.errors import VersionError
from sievework.functions.columns import nan_to_null, quoted
from sievework.operators.cleaning.base import Catalog, OperationSpec
from sievework.plans.cleaning import run_chain, watch_chain

_MANIFEST = (
    "source_id string, version_id string, version_number int, path string, row_count long, "
    "column_count int, size_bytes long, created_at timestamp, removed boolean, "
    "operations array<struct<operation_key: string, column_name: string, params: map<string, string>, "
    "affected_row_count: bigint, failed_count: bigint, skewness_before: double, skewness_after: double>>"
)


def _storable(df: DataFrame) -> DataFrame:
    """A column without any value has no type of its own; it is stored as numbers."""
    return df.select(
        [
            quoted(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.NullType) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


class VersionStore:
    """Versions of many sources below one folder every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._manifest_path = f"{self.folder}/manifest"

    # -- manifest -----------------------------------------------------------

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest_path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return path, system

    def manifest(self) -> DataFrame:
        """Live versions, one row each."""
        path, system = self._files()
        if not system.exists(path):
            return self.spark.createDataFrame([], _MANIFEST).drop("removed")
        entries = self.spark.read.schema(_MANIFEST).parquet(self._manifest_path)
        removed = F.max(F.col("removed")).over(Window.partitionBy("version_id"))
        return entries.withColumn("gone", removed).filter(~F.col("gone")).drop("gone", "removed")

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(
            self._manifest_path
        )

    def list_versions(self, source_id: str) -> DataFrame:
        return self.manifest().filter(F.col("source_id") == source_id).orderBy("version_number")

    def _latest(self, source_id: str):
        return (
            self.manifest()
            .filter(F.col("source_id") == source_id)
            .orderBy(F.col("version_number").desc())
            .first()
        )

    # -- reading and writing ------------------------------------------------

    def read(self, source_id: str, base: DataFrame, version_id: str | None = None) -> DataFrame:
        """A version by id, else the newest one, else the base table."""
        if version_id is not None:
            row = (
                self.manifest()
                .filter((F.col("version_id") == version_id) & (F.col("source_id") == source_id))
                .first()
            )
            if row is None:
                raise VersionError(f"Source '{source_id}' has no version '{version_id}'.")
            return self.spark.read.parquet(row["path"])
        row = self._latest(source_id)
        return base if row is None else self.spark.read.parquet(row["path"])

    def apply(
        self,
        source_id: str,
        base: DataFrame,
        specs: Sequence[OperationSpec],
        catalog: Catalog | None = None,
        count_affected: bool = True,
    ) -> DataFrame:
        """Run a chain on the current version and store the result as the next one.

        Its steps are counted while the result is written.  If a task that had
        already counted was run again (a lost executor), the written rows tell,
        and the steps are counted by scans.
        """
        latest = self._latest(source_id)
        number = (latest["version_number"] if latest else 0) + 1
        current = nan_to_null(self.read(source_id, base))
        version_id = uuid.uuid4().hex
        path = f"{self.folder}/{source_id}/{version_id}"
        if count_affected:
            watch = watch_chain(current, specs, catalog)
            _storable(watch.dataframe).write.parquet(path)
        else:
            _storable(run_chain(current, specs, catalog).dataframe).write.parquet(path)
        written = self.spark.read.parquet(path)
        rows = written.count()
        if not count_affected:
            accounts = [(None,) * 4] * len(specs)
        elif specs and watch.rows not in (None, rows):
            counted = watch.result.metrics(self.spark).orderBy("step").collect()
            accounts = [(r["affected_row_count"], None, None, None) for r in counted]
        else:
            accounts = [(affected, *rest) for _, _, _, affected, _, *rest in watch.accounts()]
        operations = [
            (s.operation_key, s.column_name, {k: json.dumps(v, default=str) for k, v in s.params.items()}, *account)
            for s, account in zip(specs, accounts)
        ]
        self._append(
            (source_id, version_id, number, path, rows, len(written.columns), self._size(path),
             datetime.now(timezone.utc), False, operations)
        )
        return self.list_versions(source_id).filter(F.col("version_id") == version_id)

    def undo_last(self, source_id: str) -> None:
        """Remove the newest version: first from the manifest, then its files."""
        row = self._latest(source_id)
        if row is None:
            raise VersionError(f"Source '{source_id}' has no version to undo.")
        self._append(
            (source_id, row["version_id"], row["version_number"], row["path"], None, None, None,
             datetime.now(timezone.utc), True, [])
        )
        _, system = self._files()
        system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(row["path"]), True)

    def _size(self, path: str) -> int:
        _, system = self._files()
        return system.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(path)).getLength()
