"""Tables in hash buckets with a manifest per version, so that a change rewrites what it touches.

    path/data/v<n>/bucket=<b>/   the rows of bucket b as version n left them
    path/manifest/v<n>/          for each bucket the version that holds its rows

A version is written bucket by bucket and counts from the moment its manifest is
there. It depends on the version before and the change alone, so a change that runs
twice writes the same version twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: The version that a table starts with; versions count on from 0.
FIRST = -1


@dataclass(frozen=True)
class BucketTable:
    """Rows are dealt to `buckets` buckets by a hash of `keys`; the manifest has a row for each at most."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 256

    def bucket(self) -> Column:
        """By the keys' text, so that a change may carry them in another type."""
        return F.pmod(F.hash(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def start(self, rows: DataFrame) -> None:
        """The first version, unless the table is there already."""
        if self._manifest(FIRST) is None:
            self._write(FIRST, rows, {})

    def touched(self, change: DataFrame) -> list[int]:
        return sorted(r[0] for r in change.select(self.bucket()).distinct().collect())

    def versions(self, version: int) -> dict[int, int]:
        """bucket -> the version whose data it has; empty buckets are missing."""
        found = self._manifest(version)
        if found is None:
            raise ValueError(f"no version {version} in {self.path}")
        return found

    def _manifest(self, version: int) -> dict[int, int] | None:
        try:
            rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v{version}").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return {r["bucket"]: r["version"] for r in rows}

    def rows(self, version: int, only: list[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets; no other bucket is read."""
        held = self.versions(version)
        wanted = held if only is None else [b for b in only if b in held]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{held[b]}/bucket={b}" for b in wanted])

    def change(self, version: int, touched: list[int], rows: DataFrame | None) -> None:
        """Version `version`: the one before, with `rows` in place of what the touched buckets held."""
        kept = {b: v for b, v in self.versions(version - 1).items() if b not in touched}
        self._write(version, rows if touched else None, kept)

    def _write(self, version: int, rows: DataFrame | None, kept: dict[int, int]) -> None:
        folder = f"{self.path}/data/v{version}"
        if rows is not None:
            # Large buckets are split between tasks and small ones share a task.
            dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            written = self.spark.read.schema(StructType(list(self.schema)).add("bucket", IntegerType())).parquet(folder)
            kept = kept | {r[0]: version for r in written.select("bucket").distinct().collect()}
        manifest = self.spark.createDataFrame(sorted(kept.items()), "bucket int, version long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")


def changed_by(table: BucketTable, change: Callable[[DataFrame, DataFrame], DataFrame]):
    """A foreachBatch sink: version n is version n - 1 with the buckets of batch n changed by it."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        touched = table.touched(batch)
        table.change(batch_id, touched, change(table.rows(batch_id - 1, touched), batch))

    return apply
