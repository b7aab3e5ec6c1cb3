"""A table with one row per key that batches are merged into, by rewriting only the buckets they meet.

Keys are dealt to a fixed number of buckets by their hash. A batch is merged with the stored rows of the buckets that it
has keys in; these are written to a new folder, all others stay where they are. Which
folder holds which bucket is a generation of a log (`weftline.operators.state`), so readers see a batch
whole or not at all, and of two writers that began at the same time one is refused.

The last write wins by an order of columns, counters add up. A numbered batch of a source counts once:
merged again, after a restart, it changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.state import Generations, shared


class BucketedTable:
    def __init__(self, root: str, spark: SparkSession, schema: str, keys: Sequence[str], order: Sequence[str], counters: Sequence[str] = (), buckets: int = 64) -> None:
        """schema names all columns; order says which of two rows of a key is later (null is earliest); counters are summed."""
        self.root, self.spark, self.schema, self.buckets = root.rstrip("/"), spark, schema, buckets
        self.keys, self.order, self.counters = list(keys), list(order), list(counters)
        self.log = Generations(shared(root, spark), "manifest")
        self.columns = spark.createDataFrame([], schema).columns

    def _manifest(self) -> tuple[int, dict]:
        seen, value = self.log.top()
        if value and value["buckets"] != self.buckets:
            raise ValueError(f"the table has {value['buckets']} buckets")
        return seen, value or {"buckets": self.buckets, "folders": {}, "batches": {}}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        _, manifest = self._manifest()
        return self._read(sorted(manifest["folders"].values())).select(*self.columns)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        _, manifest = self._manifest()
        met = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # as many as buckets
        found = self._read(sorted(f for b, f in manifest["folders"].items() if b in met))
        return found.join(keys.select(*self.keys).distinct(), self.keys, "left_semi").select(*self.columns)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("__bucket")

    def merged(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in {*self.keys, *self.order, *self.counters}]
        best = rows.groupBy("__bucket", *self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("__x"), *[F.sum(c).alias(c) for c in self.counters])
        kind = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        return best.select("__bucket", *[F.col(c) if c in self.keys else F.col(c).cast(kind[c]).alias(c) if c in self.counters else F.col(f"__x.{c}") for c in self.columns])

    def upsert(self, batch: DataFrame, source: str | None = None, number: int | None = None) -> list[int]:
        """Merge a batch; the buckets that were rewritten. With a source, a number that is not above its last one is passed over."""
        seen, manifest = self._manifest()
        if source is not None and number <= manifest["batches"].get(source, -1):
            return []
        own = batch.select(*self.columns, self._bucket())
        met = sorted(r[0] for r in own.select("__bucket").distinct().collect())  # as many as buckets
        held = self._read(sorted({manifest["folders"][str(b)] for b in met if str(b) in manifest["folders"]}))
        rows = own.unionByName(held.select(*self.columns, self._bucket()))
        folder = f"{self.root}/{uuid.uuid4().hex}"
        if met:
            self.merged(rows).repartition(min(len(met), self.buckets), "__bucket").write.partitionBy("__bucket").parquet(folder)
        folders = manifest["folders"] | {str(b): f"{folder}/__bucket={b}" for b in met}
        batches = manifest["batches"] | ({source: number} if source is not None else {})
        if not self.log.put(seen, {"buckets": self.buckets, "folders": folders, "batches": batches}):
            raise RuntimeError("another batch was merged meanwhile")
        return met

    def unused(self) -> list[str]:
        """Folders below the table that no bucket is read from; safe to remove once no reader of an earlier state is left."""
        _, manifest = self._manifest()
        used = {f.rsplit("/", 2)[1] for f in manifest["folders"].values()}
        return sorted(n for n in self.log.files.names() if len(n) == 32 and n not in used)
