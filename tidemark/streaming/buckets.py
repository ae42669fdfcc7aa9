"""Stored tables of the streams, in buckets that are rewritten only when a micro-batch touches them.

A table is dealt into buckets by a hash of its key. Version ``n`` is a folder
with the buckets that micro-batch ``n - 1`` wrote and a manifest that says for every
bucket of every table in which version it lies. Nothing is written in place: a
batch that runs again writes the same version again, and readers follow the
pointer, which is written last. The manifest has one row per table and bucket.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
PARTS = 6  # tasks that write one bucket


class BucketStore:
    """Versions of bucketed tables under ``root``; ``keys`` names each table's key column, or several.

    A store keeps the number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str | tuple[str, ...]], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets
        self.version = self._current()
        self.places: dict[str, dict[int, int]] = {name: {} for name in keys}
        if self.version >= 0:
            self._load(self.version)

    def _current(self) -> int:
        found = []
        for k in (0, 1):  # two pointers in turn: one is whole while the other is written
            try:
                found += [r["version"] for r in self.spark.read.parquet(f"{self.root}/current-{k}").collect()]
            except AnalysisException:  # not written yet
                pass
        return max(found, default=-1)

    def _load(self, version: int) -> None:
        self.version, self.places = version, {name: {} for name in self.keys}
        for r in self.spark.read.parquet(f"{self.root}/v{version}/manifest").collect():
            self.buckets = r["buckets"]
            if r["name"] in self.places and r["bucket"] >= 0:
                self.places[r["name"]][r["bucket"]] = r["version"]

    def bucket(self, key: str | tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _part(key: str | tuple[str, ...]) -> Column:
        # a hash of its own: the key's hash is the same for all rows of a bucket in its last digits
        return F.pmod(F.xxhash64(F.lit(1), *([key] if isinstance(key, str) else key)), F.lit(PARTS)).cast("int")

    def of(self, df: DataFrame, key: str | tuple[str, ...]) -> list[int]:
        """The buckets that hold the values of ``key``: at most their number."""
        return [r["b"] for r in df.select(self.bucket(key).alias("b")).distinct().collect()]

    def read(self, name: str, schema, only: list[int] | None = None) -> DataFrame:
        """The table as the loaded version has it, or some of its buckets."""
        own = self.places[name]
        paths = [f"{self.root}/v{v}/{name}/bucket={b}" for b, v in sorted(own.items()) if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def write(self, version: int, frames: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """Write ``frames`` = {table: (rows, the buckets they replace; None for all)} as ``version`` and point to it."""
        places = {name: dict(own) for name, own in self.places.items()}
        for name, (df, touched) in frames.items():
            folder = f"{self.root}/v{version}/{name}"
            # a bucket is PARTS tasks' work and files; each task has one part of one bucket
            named = sorted(range(self.buckets) if touched is None else touched)
            place = F.array_position(F.array(*[F.lit(b) for b in named]), F.col("bucket")).cast("int") - 1
            (df.withColumn("bucket", self.bucket(self.keys[name]))
             .repartitionById(max(len(named), 1) * PARTS, place * PARTS + self._part(self.keys[name]))
             .write.mode("overwrite").partitionBy("bucket").parquet(folder))
            for b in list(places[name]) if touched is None else touched:
                places[name].pop(b, None)
            try:
                written = [r["bucket"] for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()]
            except AnalysisException:  # no rows, no files
                written = []
            places[name] |= dict.fromkeys(written, version)
        rows = [(name, b, v, self.buckets) for name, own in places.items() for b, v in own.items()]
        (self.spark.createDataFrame(rows + [("", -1, version, self.buckets)], "name string, bucket int, version int, buckets int")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v{version}/manifest"))
        (self.spark.range(1).select(F.lit(version).alias("version")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/current-{version % 2}"))
        self.version, self.places = version, places

    def at(self, version: int) -> None:
        """Go to a version that is stored (a batch that runs again starts from the version it had)."""
        if version != self.version:
            self._load(version)
