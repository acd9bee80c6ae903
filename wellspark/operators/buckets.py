"""A table in hash buckets: an update rewrites the buckets it hits, and a manifest makes it the table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspark.operators.sinks import upsert


class BucketedTable:
    """Rows by key in ``buckets`` folders, each commit in folders of its own.

    ``path/data/commit=c/bucket=b`` holds what commit c wrote of bucket b and is
    never changed.  ``path/manifest/version=v`` is a row per bucket with the
    commit that holds it, and the commits so far; the highest version is the
    table, and Spark moves its one file in place when it is whole.  A reader or a
    failed writer never sees half a commit.  A commit that is in the manifest is
    not made again.  Versions are made with mode ``error``, so of two writers at
    once the later one fails and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], at: str, buckets: int = 256):
        self.spark, self.path, self.key, self.at, self.buckets = spark, path, key, at, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, dict[int, str], list[str]]:
        """Version, commit of each bucket, commits; one row per bucket comes to the driver."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return -1, {}, []
        version = rows.agg(F.max("version")).first()[0]
        held = rows.filter(F.col("version") == version).collect()
        return version, {r["bucket"]: r["commit"] for r in held if r["bucket"] >= 0}, [r["commit"] for r in held if r["bucket"] < 0]

    def _commit(self, version: int, places: dict[int, str], done: list[str]) -> None:
        rows = [*places.items(), *[(-1 - i, c) for i, c in enumerate(done)]]
        self.spark.createDataFrame(rows, "bucket int, commit string").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def _write(self, rows: DataFrame, commit: str) -> list[int]:
        """The rows by bucket; a commit that failed before its manifest is written over."""
        placed = rows.withColumn("bucket", self._bucket())
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        return [r[0] for r in self.spark.read.parquet(f"{self.path}/data/commit={commit}").select("bucket").distinct().collect()]

    def create(self, rows: DataFrame, commit: str = "create") -> None:
        """The first version; of rows that repeat a key the latest stays."""
        version, _, done = self._manifest()
        if commit in done:
            return
        first = upsert(rows.limit(0), rows, self.key, self.at)
        places = dict.fromkeys(self._write(first, commit), commit) if rows.limit(1).count() else {}
        self._commit(version + 1, places, [commit])
        self.schema = rows.schema

    def _read(self, places: dict[int, str]) -> DataFrame | None:
        if not places:
            return None
        folders = [f"{self.path}/data/commit={c}/bucket={b}" for b, c in sorted(places.items())]
        return self.spark.read.parquet(*folders)

    def read(self) -> DataFrame:
        """The table as the newest manifest has it."""
        version, places, _ = self._manifest()
        if version < 0:
            raise ValueError(f"no table in {self.path}")
        rows = self._read(places)
        return rows if rows is not None else self.spark.createDataFrame([], self.schema)

    def upsert(self, updates: DataFrame, commit: str) -> list[int]:
        """Latest row by key wins, an update before a stored row of the same time; the buckets rewritten are returned."""
        version, places, done = self._manifest()
        if commit in done:
            return []
        newest = upsert(updates.limit(0), updates, self.key, self.at)
        hit = {r[0] for r in newest.select(self._bucket().alias("b")).distinct().collect()}
        if not hit:
            self._commit(version + 1, places, [*done, commit])
            return []
        stored = self._read({b: c for b, c in places.items() if b in hit})
        merged = newest if stored is None else upsert(stored.select(*newest.columns), newest, self.key, self.at)
        written = self._write(merged, commit)
        self._commit(version + 1, places | dict.fromkeys(written, commit), [*done, commit])
        return sorted(written)
