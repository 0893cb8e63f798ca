"""A table of the last row of each key, kept up by micro-batches that write no more than they bring.

Keys are dealt into buckets by hash. A batch writes its own last rows, bucket by bucket, as a delta; a manifest names, for
each bucket, the folders that make it up. A bucket whose deltas hold as many rows as a share of its base is merged into a
new base, so that each row is written again a number of times that grows with the logarithm of the table only; one with
many small deltas has these merged into one. Buckets that a batch doesn't touch are not read and not written.

A batch works from the manifest of the batch before, and its manifest is written last: one that is run again, after a
failure at any point, gives the same table. Folders stay until two manifests no longer name them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The number of the batch that a row came in; the bucket, as a folder.
BATCH, BUCKET = "__batch", "b"
MANIFEST = "bucket int, folders array<string>, rows array<bigint>"


class KeyedTable:
    """The table at ``path`` (a folder that driver and executors share) of rows of ``schema`` by ``keys``; of a batch's rows
    of one key the last by ``order`` counts, and a later batch's before an earlier one's.

    buckets: to be chosen by the size of the table in the end, some 100 MB each; share, most: of a bucket's base, the rows
    in deltas from which it is merged, and the deltas from which these are."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], order: str, buckets: int = 64, share: float = 0.5, most: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets, self.share, self.most = spark, path.rstrip("/"), keys, order, buckets, share, most
        self.columns = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0).cast("bigint")).schema

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return self.merge

    def read(self) -> DataFrame:
        """The table as of the last batch."""
        n = max(self._numbers(), default=None)
        folders = [f for _, names, _ in (self._manifest(n) if n is not None else []) for f in names]
        return self._last(folders).drop(BATCH).select(self.columns.names)

    def merge(self, batch: DataFrame, number: int) -> None:
        before = {b: (list(names), list(rows)) for b, names, rows in (self._manifest(number - 1) if number else [])}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rest = [c for c in self.columns.names if c not in self.keys]
        last = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("r")).select(*self.keys, "r.*", F.lit(number).cast("bigint").alias(BATCH))
        now = dict(before)
        for b, n in self._write(last.withColumn(BUCKET, bucket), f"delta/{number}").items():
            names, rows = before.get(b, ([], []))
            now[b] = ([*names, f"delta/{number}/{BUCKET}={b}"], [*rows, n])
        whole = [b for b, (names, rows) in now.items() if now[b] != before.get(b) and len(names) > 1 and sum(rows[1:]) >= self.share * rows[0]]
        deltas = [b for b, (names, _) in now.items() if now[b] != before.get(b) and len(names) > self.most and b not in whole]
        for todo, skip, to in ((whole, 0, f"base/{number}"), (deltas, 1, f"merged/{number}")):
            if todo:
                rows = self._last([f for b in todo for f in now[b][0][skip:]]).withColumn(BUCKET, bucket)
                for b, n in self._write(rows, to).items():
                    now[b] = ([*now[b][0][:skip], f"{to}/{BUCKET}={b}"], [*now[b][1][:skip], n])
        self.spark.createDataFrame([(b, *x) for b, x in sorted(now.items())], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
        self._clean(number, {f for names, _ in (*before.values(), *now.values()) for f in names})

    def _last(self, folders: list[str]) -> DataFrame:
        """The last row of each key in ``folders``."""
        rows = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.stored)
        rest = [c for c in self.stored.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("r")).select(*self.keys, "r.*")

    def _write(self, rows: DataFrame, to: str) -> dict[int, int]:
        """Write ``rows`` by bucket; the number of rows of each. A bucket is one task's, whatever the number of partitions."""
        folder = f"{self.path}/{to}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").mode("overwrite").parquet(folder)
        if not [f for f in self._list(folder) if f.startswith(f"{BUCKET}=")]:
            return {}
        return {r[0]: r[1] for r in self.spark.read.parquet(folder).groupBy(BUCKET).count().collect()}

    def _manifest(self, number: int) -> list[tuple[int, list[str], list[int]]]:
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{number}").collect()]

    def _fs(self, folder: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _list(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        """Batches whose manifest was written to its end."""
        return [int(n) for n in self._list(f"{self.path}/manifest") if "_SUCCESS" in self._list(f"{self.path}/manifest/{n}")]

    def _clean(self, number: int, named: set[str]) -> None:
        """Delete what only manifests older than the one before named."""
        for n in self._numbers():
            if n < number - 1:
                gone = {f for _, names, _ in self._manifest(n) for f in names} - named
                for f in (*sorted(gone), f"manifest/{n}"):
                    fs, path = self._fs(f"{self.path}/{f}")
                    fs.delete(path, True)
