"""Shared pieces of the training-data operators: shared-folder tables, ordered buckets, worker state."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.operators.lineage import shared_dir

LONG_MIN = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def driver_state() -> types.ModuleType:
    """Process-wide state that outlives the unpickled copies of this package's functions."""
    return sys.modules.setdefault("_auditlake_state", types.ModuleType("_auditlake_state"))


def worker_cache(key, make):
    """make() once per Python worker process and key. A worker holds one operator's cache at a time: executors keep workers between stages."""
    cache = driver_state().__dict__.setdefault("cache", {})
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


class Tables:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors.

    Frames that operators return read some of them later, so what is not dropped before stays until the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/auditlake/{name}-{uuid.uuid4().hex[:12]}"
        path, files = self._at(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes df and returns the written table."""
        schema = df.schema
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no frame still to be evaluated reads."""
        for name in names:
            path, files = self._at(self.path(name))
            files.delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, although body names it often."""
    return F.transform(F.array(value), body)[0]


def clear_of(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until it is none of the taken ones (whose case doesn't count)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def order_key(column: Column) -> Column:
    """The id as ordered by the operators: nulls first."""
    return F.coalesce(column.cast("bigint"), F.lit(LONG_MIN))


def id_cuts(df: DataFrame, key: Column, rows_each: int = 512, most: int = 4096) -> list[int]:
    """Ascending key values, each present in df, that begin buckets of about rows_each rows; at most `most` of them.

    Only the key column is read. The buckets are equal in rows, whatever the gaps between keys.
    """
    low, n = df.agg(F.min(key), F.count(F.lit(1))).first()
    if not n:
        return [LONG_MIN]
    buckets = max(1, min(most, -(-n // rows_each)))
    if buckets == 1:
        return [low]
    at = F.split(F.lit(",".join(f"{i / buckets:.9f}" for i in range(1, buckets))), ",").cast("array<double>")
    found = df.agg(F.percentile_approx(key, at, F.lit(max(10_000, 20 * buckets)))).first()[0]
    return sorted({low, *found})


def longs(values) -> Column:
    """A literal array<bigint>, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of the last cut that is not above key, by binary search."""
    if len(cuts) == 1:
        return F.lit(0)
    table, steps = longs(cuts), [2**i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s < F.lit(len(cuts))) & (F.get(table, at + s) <= key), at + s).otherwise(at),
    )


def place(column: str = "_metadata") -> tuple[Column, Column]:
    """The number of the written file a row is in, and the row's number in it."""
    return F.regexp_extract(f"{column}.file_name", r"part-(\d+)", 1).cast("int").alias("file"), F.col(f"{column}.row_index").alias("row_index")


def number_rows(rows: DataFrame, order: list[Column], tables: Tables) -> DataFrame:
    """struct `row` of each row, and `number`: its place, from 0, in the order of the columns given; equal rows take any order.

    The rows are written twice: as they come, which gives each a place of its own, and in ranges of `order`, then of that place,
    so that one key with any share of the rows is dealt to many tasks. A row's number follows from its place in the second table
    and the rows of the files before it; there are at most as many files as shuffle partitions, whatever the number of rows.
    """
    keys = [f"k{i}" for i in range(len(order))]
    kept = tables.keep(rows.select(F.struct("*").alias("row"), *[c.alias(k) for c, k in zip(order, keys)]), "rows")
    kept = kept.withColumn("salt", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    ranges = kept.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt").select("row")
    ranges = tables.keep(ranges, "ordered", maxRecordsPerFile="0").select("row", *place())
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = ranges.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", before.alias("first"))
    return ranges.join(F.broadcast(first), "file").select("row", (F.col("first") + F.col("row_index")).alias("number"))


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of driver-made rows whose number is bounded by a parameter."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))
