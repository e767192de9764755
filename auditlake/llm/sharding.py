"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in ascending id order. A balanced Feistel network permutes the least domain of 4^k numbers that holds all
n; a result of n or more is permuted again until it is below n (under four times on average), which leaves a permutation of the n
numbers. Position p is slot p // shards of shard p % shards, so shards differ by at most one row (law `rows`) and slots have no gap.
Seed, number of rows and number of shards alone decide: any machine computes the shard and slot of a row, and by the inverse the
row of a shard and slot, without reading anything.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Tables, clear_of, number_rows, order_key

SHARDS, SEED, ROUNDS = 16, 11, 8
#: Fixed values of the round function: odd multipliers below 2^30, so that products with 32-bit numbers fit 63 bits; shifts.
MULTIPLIERS, SHIFTS = (740_015_213, 695_872_825), (15, 12, 15)
LOW = (1 << 32) - 1


class Permutation:
    """A permutation of the numbers below n (at most 2^62), chosen by the seed."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if not 0 <= n <= 1 << 62:
            raise ValueError(f"{n} rows can't be permuted")
        self.n, self.half = n, max(1, (max(n - 1, 0).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4]) for i in range(rounds)]

    def _spread(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x + key) & LOW
        for shift, by in zip(SHIFTS, MULTIPLIERS):
            x = ((x ^ (x >> shift)) * by) & LOW
        return (x ^ (x >> SHIFTS[-1])) & self.mask

    def _there(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._spread(right, key)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._spread(left, key), left
        return left << self.half | right

    def _walk(self, x, step) -> np.ndarray:
        x = np.array(x, np.int64)
        if x.size and not (0 <= x.min() and x.max() < self.n):
            raise ValueError(f"not all numbers are below {self.n}")
        x = step(x)
        while (far := np.flatnonzero(x >= self.n)).size:
            x[far] = step(x[far])
        return x

    def positions(self, rows) -> np.ndarray:
        """Where the rows of these numbers go."""
        return self._walk(rows, self._there)

    def rows(self, positions) -> np.ndarray:
        """The numbers of the rows that stand at these positions."""
        return self._walk(positions, self._back)


def position(number: Column, permutation: Permutation) -> Column:
    """The position of a row number, bigint, in Arrow batches."""

    @F.pandas_udf("bigint")
    def of(numbers):
        return type(numbers)(permutation.positions(numbers.to_numpy()))

    return of(number)


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, ties: list[str] | None = None) -> DataFrame:
    """docs with row_number, shard and slot; columns of docs that bear such a name stay, the new one then begins with an underscore.

    Null ids are numbered first. Rows of one id are ordered by `ties`, by default a hash of all their other plain columns; rows equal in
    these are interchangeable, and rows of one id are rows of their own however many there are. Nulls and texts of any length count
    whole. An empty table gives an empty result; with fewer rows than shards some shards are empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    plain = [f.name for f in docs.schema if f.name != "doc_id" and f.dataType.typeName() not in ("map", "variant", "void")]
    tie = [F.xxhash64(*plain)] if ties is None and plain else [F.col(c) for c in ties or []]
    numbered = number_rows(docs, [order_key(F.col("doc_id")), *tie], Tables(docs.sparkSession, "shards"))
    n = numbered.count()
    number, shard, slot = clear_of(docs.columns, "row_number", "shard", "slot")
    at = numbered.withColumn("at", position(F.col("number"), Permutation(n, seed)))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return at.select(*own, F.col("number").alias(number), (F.col("at") % shards).cast("int").alias(shard), F.expr(f"at div {shards}").alias(slot))


def write_shards(shuffled: DataFrame, out: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, rows of a file in ascending slots, files of a shard in ranges of slots."""
    shuffled.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(out)


def read_shard(spark: SparkSession, out: str, shard: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows of one shard, of the slots in [low, high]: one folder is listed, the range reaches the scan."""
    rows = spark.read.parquet(out).where(F.col("shard") == shard)
    rows = rows if low is None else rows.where(F.col("slot") >= low)
    return rows if high is None else rows.where(F.col("slot") <= high)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one more; a null text has none), text_crc32 (0 for null and empty texts)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _sql_network(permutation_keys: list[int], half: str, source: str, x: str) -> str:
    """DuckDB: number, n, y (the network's image of x) of the rows of source."""
    mask = f"((1::BIGINT << {half}) - 1)"
    inner = f"(SELECT number, n, {half} AS h, {mask} AS m, {x} >> {half} AS l, {x} & {mask} AS r FROM {source})"
    for key in permutation_keys:
        f = f"((r + {key}) & {LOW})"
        for shift, by in zip(SHIFTS, MULTIPLIERS):
            f = f"list_transform([{f}], lambda v: (xor(v, v >> {shift}) * {by}) & {LOW})[1]"
        f = f"list_transform([{f}], lambda v: xor(v, v >> {SHIFTS[-1]}) & m)[1]"
        inner = f"(SELECT number, n, h, m, r AS l, xor(l, {f}) AS r FROM {inner})"
    return f"SELECT number, n, l << h | r AS y FROM {inner}"


#: DuckDB common table expression: the table of the reflected polynomial's remainders, of 256 entries, by rule.
SQL_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"


def sql_crc32(text: str) -> str:
    """DuckDB expression beside SQL_CRC_TABLE: the unsigned crc32 of a text's UTF-8 bytes."""
    values = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def oracle() -> str:
    """DuckDB SQL with the result of op11 over the view documents."""
    keys = Permutation(1).keys
    half = "greatest(1, (CASE WHEN n < 2 THEN 0 ELSE length(bin(n - 1)) END + 1) // 2)"
    return f"""
WITH RECURSIVE {SQL_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM d),
walk AS ({_sql_network(keys, half, "o", "number")} UNION ALL {_sql_network(keys, half, "(SELECT * FROM walk WHERE y >= n)", "y")})
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (y % {SHARDS})::INTEGER AS shard, (y // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN walk USING (number) WHERE y < walk.n
"""
