"""Token ids as Parquet list columns.

Rows lie in ascending doc_id order: file k holds smaller ids than file k+1, rows within a file ascend, row groups and
pages are small, and the writer adds column and offset indexes, so a reader of some documents touches few pages and a
reader of metadata (doc_id, n_tokens) touches no token at all. Ids are dictionary encoded (their alphabet is small),
ascending ids and counts are delta encoded.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.bpe import CHARS, encoder, vocabulary
from auditlake.llm.common import small_frame
from auditlake.llm.textkit import slices

SCHEMA = "doc_id bigint, n_tokens bigint, tokens array<int>"
ROW_GROUP, PAGE = 16 << 20, 64 << 10


def layout(row_group: int = ROW_GROUP, page: int = PAGE, codec: str = "zstd") -> dict[str, str]:
    """Writer options: row-group and page bytes, format version 2 (delta encodings), dictionaries for ids alone."""
    return {
        "compression": codec, "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
        "parquet.column.index.truncate.length": "64",
    }


def tokenized(docs: DataFrame, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """doc_id, n_tokens, tokens of each row, in the order of the rows.

    Null texts are empty; end_id ends each document, also an empty one; repeated rows give a row each; long texts are encoded whole;
    only doc_id and text are read; an empty table gives an empty result.
    """
    where = path or vocabulary()

    def run(batches):
        import pyarrow as pa

        enc, end = encoder(where), [] if end_id is None else [end_id]
        for batch in batches:
            for first, texts in slices(batch, chars=CHARS):
                ids = enc.encode(texts)
                size = np.fromiter((len(x) + len(end) for x in ids), np.int64, len(ids))
                flat = np.empty(int(size.sum()), np.int32)
                at = 0
                for x in ids:
                    flat[at : at + len(x)] = x
                    at += len(x)
                    if end:
                        flat[at] = end[0]
                        at += 1
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(ids)), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "n_tokens", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = 1, **options: str) -> None:
    """Writes the token files. Rows with equal ids are ordered by a hash of the text; null ids come first; no row, no ids: an empty table."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    tokenized(ordered, path, end_id).write.options(**(layout() | options)).parquet(out)


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, n_tokens and the place of each row (file number, row in it); reads no token page."""
    return spark.read.schema("doc_id bigint, n_tokens bigint").parquet(out).select("doc_id", "n_tokens", *_place())


def read_tokens(spark: SparkSession, out: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, tokens of the ids in [low, high]; the range reaches the scan, which skips row groups and pages by their indexes."""
    df = spark.read.schema(SCHEMA).parquet(out)
    df = df if low is None else df.where(F.col("doc_id") >= low)
    df = df if high is None else df.where(F.col("doc_id") <= high)
    return df.select("doc_id", "tokens", *_place())


def _place():
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("row")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, file, row, n_tokens, ids_crc32 of read_tokens()' rows: the checksum of the ids as little-endian
    unsigned 32-bit integers. Equal lists have equal checksums; an empty list has 0; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("tokens")
            flat, at = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")), lists.offsets.to_numpy()
            at, view = at - at[0], memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", "file", "row")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id bigint, file int, row bigint, n_tokens bigint, ids_crc32 bigint")


def with_start(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """Adds start: the number of ids in all rows before. One total for each file goes to the driver, running sums stay in files."""
    totals = sorted(read_metadata(spark, out).groupBy("file").agg(F.sum("n_tokens")).collect())
    start, table = 0, []
    for file, n in totals:
        table.append((file, start))
        start += n
    before = F.sum("n_tokens").over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    running = rows.withColumn("_before", F.coalesce(before, F.lit(0)))
    return running.join(F.broadcast(small_frame(spark, table, "file int, _first bigint")), "file").withColumn("start", F.col("_first") + F.col("_before")).drop("_first", "_before")
