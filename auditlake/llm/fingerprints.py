"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions alone.

A sketch keeps every distinct shingle hash below a fixed fraction (1/scale) of the hash range, and the number of distinct
shingles beside them. Sketches of very unequal documents share one hash threshold, the union of two is the sketch of the joined
documents, and the share of the smaller one found in the larger estimates containment. Estimates come from sketches alone, whatever
the length of the texts: half of all hashes are kept, so texts of a few sentences are told apart too. Where the smaller sketch has no hash
(a text of n shingles has none in one of 2^n cases), equal sketches are alike and others are not.

Words are maximal runs of letters, marks and digits, in lower case. A shingle is `width` words in a row; a text of
fewer words has one shingle of all of them; a text without words (also a null or empty one) has the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import LONG_MIN, bucket_of, id_cuts, let, longs, order_key

WIDTH, SCALE = 5, 2


def threshold(scale: int) -> int:
    """Hashes below it are kept: the lowest 1/scale of the signed 64-bit range."""
    return LONG_MIN + 2**64 // scale


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """array<bigint>: a hash for each shingle, in text order."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(words(text), of)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """struct<n, hashes>: the number of distinct shingles, and the sorted hashes below the threshold."""
    return let(F.array_distinct(shingle_hashes(text, width)), lambda h: F.struct(F.size(h).alias("n"), F.sort_array(F.filter(h, lambda x: x < F.lit(threshold(scale)))).alias("hashes")))


def merge(a: Column, b: Column) -> Column:
    """The sorted hashes of the sketch of both documents' shingles together."""
    return F.sort_array(F.array_union(a["hashes"], b["hashes"]))


def _share(a: Column, b: Column) -> Column:
    """The share of the smaller set that lies in the larger."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def _estimate(a: Column, b: Column, some: Column, share: Column) -> Column:
    """share where there are hashes to tell by; two empty shingle sets are alike (1), one is not (0); without hashes, equal sketches are."""
    same = (a["n"] == b["n"]) & (a["hashes"] == b["hashes"])
    return F.when((a["n"] == 0) | (b["n"] == 0), (a["n"] == b["n"]).cast("double")).when(some > 0, share).otherwise(same.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that lies in the larger."""
    return _estimate(a, b, F.least(F.size(a["hashes"]), F.size(b["hashes"])), _share(a["hashes"], b["hashes"]))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets."""
    all_ = F.size(F.array_union(a["hashes"], b["hashes"]))
    return _estimate(a, b, all_, F.size(F.array_intersect(a["hashes"], b["hashes"])) / all_)


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, sketch for each row. Other columns are ignored; repeated ids give a row each; texts of any length count whole."""
    return docs.select("doc_id", sketch(F.col("text"), width, scale).alias("sketch"))


def as_text(s: Column) -> Column:
    """A sketch as the number of shingles, a colon, and fixed-width hexadecimal, 16 digits a hash."""
    return F.concat(s["n"].cast("string"), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, columns: list[str], cuts: list[int]) -> DataFrame:
    """Adds a struct `next` of the columns of the row with the next doc_id (after the last: the first), ties by text.

    Rows go to buckets of consecutive ids; the first row of each bucket is also sent to the bucket before it, so
    no task sees more than one bucket and no row is looked up elsewhere.
    """
    n, key = len(cuts), order_key(F.col("doc_id"))
    own = docs.withColumn("_key", key).withColumn("_own", bucket_of(F.col("_key"), cuts).cast("int"))
    before = F.pmod(F.col("_own") - 1, F.lit(n)).cast("int")
    spread = own.withColumn(
        "_to",
        F.explode(
            F.when(
                F.col("_key") == F.get(longs(cuts), F.col("_own")),
                F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy"))),
            ).otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("copy"))))
        ),
    ).select("*", F.col("_to.b").alias("_b"), F.col("_to.copy").alias("_copy"))
    order = W.partitionBy("_b").orderBy("_copy", "_key", "text")
    return (
        spread.withColumn("next", F.lead(F.struct(*columns)).over(order))
        .where(~F.col("_copy"))
        .drop("_key", "_own", "_to", "_b", "_copy")
    )


def edited_pairs(docs: DataFrame, width: int = WIDTH, scale: int = SCALE, rows_each: int = 512) -> DataFrame:
    """Each text beside its edited text (the last quarter replaced by the start of the next document), with both sketches.

    Null texts count as empty, null ids come first, rows with equal ids are ordered by text, a single row is its own
    next document and an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = id_cuts(base.select("doc_id"), order_key(F.col("doc_id")), rows_each, 65_536)
    # Texts alone are shuffled: sketches are made where both neighbours are.
    paired = with_next(base, ["text"], cuts)
    n = F.length("text").cast("bigint")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", (n - quarter).cast("int")), F.left("next.text", quarter))
    out = paired.select("doc_id", "text", F.col("next.text").alias("next_text"), n.alias("n_chars"), edited.alias("edited"))
    return out.withColumns({"sketch": sketch(F.col("text"), width, scale), "edited_sketch": sketch(F.col("edited"), width, scale), "next_sketch": sketch(F.col("next_text"), width, scale)})
