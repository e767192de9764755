"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import fingerprints, importance, infill, langid, linededup, media, mixing, neardup, packing, quality, secretscan, sharding, tokenfiles
from auditlake.llm.common import Tables, documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(documents(spark, sf_dir))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        *[fingerprints.containment(F.col("sketch"), F.col(f"{other}_sketch")).alias(f"near_{other}") for other in ("edited", "next")],
        *[fingerprints.resemblance(F.col("sketch"), F.col(f"{other}_sketch")).alias(f"resemblance_{other}") for other in ("edited", "next")],
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Tables(spark, "tokens").path("files")
    tokenfiles.write_tokens(documents(spark, sf_dir), out)
    rows = tokenfiles.checksums(tokenfiles.read_tokens(spark, out))
    return tokenfiles.with_start(spark, out, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(documents(spark, sf_dir), Tables(spark, "media").path("wav"))
    digest = F.sha2(F.to_json(F.struct("times", "codes")), 256).alias("feature")
    return media.features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest, "times", "codes")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix(documents(spark, sf_dir), labels)
    shares = [F.get("p", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(mixing.TARGETS)]
    return mixed.select(F.when(F.col("doc") != F.lit(-(2**63)), F.col("doc")).alias("doc_id"), "n_tokens", *shares, "rate")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find_secrets(documents(spark, sf_dir)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(langid.learning_rows(docs)))
    return langid.identify(docs, model, "doc_id").select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~langid.held_out(3, 1)))
    out = quality.score(docs, model, "doc_id")
    return out.select("doc_id", langid.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle(sharding.sized(documents(spark, sf_dir)), ties=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(documents(spark, sf_dir), outputs=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_fingerprints, op2_token_files, op3_near_dedup, op4_media_columns, op5_packing, op6_mixing, op7_line_dedup, op8_secret_scans, op9_language_id, op10_quality,
        op11_sharding, op12_fill_in_middle, op13_importance,
    )}


def oracle_sql() -> dict[str, str]:
    """Only where SQL expresses the whole operator."""
    return {"op7_line_dedup": linededup.ORACLE, "op11_sharding": sharding.oracle(), "op12_fill_in_middle": infill.ORACLE, "op13_importance": importance.ORACLE}
