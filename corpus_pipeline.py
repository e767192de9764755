"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents, whatever other columns there are and whatever their names. Rows are told apart by doc_id and a hash of the text, so
repeated ids do no harm; a null doc_id is an id like any other. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import langid, linededup, mixing, neardup, packing
from auditlake.llm.common import Tables, documents, order_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts, those without a letter, and those no language of which has
    a posterior of one half (as in a tie). Repeated rows all stay or all go."""
    model = langid.fit(docs.where(langid.learning_rows(docs)))
    found = langid.identify(docs.select(F.struct("*").alias("row")), model, "row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines go; documents of nothing else go with them. Null texts stay; n_chars is counted anew where lines went."""
    out = linededup.drop_lines(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c not in ("doc_id", "text")}))
    out = out.where(~((F.col("n_dropped") > 0) & (F.trim("text") == "")) | F.col("text").isNull())
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("own_n_chars") if "n_chars" in docs.columns else F.lit(None))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else size.alias(c) if c == "n_chars" else F.col(f"own_{c}").alias(c) for c in docs.columns])


def _keyed(docs: DataFrame, text) -> DataFrame:
    return docs.select(order_key(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("tie"), F.struct("*").alias("row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the lowest doc_id (then the lowest hash of its text). Of rows that agree in
    doc_id and text the first by their other plain columns stays. Null and empty texts are one class."""
    classes = neardup.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = classes.groupBy("class_id").agg(F.min("tie").alias("tie")).select(order_key(F.col("class_id")).alias("doc"), "tie")
    stay = Tables(spark, "stay").keep(stay, "stay")
    rows = _keyed(docs, F.coalesce("text", F.lit(""))).join(stay, ["doc", "tie"], "left_semi")
    plain = [F.col("row").getField(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name != "text"]
    first = rows.withColumn("copy", F.row_number().over(W.partitionBy("doc", "tie").orderBy(*plain)))
    return first.where("copy = 1").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their rates, which are fitted within 0 and 1: no document is repeated, and those at rate 1 always
    stay. The mixture is sized by the good documents, so that a scarce domain doesn't cost any of them. Null and empty texts
    have no tokens and the prior's rate; equal rows have equal draws."""
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix(docs, labels, stretch=1.1, anchor="good", most=1.0)
    stay = mixed.where(mixing.keeps(F.col("doc"), F.col("tie"), F.col("rate"))).select("doc", "tie")
    return _keyed(docs, F.col("text")).join(stay, ["doc", "tie"], "left_semi").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents kept, in sequences of at most 4096 tokens. A null or empty text is its end id alone; repeated rows are
    documents of their own."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Language models, sampling and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = documents(spark, sf_dir), Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
