"""Cutting lineage so that iterative plans stay small and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary folder stands in where it is unset in local mode (tests) alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder with the driver")
    local = tempfile.mkdtemp(prefix="auditlake-")
    atexit.register(shutil.rmtree, local, True)
    context.setCheckpointDir(local)
    return local


def repo_key(frame: DataFrame) -> list[str]:
    """The columns that tell repositories apart: repo_id in a scan of many, none in a scan of one."""
    return ["repo_id"] if "repo_id" in frame.columns else []


def with_content(chosen: DataFrame, contents) -> DataFrame:
    """path, content (and repo_id) of chosen files; contents: a relation, or a function that reads what is chosen, without a shuffle of texts."""
    k = [*repo_key(chosen), "path"]
    return contents(chosen) if callable(contents) else chosen.select(*k).join(contents.select(*k, "content"), k)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
