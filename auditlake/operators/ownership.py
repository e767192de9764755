"""Longest-prefix joins: each path's ancestors are exploded and joined by equality, never by a prefix condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators.lineage import repo_key


def owned(files: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """files with project_id, the deepest project (id, root) that holds the path; null where none does."""
    k = repo_key(files)
    up = files.select(*k, path).distinct().select(*k, path, F.explode(P.ancestors(F.col(path))).alias("root"))
    best = up.join(projects.select(*k, "id", "root"), [*k, "root"]).groupBy(*k, path).agg(F.max_by("id", F.struct(P.depth(F.col("root")), "id")).alias("project_id"))
    return files.drop("project_id").join(best, [*k, path], "left")


def owned_or_first(files: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """As owned(), with the first project by id for paths that none holds."""
    first = projects.agg(F.min("id").alias("_first"))
    return owned(files, projects, path).join(F.broadcast(first)).withColumn("project_id", F.coalesce("project_id", "_first")).drop("_first")


def nearest(files: DataFrame, places: DataFrame, path: str = "path") -> DataFrame:
    """files with place, the nearest of places (directory, place) above the path. The root counts one segment and so ties
    with top-level directories; ties go to the first place by text."""
    k = repo_key(files)
    up = files.select(*k, path).distinct().select(*k, path, F.explode(P.ancestors(F.col(path))).alias("directory"))
    best = up.join(places.select(*k, "directory", "place"), [*k, "directory"]).groupBy(*k, path).agg(F.min_by("place", F.struct(-P.tied_depth(F.col("directory")), "place")).alias("place"))
    return files.join(best, [*k, path], "left")


def python_owned(files: DataFrame, projects: DataFrame) -> DataFrame:
    """path, project_id for each Python project that holds the path and has no nested Python project (other than the root) holding it."""
    python = projects.where(F.array_contains("ecosystems", "python")).select("id", "root")
    held = files.select("path").select("path", F.explode(P.ancestors(F.col("path"))).alias("root")).join(python, "root")
    deepest = held.groupBy("path").agg(F.max(P.depth(F.col("root"))).alias("_d"))
    return held.join(deepest, "path").where(P.depth(F.col("root")) == F.col("_d")).select("path", F.col("id").alias("project_id"))


def governing_root(projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """projects with owner_root: the longest root of an npm workspace owner that lists the project; null without one."""
    lists = workspaces.where("supported").select("owner_project_id", F.explode("matched_project_roots").alias("root"))
    owners = projects.where("manager = 'npm'").select(F.col("id").alias("owner_project_id"), F.col("root").alias("owner_root"))
    best = lists.join(owners, "owner_project_id").groupBy("root").agg(F.min_by("owner_root", F.struct(-F.length("owner_root"), "owner_root")).alias("owner_root"))
    return projects.join(best, "root", "left")


def effective_manager(projects: DataFrame, files: DataFrame) -> DataFrame:
    """projects with manager: its own, npm by its own npm lock, else that of the nearest ancestor which has one (root ties with top level)."""
    locks = files.where("kind = 'file'").where(P.basename(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json")).select(P.dirname(F.col("path")).alias("root")).distinct()
    own = projects.join(locks.withColumn("_lock", F.lit(True)), "root", "left").withColumn("_own", F.coalesce("package_manager", F.when(F.col("_lock"), F.lit("npm")))).drop("_lock")
    known = own.where("_own is not null").select(F.col("root").alias("_above"), F.col("_own").alias("_theirs"))
    up = own.select("root", F.explode(P.ancestors(F.col("root"))).alias("_above")).where("_above <> root")
    theirs = up.join(known, "_above").groupBy("root").agg(F.min_by("_theirs", F.struct(-P.tied_depth(F.col("_above")), "_above")).alias("_theirs"))
    return own.join(theirs, "root", "left").withColumn("manager", F.coalesce("_own", "_theirs")).drop("_own", "_theirs")
