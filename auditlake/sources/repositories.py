"""Many repositories: a data source that lists them folder by folder, and file contents read where they are needed.

Repositories are the sub-folders of one folder that driver and executors mount alike. The driver sees the names of repositories and
of their top-level folders alone; executors walk the folders and read the files. A repository that can't be listed, has a broken
configuration file or exceeds a limit is left out with the reason, and the others go on.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditlake import schemas as S
from auditlake.functions import paths as P
from auditlake.operators.lineage import cut
from auditlake.sources.files import DEPTH, FILES, InventoryError, config, entries, excluded, ignored_directory, read_text

FORMAT, BYTES, BATCH = "repositories", 20_000_000, 8_000_000


class Folders(InputPartition):
    """(repository, top-level folder) pairs; an empty folder stands for the files at the repository's top."""

    def __init__(self, units: list[tuple[str, str]]):
        self.units = units


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.max_depth, self.parts = int(options.get("maxDepth", DEPTH)), int(options.get("partitions", 64))
        self.only = json.loads(options.get("only", "null"))

    def partitions(self) -> list[Folders]:
        """Top-level folders, dealt in turn: one repository with most of the files is walked by many tasks."""
        units = []
        for repo in sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)):
            if self.only is not None and repo not in self.only:
                continue
            units.append((repo, ""))
            try:
                below = sorted(e.name for e in os.scandir(Path(self.root) / repo) if e.is_dir(follow_symlinks=False) and not ignored_directory(e.name))
            except OSError:
                continue  # The task that lists its top tells why.
            units += [(repo, name) for name in below]
        n = max(1, min(self.parts, len(units)))
        return [Folders(units[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for repo, folder in partition.units:
            base = Path(self.root) / repo
            try:
                patterns = excluded([*self.exclude, *config(str(base))["exclude"]])
                if folder and any(p.match(folder) or p.match(folder + "/") for p in patterns):
                    continue
                inside = entries(base / folder, f"{folder}/", 1, patterns, self.max_depth) if folder else entries(base, "", 0, patterns, self.max_depth, deep=False)
                for path, kind, size in inside:
                    yield repo, path, kind, size, None
            except (InventoryError, ValueError) as e:
                yield repo, None, None, None, str(e)
            except OSError as e:
                yield repo, None, None, None, f"the repository can't be listed ({e.__class__.__name__})"


class Repositories(DataSource):
    """spark.read.format("repositories").load(folder); options exclude (a JSON list of patterns), only (of repositories), maxDepth, partitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return S.REPOSITORIES

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options)


def listed(spark: SparkSession, root: str, exclude: list[str] | None = None, only: list[str] | None = None, max_depth: int = DEPTH, partitions: int = 64) -> DataFrame:
    """Every entry of every repository (or of those named alone), and the problems met."""
    spark.dataSource.register(Repositories)
    options = {"exclude": json.dumps([P.exclude_pattern(x) for x in exclude or []]), "only": json.dumps(only), "maxDepth": str(max_depth), "partitions": str(partitions)}
    return spark.read.format(FORMAT).options(**options).load(root)


def inventory(rows: DataFrame, max_files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """(repo_id, path, kind, size of the repositories without a problem; repo_id, problem: one for each of the others)."""
    rows = cut(rows)
    many = rows.where("path is not null").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_files)
    found = rows.where("problem is not null").select("repo_id", "problem")
    problems = found.unionByName(many.select("repo_id", F.lit(f"the repository has more than {max_files} files").alias("problem")))
    problems = cut(problems.groupBy("repo_id").agg(F.min("problem").alias("problem")))
    return rows.where("path is not null").join(problems, "repo_id", "left_anti").select("repo_id", "path", "kind", "size"), problems


def reader(root: str, most_bytes: int = BYTES) -> Callable[[DataFrame], DataFrame]:
    """Reads chosen files (repo_id, path) on executors: their rows with content, files that can't be read left out.

    Files are dealt by a hash of repository and path, so a repository with most of the bytes is read by all tasks; what a task holds is one batch.
    """

    def read(files: DataFrame) -> DataFrame:
        chosen = files.select("repo_id", "path").repartition(F.hash("repo_id", "path"))

        def run(batches):
            import pyarrow as pa

            names, base = ["repo_id", "path", "content"], Path(root).resolve()
            held, size = [], 0
            for batch in batches:
                for repo, path in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist()):
                    text = read_text(base / repo, path, most_bytes)
                    if text is None:
                        continue
                    held.append((repo, path, text))
                    size += len(text)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)

        return chosen.mapInArrow(run, "repo_id string, path string, content string")

    return read
