"""Repository files: inventory, contents, manifests, configuration and reports, read on the driver as a repository is local to it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.functions import paths as P
from auditlake.operators.lineage import repo_key

FILES, DEPTH, IGNORE_BYTES = 100_000, 50, 131_072


class InventoryError(ValueError):
    pass


def ignored_directory(name: str) -> bool:
    return name in P.IGNORED_DIRECTORIES or name.startswith(".venv-")


def limit(value: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise InventoryError(f"{name} must be a non-negative integer")
    return value


def excluded(patterns: list[str]) -> list[re.Pattern[str]]:
    return [re.compile(P.glob_regex(P.exclude_pattern(p))) for p in patterns]


def entries(folder: Path, prefix: str, depth: int, patterns: list[re.Pattern[str]], max_depth: int, deep: bool = True) -> Iterator[tuple[str, str, int]]:
    """(path, kind, size) of a folder's entries and, if deep, of all below, in order of name. Links are recorded and not followed,
    excluded and ignored directories never entered; too many levels are an error."""
    if depth > max_depth:
        raise InventoryError(f"the repository is deeper than {max_depth} levels")
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        path = prefix + e.name
        if any(p.match(path) or p.match(path + "/") for p in patterns):
            continue
        if e.is_symlink():
            yield path, "symlink", 0
        elif e.is_dir():
            if deep and not ignored_directory(e.name):
                yield from entries(Path(e.path), path + "/", depth + 1, patterns, max_depth)
        elif e.is_file():
            yield path, "file", e.stat().st_size


def walk(root: str, exclude: list[str] | None = None, max_files: int = FILES, max_depth: int = DEPTH) -> list[tuple[str, str, int]]:
    """All entries below root. Too many files or levels are an error, never a silent cut."""
    limit(max_files, "max_files"), limit(max_depth, "max_depth")
    out: list[tuple[str, str, int]] = []
    for entry in entries(Path(root), "", 0, excluded(exclude or []), max_depth):
        out.append(entry)
        if len(out) > max_files:
            raise InventoryError(f"the repository has more than {max_files} files")
    return out


def inventory(spark: SparkSession, root: str, exclude: list[str] | None = None, **limits) -> DataFrame:
    return spark.createDataFrame(walk(root, exclude, **limits), S.FILES)


def read_text(base: Path, path: str, most_bytes: int) -> str | None:
    """The text of a file inside base (a resolved folder); null for one that is too large, gone, or reached by a link that leaves base."""
    real = (base / path).resolve()
    if not real.is_relative_to(base) or not real.is_file() or real.stat().st_size > most_bytes:
        return None
    return real.read_bytes().decode("utf-8", "replace")


def contents(spark: SparkSession, root: str, paths: list[str], most_bytes: int = 1_048_576) -> DataFrame:
    """path, content of files inside root that are text of at most so many bytes; links that leave root are refused."""
    base = Path(root).resolve()
    rows = [(p, text) for p in paths if (text := read_text(base, p, most_bytes)) is not None]
    return spark.createDataFrame(rows, S.CONTENTS)


def manifests(files: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each package.json: valid with its JSON, or invalid with the reason."""
    k = repo_key(files)
    rows = files.where("kind = 'file'").where(P.basename(F.col("path")) == "package.json").select(*k, "path").join(texts.select(*k, "path", "content"), [*k, "path"], "left")
    parsed = F.try_parse_json("content")
    whole = parsed.isNotNull() & F.startswith(F.to_json(parsed), F.lit("{"))
    why = F.when(F.col("content").isNull(), "could not be read").when(parsed.isNull(), "is not valid JSON").when(~whole, "is not a JSON object")
    return rows.select(*k, "path", F.when(whole, "valid").otherwise("invalid").alias("status"), F.when(whole, F.col("content")).alias("data"), why.alias("error"))


def config(root: str) -> dict:
    """The optional configuration file: `exclude`, a list of patterns, and nothing else."""
    path = Path(root) / P.CONFIG_FILE
    if not path.exists():
        return {"exclude": []}
    try:
        data = json.loads(path.read_text())
    except (OSError, ValueError) as e:
        raise InventoryError(f"{P.CONFIG_FILE} is not readable JSON") from e
    if not isinstance(data, dict) or {*data} - {"exclude"}:
        raise InventoryError(f"{P.CONFIG_FILE} may hold `exclude` alone")
    listed = data.get("exclude", [])
    if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
        raise InventoryError("`exclude` must be a list of texts")
    return {"exclude": [P.exclude_pattern(x) for x in listed]}


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, severity of an earlier report; an error unless it is schema 1 of this tool and every finding has both."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise InventoryError("the baseline is not readable JSON") from e
    if not isinstance(data, dict) or data.get("schemaVersion") != "1" or (data.get("tool") or {}).get("name") != "auditlake":
        raise InventoryError("the baseline is no report of this tool, schema 1")
    rows = []
    for f in data.get("findings") or []:
        if not isinstance(f, dict) or not f.get("fingerprint") or f.get("severity") not in ("info", "low", "medium", "high", "critical"):
            raise InventoryError("a baseline finding has no fingerprint or no known severity")
        rows.append((f["fingerprint"], f["severity"]))
    return spark.createDataFrame(rows, "fingerprint string, severity string")


def ignore_prefixes(files: DataFrame, texts: DataFrame, most_bytes: int = IGNORE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path prefixes that literal ignore rules cover; limitations (value) of ignore files that are too large)."""
    k = repo_key(files)
    rows = files.where("kind = 'file'").where(P.basename(F.col("path")) == ".gitignore")
    big = rows.where(F.col("size") > most_bytes).select(*k, F.concat("path", F.lit(f": ignore evidence exceeds the {most_bytes}-byte limit.")).alias("value"))
    lines = rows.where(F.col("size") <= most_bytes).join(texts.select(*k, "path", "content"), [*k, "path"]).select(*k, "path", F.explode(F.split("content", "\r?\n")).alias("line"))
    return lines.select(*k, P.ignore_prefix(F.col("path"), F.col("line")).alias("prefix")).where("prefix is not null").distinct(), big
