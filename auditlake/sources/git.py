"""Changed and shareable paths from git, by argument lists without a shell."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.functions import paths as P
from auditlake.operators.findings import merged_changes

Runner = Callable[[str, list[str]], str]
OUTPUT_BYTES = 16 << 20
UNAVAILABLE = "The shareable file list is not available; local environment files were left out by name."
PLAIN = {"A": "added", "D": "deleted", "M": "modified", "T": "modified"}
SCORED = {"R": "renamed", "C": "copied"}


class GitError(RuntimeError):
    """code: not-repository, invalid-base-ref, root-mismatch, command-failed or invalid-output."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def run(root: str, args: list[str]) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=120)
    if len(done.stdout) > OUTPUT_BYTES:
        raise ValueError("too much output")
    return done.stdout.decode("utf-8", "surrogateescape")


def _call(runner: Runner, root: str, args: list[str], code: str, message: str) -> str:
    try:
        return runner(root, args)
    except (OSError, ValueError, subprocess.SubprocessError) as e:
        raise GitError(code, message) from e


def fields(output: str) -> list[str]:
    """NUL-ended fields; anything after the last NUL is an error."""
    if output and not output.endswith("\0"):
        raise GitError("invalid-output", "git output is not NUL-terminated")
    return output.split("\0")[:-1] if output else []


def name_status(output: str) -> list[tuple[str, str, str | None]]:
    """(path, status, previous path) of `diff --name-status -z`."""
    out, it = [], iter(fields(output))
    for mark in it:
        m = re.fullmatch(r"([RC])(\d{1,3})", mark)
        try:
            if mark in PLAIN:
                out.append((repository_path(next(it)), PLAIN[mark], None))
            elif m and int(m[2]) <= 100:
                old = repository_path(next(it))
                out.append((repository_path(next(it)), SCORED[m[1]], old))
            else:
                raise GitError("invalid-output", "git reported an unknown status")
        except StopIteration:
            raise GitError("invalid-output", "git output ends within a change") from None
    return out


def untracked(output: str) -> list[tuple[str, str, str | None]]:
    return [(repository_path(p), "untracked", None) for p in fields(output)]


def repository_path(value: str) -> str:
    import posixpath

    whole = posixpath.normpath(value) if value else ""
    if not value or "\\" in value or value.startswith("/") or whole in (".", "..") or whole.startswith("../"):
        raise GitError("invalid-output", "git reported a path outside the repository")
    return whole


def strict_path(value: str) -> str:
    """As repository_path(), and no `..` at all."""
    if ".." in value.split("/"):
        raise GitError("invalid-output", "git reported a path outside the repository")
    return repository_path(value)


def commit(output: str) -> str:
    if not re.fullmatch("[0-9a-f]{40,64}", output.strip()):
        raise GitError("invalid-output", "git reported no commit")
    return output.strip()


def changes(spark: SparkSession, root: str, base: str | None = None, runner: Runner = run) -> tuple[dict, DataFrame]:
    """(base, changed paths) against HEAD, or against the merge base with a given reference; the root must be the repository's."""
    if base is not None and not base.strip():
        raise GitError("invalid-base-ref", "the base reference is blank")
    top = _call(runner, root, ["rev-parse", "--show-toplevel"], "not-repository", "this is no git repository")
    if Path(top.removesuffix("\n")).resolve() != Path(root).resolve():
        raise GitError("root-mismatch", "the root is not the repository's root")
    if base is None:
        at = commit(_call(runner, root, ["rev-parse", "HEAD^{commit}"], "command-failed", "HEAD can't be resolved"))
    else:
        at = commit(_call(runner, root, ["merge-base", "--", base, "HEAD"], "invalid-base-ref", "the base reference can't be resolved"))
    diff = _call(runner, root, ["diff", "--name-status", "-z", "--find-renames", "--find-copies", at], "command-failed", "tracked changes can't be read")
    new = _call(runner, root, ["ls-files", "--others", "--exclude-standard", "-z"], "command-failed", "untracked files can't be read")
    views = [spark.createDataFrame(rows, S.CHANGES) for rows in (name_status(diff), untracked(new))]
    return {"kind": "head" if base is None else "merge-base", "requested_ref": base, "resolved_commit": at}, merged_changes(*views)


def checked_changes(rows: DataFrame) -> DataFrame:
    """Changes with normal paths; an error unless exactly renames and copies have a previous path."""
    needs = F.col("status").isin("renamed", "copied")
    wrong = needs != F.col("previous_path").isNotNull()
    path = F.when(wrong, F.raise_error(F.lit("a change's previous path doesn't fit its status")).cast("string")).otherwise(P.repository_path(F.col("path")))
    return rows.select(path.alias("path"), "status", F.when(F.col("previous_path").isNotNull(), P.repository_path(F.col("previous_path"))).alias("previous_path"))


def shareable(spark: SparkSession, root: str, runner: Runner = run) -> tuple[DataFrame | None, str | None]:
    """(paths that git tracks or would add, None), or (None, the limitation) if git can't tell."""
    try:
        rows = sorted({strict_path(p) for p in fields(runner(root, ["ls-files", "--cached", "--others", "--exclude-standard", "-z"]))})
        return spark.createDataFrame([(p,) for p in rows], "path string"), None
    except (OSError, ValueError, subprocess.SubprocessError, GitError):
        return None, UNAVAILABLE
