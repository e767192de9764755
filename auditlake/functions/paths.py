"""Repository paths as Columns: parts, normalisation, safety, globs and classification."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that the rules are defined by.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
CERTIFICATE_EXTENSIONS = (".cer", ".crt", ".pem")
IGNORED_DIRECTORIES = (
    ".cache", ".git", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".turbo", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "venv",
)
ROOT_CONTEXT = (
    ".npmrc", ".yarnrc", ".yarnrc.yml", "Cargo.toml", "bun.lock", "bun.lockb", "bunfig.toml", "build.gradle", "build.gradle.kts", "go.mod", "go.work",
    "npm-shrinkwrap.json", "package-lock.json", "package.json", "pnpm-lock.yaml", "pnpm-workspace.yaml", "pom.xml", "pyproject.toml", "setup.cfg", "setup.py",
    "settings.gradle", "settings.gradle.kts", "yarn.lock",
)
CONFIG_FILE = ".auditlake.json"
FIXTURE_SEGMENTS = ("fixture", "fixtures", "__fixtures__", "__testfixtures__")


def let(value: Column, body) -> Column:
    """body(value) with value computed, and written in the plan, once."""
    return F.transform(F.array(value), body)[0]


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory of a repository path; `.` at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """The last extension with its dot, empty for names that only begin with one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def depth(root: Column) -> Column:
    """Path segments of a root; the repository root has none."""
    return F.when(root == ".", F.lit(0)).otherwise(F.size(segments(root)))


def tied_depth(root: Column) -> Column:
    """Path segments where the repository root counts as one, and so ties with top-level directories."""
    return F.size(segments(root))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, `.` included: what an ownership join explodes instead of a theta join."""
    s = segments(path)
    own = F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit(".")), own))


def contains_path(root: Column, path: Column) -> Column:
    """Whether a project root holds a path, at segment borders."""
    return (root == ".") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def under_prefix(path: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/"))))


def in_stream(path: Column, root: Column) -> Column:
    """A .sql file in a stream's folder, or the stream's own file."""
    return F.endswith(path, F.lit(".sql")) & ((path == root) | F.startswith(path, F.concat(root, F.lit("/"))))


def normalized(path: Column) -> Column:
    """POSIX normalisation: dot segments folded, empty segments dropped, `.` for nothing; a trailing slash stays."""

    return let(path, _normalized)


def _normalized(path: Column) -> Column:
    def fold(done: Column, s: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("..")), done), -1)
        up = s == ".."
        return (
            F.when((s == "") | (s == "."), done)
            .when(up & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .when(up & F.startswith(path, F.lit("/")), done)
            .otherwise(F.concat(done, F.array(s)))
        )

    kept = F.array_join(F.aggregate(segments(path), F.array().cast("array<string>"), fold), "/")
    head = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    tail = lambda k: F.when(F.endswith(path, F.lit("/")) & (k != ""), F.lit("/")).otherwise(F.lit(""))
    none = F.when(F.endswith(path, F.lit("/")), F.lit("./")).otherwise(F.lit("."))
    return let(kept, lambda k: F.when((head == "") & (k == ""), none).otherwise(F.concat(head, k, tail(k))))


def joined(base: Column, value: Column) -> Column:
    """A value below a base directory, normalised; null if it is absolute, has a backslash or NUL, or leaves the repository."""
    bad = lambda v: F.contains(v, F.lit("\\")) | F.contains(v, F.lit("\0")) | F.startswith(v, F.lit("/"))
    out = lambda w: (w == "..") | F.startswith(w, F.lit("../"))
    at = lambda v: normalized(F.when(v == "", base).when(base == ".", v).otherwise(F.concat(base, F.lit("/"), v)))
    return let(value, lambda v: let(at(v), lambda w: F.when(~bad(v) & ~out(w), w)))


def safe_config_path(base: Column, value: Column) -> Column:
    """A path that a source configuration names: as joined(), and no URL."""
    return F.when(F.rlike(value, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), None).otherwise(joined(base, value))


def safe_plain_path(base: Column, value: Column) -> Column:
    """As joined(), for values without any dot segment; the base itself is refused."""
    dots = lambda v: F.arrays_overlap(segments(v), F.array(F.lit("."), F.lit("..")))
    return let(value, lambda v: let(joined(base, v), lambda w: F.when(~dots(v) & (w != "."), w)))


def safe_lock_path(value: Column) -> Column:
    """A lockfile's package path: empty for the root, else already normal and inside; null otherwise."""
    bad = lambda v: F.contains(v, F.lit("\\")) | F.contains(v, F.lit("\0")) | F.startswith(v, F.lit("/")) | F.array_contains(segments(v), "..")
    return let(value, lambda v: F.when(v == "", v).when(~bad(v) & (v != ".") & (normalized(v) == v), v))


def repository_path(value: Column) -> Column:
    """A path that a change report names, normalised; an error if it leaves the repository."""
    wrong = F.raise_error(F.lit("path is outside the repository")).cast("string")
    return let(joined(F.lit("."), value), lambda w: F.when(w.isNull() | (w == "."), wrong).otherwise(w))


def strict_repository_path(value: Column) -> Column:
    """As repository_path(), and an error on any `..`."""
    return F.when(F.array_contains(segments(value), ".."), F.raise_error(F.lit("path is outside the repository")).cast("string")).otherwise(repository_path(value))


def relative(base: Column, path: Column) -> Column:
    """path as seen from a base that holds it (empty for the base itself), climbing with `..` where it must."""
    parts = lambda p: F.when(p == ".", F.array().cast("array<string>")).otherwise(segments(p))

    def of(b: Column, p: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.least(F.size(b), F.size(p)), F.lit(1)))
        same = F.aggregate(at, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(b, i - 1) == F.get(p, i - 1)), i).otherwise(n))
        climb = lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - n), F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0)))), "/")
        return let(same, climb)

    return let(parts(base), lambda b: let(parts(path), lambda p: of(b, p)))


# Globs


def exclude_pattern(pattern: str) -> str:
    """A checked exclude pattern: forward slashes, no leading ./; ValueError if it is empty, absolute or leaves the repository."""
    clean = re.sub(r"^(\./)+", "", pattern.strip().replace("\\", "/"))
    if not clean or clean == "." or clean.startswith("/") or re.match(r"[A-Za-z]:", clean) or ".." in clean.split("/") or "\0" in clean:
        raise ValueError(f"exclude pattern is not a path inside the repository: {pattern!r}")
    return clean


def glob_regex(pattern: str) -> str:
    """`**/` is any number of directories, `**` anything, `*` and `?` stay in a segment."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t, "\\" + t if not t.isalnum() and t not in "_/" and len(t) == 1 and ord(t) < 128 else t) for t in re.findall(r"\*\*/|\*\*|.", pattern, re.S)) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches the path as a file or as a directory."""
    out = F.lit(False)
    for p in patterns:
        r = F.lit(glob_regex(exclude_pattern(p)))
        out = out | F.rlike(path, r) | F.rlike(F.concat(path, F.lit("/")), r)
    return out


# Classification


def is_ignored_directory(name: Column) -> Column:
    return name.isin(*IGNORED_DIRECTORIES) | F.startswith(name, F.lit(".venv-"))


def is_source(path: Column) -> Column:
    return F.lower(extension(path)).isin(*SOURCE_EXTENSIONS)


def is_explicit_target(value: Column) -> Column:
    """A literal target with a source extension; one wildcard stands for a name."""
    return is_source(F.regexp_replace(value, F.lit(r"\*"), F.lit("x")))


def is_local_environment(path: Column) -> Column:
    name = F.lower(basename(path))
    return ((name == ".env") | F.startswith(name, F.lit(".env."))) & ~F.rlike(name, F.lit(r"\.(example|sample|template)$"))


def is_certificate_candidate(path: Column) -> Column:
    return F.lower(extension(path)).isin(*CERTIFICATE_EXTENSIONS)


def looks_like_test(path: Column) -> Column:
    named = F.rlike(basename(path), F.lit(r"\.(?:test|spec)\.[^.]+$|^test_.+\.py$|_test\.go$"))
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, ("test", "tests", "__tests__")))) | named


def is_pytest_evidence(path: Column) -> Column:
    name = basename(path)
    return name.isin("pytest.ini", "tox.ini", "conftest.py") | F.rlike(name, F.lit(r"^test_.+\.py$")) | F.arrays_overlap(segments(path), F.array(F.lit("test"), F.lit("tests")))


def is_root_context(path: Column) -> Column:
    named = path.isin(CONFIG_FILE, *ROOT_CONTEXT) | F.rlike(path, F.lit(r"^tsconfig(?:\..+)?\.json$|^requirements(?:[-.].*)?\.txt$"))
    return ~F.contains(path, F.lit("/")) & named


def is_fixture(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, FIXTURE_SEGMENTS)))


def line_count(content: Column) -> Column:
    """Lines of a text; an empty one has none, and a line end at the very end begins no line."""
    return F.when(content == "", F.lit(0)).otherwise(F.size(F.split(content, "\n")) - F.endswith(content, F.lit("\n")).cast("int"))


def project_id(root: Column) -> Column:
    return F.when(root == ".", F.lit("root")).otherwise(F.concat(F.lit("project:"), root))


def at_root(root: Column, name: Column) -> Column:
    return F.when(root == ".", name).otherwise(F.concat(root, F.lit("/"), name))


def ignore_prefix(ignore_path: Column, line: Column) -> Column:
    """The literal path prefix that a line of an ignore file covers; null for comments, negations, escapes and inner wildcards."""
    plain = ~F.rlike(line, F.lit(r"^\s")) & ~F.rlike(line, F.lit(r"^[#!]")) & ~F.rlike(line, F.lit(r"[\\?\[\]{}]"))
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.rtrim(line), "^/", ""), r"/\*\*?$", ""), "/+$", "")
    return F.when(plain, let(cut, lambda c: F.when(~F.contains(c, F.lit("*")) & (c != ""), safe_plain_path(dirname(ignore_path), c))))


def publication_entry(value: Column) -> Column:
    """struct(path, prefix) of an entry of a package's published files; null if it is no plain path."""
    text = F.regexp_replace(value, r"^\./", "")
    cut = F.regexp_replace(text, r"/(\*\*)?$", "")
    good = (value != "") & ~F.rlike(value, F.lit(r"[\\\x00]|^/")) & (cut != "") & ~F.rlike(cut, F.lit(r"[*?\[\]{}]"))
    made = lambda w: F.when(w.isNotNull(), F.named_struct(F.lit("path"), w, F.lit("prefix"), (cut != text) | (extension(w) == "")))
    return F.when(good, let(safe_plain_path(F.lit("."), cut), made))
