"""Package names, dependency sources, integrity and package managers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.paths import let

# Fixed values.
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
INSTALLED_SECTIONS = SECTIONS[:3]
MANAGERS = ("npm", "pnpm", "yarn", "bun")
LOCKFILES = {"package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lock": "bun", "bun.lockb": "bun"}
NAME_LENGTH = 214
AI_NAMES, AI_SCOPES = ("openai", "@anthropic-ai/sdk", "ai", "langchain", "llamaindex"), ("@ai-sdk/", "@langchain/", "@llamaindex/")
LOCAL_SOURCES = ("local-file", "local-link", "workspace")


def safe_name(value: Column) -> Column:
    """The name if it is a package name, scoped or not, of bounded length; else null."""
    return F.when((F.length(value) <= NAME_LENGTH) & F.rlike(value, F.lit(r"^(?:@[A-Za-z0-9._~-]+/)?[A-Za-z0-9._~-]+\z")), value)


def fragment(value: Column) -> Column:
    """What follows the last #; null if nothing does."""
    return F.nullif(F.regexp_extract(value, r"(?s)#([^#]*)\z", 1), F.lit(""))


def is_git_source(value: Column) -> Column:
    return F.rlike(value, F.lit(r"(?i)^(?:git\+|git@|git:|ssh:|github:|gitlab:|bitbucket:)|^https://\S+\.git(?:#.*)?\z|^[^\s/:]+/[^\s/]+(?:#.*)?\z"))


def source_class(raw: Column) -> Column:
    """The class of a dependency's source; ssh sources always count as git."""
    return let(F.trim(raw), _source_class)


def _source_class(value: Column) -> Column:
    low = F.lower(value)
    starts = lambda *p: F.rlike(low, F.lit("^(?:" + "|".join(p) + ")"))
    return (
        F.when(starts(r"git\+http://", "http://"), "insecure-http")
        .when(starts("git://"), "insecure-git")
        .when(starts("file:"), "local-file")
        .when(starts("link:"), "local-link")
        .when(starts("workspace:"), "workspace")
        .when(is_git_source(value), F.when(F.rlike(F.coalesce(fragment(value), F.lit("")), F.lit(r"(?i)^[0-9a-f]{40}\z")), "git-pinned").otherwise("git-mutable"))
        .when(starts("https://"), "secure-https")
        .when(F.rlike(value, F.lit(r"(?i)^(?:[~^<>=*]|\d|latest\b|next\b)")), "registry")
        .otherwise("unknown")
    )


def name_from_path(path: Column) -> Column:
    """The package that a lockfile path installs: what follows its last node_modules segment."""
    return safe_name(F.nullif(F.regexp_extract(path, r"^(?:.*/)?node_modules/((?:@[^/]*/)?[^/]*)", 1), F.lit("")))


def is_tarball(resolved: Column) -> Column:
    return F.coalesce(F.rlike(resolved, F.lit(r"(?i)^https://[^\s?#]+\.tgz(?:[?#]|\z)")), F.lit(False))


def valid_integrity(value: Column) -> Column:
    return F.forall(F.split(F.trim(value), r"\s+"), lambda t: F.rlike(t, F.lit(r"^(?:sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}(?:\?\S+)?\z")))


def integrity_status(path: Column, link: Column, source: Column, tarball: Column, present: Column, value: Column) -> Column:
    """present: the entry names an integrity; value: its text, null if it is none."""
    needed = ~link & F.array_contains(F.split(path, "/"), "node_modules") & (source == "secure-https") & tarball
    return F.when(~needed, "not-required").when(~present, "missing").when(F.coalesce(valid_integrity(value), F.lit(False)), "valid").otherwise("invalid")


def declared_manager(declaration: Column) -> Column:
    name = F.substring_index(declaration, "@", 1)
    return F.when(name.isin(*MANAGERS), name)


def is_ai_dependency(name: Column) -> Column:
    low = F.lower(name)
    out = low.isin(*AI_NAMES)
    for scope in AI_SCOPES:
        out = out | F.startswith(low, F.lit(scope))
    return out


def package_identity(specifier: Column) -> Column:
    """struct(name, subpath) of a bare import; null for anything else."""
    shape = F.rlike(specifier, F.lit(r"^(?:@[^/]+/[^/]+|[^@./][^/]*)"))
    name = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when(shape & (name != ""), F.struct(name.alias("name"), F.regexp_replace(F.substring(specifier, F.length(name) + 1, F.length(specifier)), "^/", "").alias("subpath")))


def dependency_free(names: Column) -> Column:
    """Known to have no dependency, which unknown ones are not."""
    return names.isNotNull() & (F.size(names) == 0)
