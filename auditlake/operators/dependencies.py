"""Manifests against lockfiles: drift, sources, integrity and workspace links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import packages as N
from auditlake.functions import paths as P
from auditlake.functions.core import evidence, findings

MATCH = ["family", "path", "package_name", "section", "source_class", "severity", "confidence"]
DOCTOR = "security/dependencies"
PER_ROOT, TOTAL = 100, 1_000
# Severity of each rule, and its wording here.
RULES = {
    "missing-lockfile": ("medium", "A project with external dependencies has no npm lockfile"),
    "manifest-lock-drift": ("medium", "Manifest and lockfile disagree on a dependency"),
    "insecure-source": ("high", "A dependency comes over an unprotected transport"),
    "mutable-git-source": ("medium", "A git dependency is not pinned to a commit"),
    "missing-integrity": ("medium", "A locked tarball has no valid integrity hash"),
    "workspace-registry-resolution": ("high", "A workspace package does not resolve to its member"),
    "competing-npm-lockfiles": ("low", "Two npm lockfiles compete at one root"),
}


def _match(rows: DataFrame, family: str, path: Column, name: Column | None = None, section: Column | None = None, source: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return rows.select(
        F.lit(family).alias("family"), path.alias("path"), text(name).alias("package_name"), text(section).alias("section"), text(source).alias("source_class"),
        F.lit(RULES[family][0]).alias("severity"), F.lit("high").alias("confidence"),
    )


def manifest_sections(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, section, name, spec of valid manifests; path, value limitations of bad sections and entries)."""
    valid = manifests.where("status = 'valid'").select("path", F.explode(F.array(*map(F.lit, N.SECTIONS))).alias("section"), F.try_parse_json("data").alias("v"))
    # One path for each section: variant paths are literals.
    whole = None
    for s in N.SECTIONS:
        part = F.when(F.col("section") == s, F.to_json(F.variant_get("v", f"$.{s}", "variant")))
        whole = part if whole is None else F.coalesce(whole, part)
    rows = valid.select("path", "section", whole.alias("j")).where("j is not null")
    objects = rows.where(F.startswith("j", F.lit("{")))
    entries = objects.select("path", "section", F.explode(F.from_json("j", "map<string,string>")).alias("name", "spec"), F.try_parse_json("j").alias("v"))
    literal = F.regexp_extract_all("j", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*(?!")'), F.lit(1))
    odd = objects.select("path", "section", F.explode(literal).alias("name")).distinct().withColumn("odd", F.lit(True))
    entries = entries.join(odd, ["path", "section", "name"], "left").withColumn("ok", F.col("odd").isNull() & N.safe_name(F.col("name")).isNotNull() & F.col("spec").isNotNull())
    bad = rows.where(~F.startswith("j", F.lit("{"))).select(F.concat("path", F.lit(": invalid dependency section limits dependency analysis.")).alias("value"))
    worse = entries.where("not ok").select(F.concat("path", F.lit(": invalid dependency entry limits dependency analysis.")).alias("value"))
    return entries.where("ok").select("path", "section", "name", "spec"), bad.unionByName(worse).distinct()


def drift(sections: DataFrame, locked: DataFrame) -> DataFrame:
    """Full outer join of a manifest's sections with those of its lock entry (project, section, name, spec): whatever is missing on a side or differs."""
    a = sections.select("project", "path", "section", "name", "spec")
    b = locked.select("project", "section", "name", F.col("spec").alias("_locked"))
    paths = a.select("project", "path").distinct().withColumnRenamed("path", "_path")
    j = a.join(b, ["project", "section", "name"], "full_outer").where(~F.col("spec").eqNullSafe(F.col("_locked"))).join(paths, "project", "left")
    return j.select("project", F.coalesce("path", "_path").alias("path"), "section", "name")


def installed(entries: DataFrame) -> DataFrame:
    """The entry of each package name in each lock root: the shortest path, then the first by text."""
    rows = entries.where("package_name is not null")
    best = rows.groupBy("lock_root", "package_name").agg(F.min_by(F.struct("path", "link", "resolved_workspace_path", "git_pinned"), F.struct(F.length("path"), "path")).alias("e"))
    return best.select("lock_root", "package_name", "e.*")


def has_external_graph(sections: DataFrame, internal: DataFrame) -> DataFrame:
    """project for projects with an installed dependency that is neither internal nor local."""
    rows = sections.where(F.col("section").isin(*N.INSTALLED_SECTIONS)).join(internal.select("name"), "name", "left_anti")
    return rows.where(~N.source_class(F.col("spec")).isin(*N.LOCAL_SOURCES)).select("project").distinct()


def select_targets(projects: DataFrame, files: DataFrame, manifests: DataFrame, workspaces: DataFrame, affected: DataFrame | None = None):
    """(targets, covered, unsupported, not_applicable, limitations).

    targets: lock_root, authority, lock_ownership, lockfile, competing; covered: lock_root, project_id, root, manifest_path.
    Projects come with manager (see effective_manager) and owner_root (see governing_root).
    """
    regular = files.where("kind = 'file'").select("path")
    locks = regular.where(P.basename(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json")).select(P.dirname(F.col("path")).alias("lock_root"), P.basename(F.col("path")).alias("n"))
    at = locks.groupBy("lock_root").agg(F.bool_or(F.col("n") == "npm-shrinkwrap.json").alias("shrink"), F.bool_or(F.col("n") == "package-lock.json").alias("lock"))
    chosen = projects if affected is None else projects.join(affected.select(F.col("project_id").alias("id")), "id", "left_semi")
    node = F.array_contains(F.transform("ecosystems", F.lower), "node")
    kind = F.when(~node, F.coalesce(F.array_min("ecosystems"), F.lit("unknown"))).when(F.col("manager") != "npm", F.concat(F.lit("node:"), "manager"))
    chosen = chosen.withColumn("_kind", kind)
    unsupported = chosen.where("_kind is not null").select(F.col("id").alias("project_id"), "root", F.col("_kind").alias("ecosystem"))
    rest = chosen.where("_kind is null")
    free = N.dependency_free(F.col("dependency_names"))
    not_applicable = rest.where(free).select(F.col("id").alias("project_id"), "root")
    rest = rest.where(~free | F.col("dependency_names").isNull())
    own = at.select(F.col("lock_root").alias("root")).withColumn("_own", F.lit(True))
    manifest = F.coalesce(F.get(F.filter("manifest_paths", lambda m: m == P.at_root(F.col("root"), F.lit("package.json"))), F.lit(0)), F.array_min(F.filter("manifest_paths", lambda m: P.basename(m) == "package.json")))
    placed = rest.join(own, "root", "left").withColumn("lock_root", F.when(F.col("_own"), F.col("root")).otherwise(F.coalesce("owner_root", "root")))
    covered = placed.select("lock_root", F.col("id").alias("project_id"), "root", manifest.alias("manifest_path"))
    declared = manifests.where("status = 'valid'").select(F.col("path").alias("manifest_path"), N.declared_manager(F.get_json_object("data", "$.packageManager")).alias("_declared"))
    others = projects.where(node).select(F.col("root").alias("_above"))
    up = covered.select("root", F.explode(P.ancestors(F.col("root"))).alias("_above")).where("_above <> root").join(others, "_above", "left_semi").select("root").distinct().withColumn("_nested", F.lit(True))
    owners = workspaces.select(F.col("owner_project_id").alias("project_id")).distinct().withColumn("_owns", F.lit(True))
    one = covered.groupBy("lock_root").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("root", "project_id", "manifest_path")).alias("_one"))
    t = one.join(at, "lock_root", "left").select("lock_root", "_n", "_one.*", F.coalesce("shrink", F.lit(False)).alias("shrink"), F.coalesce("lock", F.lit(False)).alias("lock"))
    t = t.join(declared, "manifest_path", "left").join(up, "root", "left").join(owners, "project_id", "left").join(projects.select(F.col("id").alias("project_id"), "manager"), "project_id", "left")
    alone = (F.col("_n") == 1) & (F.col("_declared") == "npm") & (F.col("manager") == "npm") & F.col("_nested").isNull() & F.col("_owns").isNull()
    name = lambda n: P.at_root(F.col("lock_root"), F.lit(n))
    targets = t.select(
        "lock_root", F.when(F.col("shrink"), "shrinkwrap").when(F.col("lock"), "package-lock").otherwise("none").alias("authority"),
        F.when(F.col("shrink") | F.col("lock"), "governed").when(F.coalesce(alone, F.lit(False)), "explicit-standalone").otherwise("unresolved").alias("lock_ownership"),
        F.when(F.col("shrink"), name("npm-shrinkwrap.json")).when(F.col("lock"), name("package-lock.json")).alias("lockfile"),
        F.when(F.col("shrink") & F.col("lock"), F.array(name("package-lock.json"))).otherwise(F.array().cast("array<string>")).alias("competing"),
    )
    limits = targets.where("lock_ownership = 'unresolved'").select(F.concat("lock_root", F.lit(": npm lock ownership is unresolved; missing-lockfile analysis was withheld.")).alias("value"))
    odd = workspaces.where("not supported").join(chosen.select(F.col("id").alias("owner_project_id")), "owner_project_id", "left_semi").select(F.concat("source_path", F.lit(": unsupported workspace pattern limits dependency lock ownership.")).alias("value"))
    links = files.where("kind = 'symlink'").where(P.basename(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json")).select(F.concat("path", F.lit(": selected npm lockfile is not an inventoried regular file.")).alias("value"))
    return targets, covered, unsupported, not_applicable, limits.unionByName(odd).unionByName(links).distinct()


def matches(targets: DataFrame, covered: DataFrame, sections: DataFrame, entries: DataFrame, internal: DataFrame) -> DataFrame:
    """All rule matches: sections (path, section, name, spec), entries (lock_root, ...), internal (name, root)."""
    mine = covered.join(targets.select("lock_root", "authority", "lock_ownership", "lockfile"), "lock_root")
    here = mine.select("lock_root", "authority", "lock_ownership", F.col("project_id").alias("project"), "root", F.col("manifest_path").alias("path")).join(sections, "path")
    kind = N.source_class(F.col("spec"))
    have = installed(entries)
    out = [_match(here.where(kind.isin("insecure-http", "insecure-git")), "insecure-source", F.col("path"), F.col("name"), F.col("section"), kind)]
    pins = have.select("lock_root", F.col("package_name").alias("name"), "git_pinned")
    loose = here.where(kind == "git-mutable").join(pins, ["lock_root", "name"], "left").where("git_pinned is not true")
    out.append(_match(loose, "mutable-git-source", F.col("path"), F.col("name"), F.col("section"), F.lit("git-mutable")))
    graph = has_external_graph(here, internal)
    bare = mine.where("authority = 'none' and lock_ownership = 'explicit-standalone'").join(graph.withColumnRenamed("project", "project_id"), "project_id", "left_semi")
    out.append(_match(bare, "missing-lockfile", F.col("manifest_path")))
    governed = here.where("authority <> 'none'")
    at = P.relative(F.col("lock_root"), F.col("root"))
    specs = entries.select("lock_root", F.col("path").alias("_at"), F.explode("sections").alias("section", "_s")).select("lock_root", "_at", "section", F.explode("_s").alias("name", "spec"))
    members = mine.where("authority <> 'none'").select("lock_root", F.col("project_id").alias("project"), at.alias("_at"), F.col("manifest_path").alias("_path"))
    locked = members.join(specs, ["lock_root", "_at"]).select("project", "section", "name", "spec")
    drifted = drift(governed, locked).join(members.select("project", "_path"), "project", "left").withColumn("path", F.coalesce("path", "_path"))
    out.append(_match(drifted, "manifest-lock-drift", F.col("path"), F.col("name"), F.col("section")))
    inside = governed.where(F.col("section").isin(*N.INSTALLED_SECTIONS)).join(internal.select("name", F.col("root").alias("_member")), "name")
    links = have.select("lock_root", F.col("package_name").alias("name"), "link", "resolved_workspace_path")
    wrong = inside.join(links, ["lock_root", "name"]).where(~F.col("link") | ~F.col("resolved_workspace_path").eqNullSafe(P.relative(F.col("lock_root"), F.col("_member"))))
    out.append(_match(wrong, "workspace-registry-resolution", F.col("path"), F.col("name"), F.col("section")))
    in_lock = entries.join(targets.select("lock_root", "lockfile"), "lock_root")
    out.append(_match(in_lock.where(F.col("source_class").isin("insecure-http", "insecure-git")), "insecure-source", F.col("lockfile"), F.col("package_name"), None, F.col("source_class")))
    out.append(_match(in_lock.where(F.col("integrity").isin("missing", "invalid")), "missing-integrity", F.col("lockfile"), F.col("package_name"), None, F.col("source_class")))
    out.append(_match(targets.select(F.explode("competing").alias("path")), "competing-npm-lockfiles", F.col("path")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def match_order() -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in ("path", "family", "section", "package_name", "source_class")]


def dependency_findings(found: DataFrame) -> DataFrame:
    title = F.lit(None).cast("string")
    for family, (_, text) in RULES.items():
        title = F.when(F.col("family") == family, text).otherwise(title)
    blank = lambda c: F.coalesce(c, F.lit(""))
    detail = F.concat_ws(" ", F.lit("Rule"), "family", F.lit("matched"), "package_name", "section", "source_class")
    return findings(
        found, rule=F.concat(F.lit(f"{DOCTOR}/"), "family"), doctor=F.lit(DOCTOR), severity=F.col("severity"), confidence=F.col("confidence"), category="security", title=title,
        message=F.lit("Dependency metadata matched an offline supply-chain rule. Source values were withheld."), evidence=F.array(evidence("file", detail, F.col("path"))),
        identity=F.concat_ws(":", blank("package_name"), blank("section"), blank("source_class")), path=F.col("path"),
        impact=F.lit("Builds may install code that was not reviewed or can change unseen."), remediation=F.lit("Correct the dependency metadata with the package manager and audit again."),
    ).distinct()
