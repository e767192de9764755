"""Projects, workspaces, structural rules and planned checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import packages as N
from auditlake.functions import paths as P
from auditlake.functions.core import evidence, findings
from auditlake.operators.lineage import repo_key
from auditlake.operators.ownership import python_owned

# File names that mark an ecosystem, and dependencies that mark a framework.
SIGNALS = (
    (r"^(?:pyproject\.toml|setup\.cfg|setup\.py|requirements(?:[-.].*)?\.txt)\z", "python"), (r"^go\.(?:mod|work)\z", "go"), (r"^Cargo\.toml\z", "rust"),
    (r"^(?:pom\.xml|(?:build|settings)\.gradle(?:\.kts)?)\z", "java"),
)
FRAMEWORKS = {"@nestjs/core": "nestjs", "next": "nextjs", "react": "react", "vite": "vite"}


def _names(section: str):
    return F.coalesce(F.map_keys(F.from_json(F.get_json_object("data", f"$.{section}"), "map<string,string>")), F.array().cast("array<string>"))


def detect(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """The projects that manifests and file names show, one for each directory."""
    none, k = F.array().cast("array<string>"), repo_key(files)
    ok = F.col("status") == "valid"
    direct = F.array_union(_names("dependencies"), _names("devDependencies"))
    node = manifests.select(
        *k, P.dirname(F.col("path")).alias("root"), F.array(F.lit("node")).alias("ecosystems"),
        F.when(ok & F.array_contains(direct, "typescript"), F.array(F.lit("javascript"), F.lit("typescript"))).otherwise(F.array(F.lit("javascript"))).alias("languages"),
        F.when(ok, F.array_compact(F.array(*[F.when(F.array_contains(direct, d), f) for d, f in FRAMEWORKS.items()]))).otherwise(none).alias("frameworks"), F.array("path").alias("manifest_paths"),
        F.when(ok, N.declared_manager(F.get_json_object("data", "$.packageManager"))).alias("declared"), F.when(ok, F.nullif(F.trim(F.get_json_object("data", "$.name")), F.lit(""))).alias("package_name"),
        F.when(ok, F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.array(*map(_names, N.SECTIONS))), F.trim), lambda n: n != "")))).alias("dependency_names"),
    )
    regular = files.where("kind = 'file'").select(*k, "path", P.basename(F.col("path")).alias("n"))
    lang = F.lit(None).cast("string")
    for pattern, name in SIGNALS:
        lang = F.when(F.rlike("n", F.lit(pattern)), name).otherwise(lang)
    text = F.lit(None).cast("string")
    extra = {"frameworks": none, "declared": text, "package_name": text, "dependency_names": F.lit(None).cast("array<string>")}
    marked = regular.withColumn("l", lang).where("l is not null").select(*k, P.dirname(F.col("path")).alias("root"), F.array("l").alias("ecosystems"), F.array("l").alias("languages"), F.array("path").alias("manifest_paths")).withColumns(extra)
    typed = regular.where(F.rlike("n", F.lit(r"^tsconfig(?:\..+)?\.json\z"))).select(*k, P.dirname(F.col("path")).alias("root"), F.array(F.lit("node")).alias("ecosystems"), F.array(F.lit("javascript"), F.lit("typescript")).alias("languages"), none.alias("manifest_paths")).withColumns(extra)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    base = node.unionByName(marked).unionByName(typed).groupBy(*k, "root").agg(*map(merged, ("ecosystems", "languages", "frameworks", "manifest_paths")), *[F.max(c).alias(c) for c in ("declared", "package_name", "dependency_names")])
    manager = F.lit(None).cast("string")
    for lock, name in N.LOCKFILES.items():
        manager = F.when(F.col("n") == lock, name).otherwise(manager)
    locks = regular.withColumn("m", manager).where("m is not null").groupBy(*k, P.dirname(F.col("path")).alias("root")).agg(F.when(F.count_distinct("m") == 1, F.min("m")).alias("locked"))
    supported = F.when(F.arrays_overlap("ecosystems", F.array(F.lit("node"), F.lit("python"))), "supported").otherwise("detected-only")
    return base.join(locks, [*k, "root"], "left").select(
        *k, P.project_id(F.col("root")).alias("id"), "root", "ecosystems", "languages", "frameworks", F.coalesce("declared", "locked").alias("package_manager"), "package_name", "dependency_names", "manifest_paths", supported.alias("execution_support")
    )


def workspaces(manifests: DataFrame, projects: DataFrame) -> DataFrame:
    """Workspace patterns with the projects they match: an exact root, or the direct children of a directory."""
    repo = repo_key(manifests)
    listed = F.coalesce(F.from_json(F.get_json_object("data", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("data", "$.workspaces.packages"), "array<string>"))
    rows = manifests.where("status = 'valid'").select(*repo, P.dirname(F.col("path")).alias("root"), F.col("path").alias("source_path"), F.explode(listed).alias("raw"))
    pattern = P.normalized(F.replace("raw", F.lit("\\"), F.lit("/")))
    star = F.locate("*", F.col("pattern"))
    rows = rows.withColumn("pattern", pattern).withColumn("supported", (star == 0) | (F.endswith("pattern", F.lit("/*")) & (star == F.length("pattern"))))
    whole = P.at_root(F.col("root"), F.col("pattern"))
    rows = rows.withColumns({"exact": F.when(F.col("supported") & (star == 0), whole), "parent": F.when(F.col("supported") & (star > 0), F.regexp_replace(whole, r"/\*\z", ""))})
    key = [*repo, "root", "source_path", "pattern"]
    a = rows.join(projects.select(*repo, F.col("root").alias("hit"), F.col("root").alias("exact")), [*repo, "exact"]).select(*key, "hit")
    kids = projects.select(*repo, F.col("root").alias("hit"), P.dirname(F.col("root")).alias("parent"))
    b = rows.join(kids, [*repo, "parent"]).where("hit <> root").select(*key, "hit")
    hits = a.unionByName(b).groupBy(*key).agg(F.array_sort(F.collect_set("hit")).alias("matched_project_roots"))
    out = rows.join(hits, key, "left")
    return out.select(*repo, P.project_id(F.col("root")).alias("owner_project_id"), "source_path", "pattern", "supported", F.coalesce("matched_project_roots", F.array().cast("array<string>")).alias("matched_project_roots"))


def conflicting_lockfiles(projects: DataFrame, files: DataFrame) -> DataFrame:
    """root, managers, lockfiles of project roots that hold lockfiles of two managers or more."""
    manager, k = F.lit(None).cast("string"), repo_key(files)
    name = P.basename(F.col("path"))
    for lock, m in N.LOCKFILES.items():
        manager = F.when(name == lock, m).otherwise(manager)
    rows = files.where("kind = 'file'").select(*k, P.dirname(F.col("path")).alias("root"), "path", manager.alias("m")).where("m is not null").join(projects.select(*k, "root"), [*k, "root"], "left_semi")
    return rows.groupBy(*k, "root").agg(F.array_sort(F.collect_set("m")).alias("managers"), F.array_sort(F.collect_set("path")).alias("lockfiles")).where(F.size("managers") >= 2)


def structural_findings(projects: DataFrame, files: DataFrame, manifests: DataFrame, spaces: DataFrame) -> DataFrame:
    """The four rules on the shape of the repository."""
    doctor = F.lit("project")
    base = {"doctor": doctor, "confidence": F.lit("high"), "category": "repository"}
    c = conflicting_lockfiles(projects, files)
    r1 = findings(c, rule=F.lit("repository/conflicting-lockfiles"), severity=F.lit("medium"), title=F.lit("Lockfiles of several package managers in one project"),
                  message=F.concat(F.lit("Project "), "root", F.lit(" has lockfiles of "), F.array_join("managers", " and "), F.lit(".")),
                  evidence=F.transform("lockfiles", lambda p: evidence("file", F.lit("A package-manager lockfile."), p)), identity=F.concat("root", F.lit(":"), F.array_join("managers", ",")), path=F.get("lockfiles", F.lit(0)), **base)
    bad = manifests.where("status = 'invalid'")
    r2 = findings(bad, rule=F.lit("repository/invalid-manifest"), severity=F.lit("high"), title=F.lit("A package manifest can't be read"), message=F.concat("path", F.lit(" is no valid package manifest.")),
                  evidence=F.array(evidence("manifest", F.coalesce("error", F.lit("invalid")), F.col("path"))), identity=F.lit("invalid-package-json"), path=F.col("path"), **base)
    lost = spaces.where(F.col("supported") & (F.size("matched_project_roots") == 0))
    r3 = findings(lost, rule=F.lit("repository/missing-workspace"), severity=F.lit("medium"), title=F.lit("A workspace pattern matches no project"), message=F.concat(F.lit("Workspace pattern "), "pattern", F.lit(" matches nothing.")),
                  evidence=F.array(evidence("manifest", F.concat(F.lit("Pattern "), "pattern"), F.col("source_path"))), identity=F.concat("owner_project_id", F.lit(":"), "pattern"), path=F.col("source_path"), **base)
    k = repo_key(files)
    tests = files.groupBy(*k).agg(F.coalesce(F.bool_or((F.col("kind") == "file") & P.looks_like_test(F.col("path"))), F.lit(False)).alias("t"), F.count(F.lit(1)).alias("n"))
    some = projects.groupBy(*k).agg((F.count(F.lit(1)) > 0).alias("p"))
    r4 = findings((tests.join(some, k) if k else tests.join(some)).where("p and not t"), rule=F.lit("repository/no-visible-tests"), severity=F.lit("info"), title=F.lit("No tests in sight"), message=F.lit("No file has a common test name or place."),
                  evidence=F.array(evidence("observation", F.concat(F.lit("Inspected "), F.col("n").cast("string"), F.lit(" records.")))), identity=F.lit("repository-no-visible-tests"), **(base | {"confidence": F.lit("medium"), "category": "testing"}))
    return r1.unionByName(r2).unionByName(r3).unionByName(r4)


def javascript_checks(projects: DataFrame, manifests: DataFrame, timeout_ms: int) -> DataFrame:
    """typecheck (or check), test, lint and build, where the manifest has them and a package manager is known."""
    valid = manifests.where("status = 'valid'").select(F.col("path").alias("m"), F.from_json(F.get_json_object("data", "$.scripts"), "map<string,string>").alias("scripts"))
    rows = projects.where(F.array_contains("ecosystems", "node") & F.col("package_manager").isNotNull()).select("id", "root", "package_manager", F.explode("manifest_paths").alias("m")).join(valid, "m")
    rows = rows.groupBy("id", "root", "package_manager").agg(F.min_by("scripts", "m").alias("scripts"))
    has = lambda n: F.map_contains_key("scripts", n)
    chosen = F.array_compact(F.array(F.when(has("typecheck"), "typecheck").when(has("check"), "check"), *[F.when(has(n), n) for n in ("test", "lint", "build")]))
    each = rows.where("scripts is not null").select("id", "root", "package_manager", F.posexplode(chosen).alias("position", "script"))
    return each.select(F.concat("id", F.lit(":javascript:"), "script").alias("plan_id"), F.col("id").alias("project_id"), F.concat(F.lit("JavaScript "), "script").alias("label"), F.col("package_manager").alias("executable"),
                       F.array(F.lit("run"), "script").alias("args"), F.col("root").alias("cwd"), F.lit(timeout_ms).alias("timeout_ms"), "position")


def python_checks(projects: DataFrame, files: DataFrame, timeout_ms: int) -> DataFrame:
    """pytest, ruff and mypy by evidence, through uv, else poetry, else directly."""
    held = python_owned(files.where("kind = 'file'"), projects).join(projects.select(F.col("id").alias("project_id"), "root"), "project_id")
    name = P.basename(F.col("path"))
    at = lambda n: F.bool_or(F.col("path") == P.at_root(F.col("root"), F.lit(n)))
    flags = held.groupBy("project_id", "root").agg(
        F.bool_or(P.is_pytest_evidence(F.col("path"))).alias("pytest"), F.bool_or(name.isin("ruff.toml", ".ruff.toml")).alias("ruff"), F.bool_or(name.isin("mypy.ini", ".mypy.ini")).alias("mypy"), at("uv.lock").alias("uv"), at("poetry.lock").alias("poetry")
    )
    tools = F.array_compact(F.array(*[F.when(F.col(t), t) for t in ("pytest", "ruff", "mypy")]))
    runner = F.when(F.col("uv"), "uv").when(F.col("poetry"), "poetry")
    each = flags.select("project_id", "root", runner.alias("runner"), F.posexplode(tools).alias("position", "tool"))
    own = F.when(F.col("tool") == "pytest", F.array(F.lit("pytest"))).when(F.col("tool") == "ruff", F.array(F.lit("ruff"), F.lit("check"), F.lit("."))).otherwise(F.array(F.lit("mypy"), F.lit(".")))
    args = F.when(F.col("runner").isNotNull(), F.concat(F.array(F.lit("run")), own)).when(F.col("tool") == "pytest", F.array(F.lit("-m"), F.lit("pytest"))).otherwise(F.slice(own, 2, 2))
    exe = F.coalesce("runner", F.when(F.col("tool") == "pytest", "python").otherwise(F.col("tool")))
    return each.select(F.concat("project_id", F.lit(":python:"), "tool").alias("plan_id"), "project_id", F.concat(F.lit("Python "), "tool").alias("label"), exe.alias("executable"), args.alias("args"), F.col("root").alias("cwd"), F.lit(timeout_ms).alias("timeout_ms"), "position")


def planned_checks(projects: DataFrame, files: DataFrame, manifests: DataFrame, timeout_ms: int = 120_000, affected: DataFrame | None = None) -> DataFrame:
    plans = javascript_checks(projects, manifests, timeout_ms).unionByName(python_checks(projects, files, timeout_ms))
    return plans if affected is None else plans.join(affected.select("project_id"), "project_id", "left_semi").select(plans.columns)


def displayed(executable, args):
    """A command as shown: words with anything but plain signs are quoted."""
    return F.array_join(F.transform(F.concat(F.array(executable), args), lambda a: F.when(F.rlike(a, F.lit(r"^[A-Za-z0-9_./:=@+-]+\z")), a).otherwise(F.to_json(F.array(a)).substr(F.lit(2), F.length(F.to_json(F.array(a))) - 2))), " ")


def check_findings(runs: DataFrame) -> DataFrame:
    """check runs (plan_id, label, status, exit_code, timed_out, ...) that failed or ran out of time."""
    base = {"doctor": F.lit("checks"), "confidence": F.lit("high"), "category": "validation", "identity": F.col("plan_id")}
    shown = F.array(evidence("command", F.coalesce("output", F.lit(""))))
    failed = findings(runs.where("not timed_out and exit_code <> 0"), rule=F.lit("checks/command-failed"), severity=F.lit("high"), title=F.concat("label", F.lit(" failed")), message=F.concat("label", F.lit(" ended with exit code "), F.col("exit_code").cast("string")), evidence=shown, **base)
    late = findings(runs.where("timed_out"), rule=F.lit("checks/command-timeout"), severity=F.lit("medium"), title=F.concat("label", F.lit(" ran out of time")), message=F.concat("label", F.lit(" was stopped at its time limit.")), evidence=shown, **base)
    return failed.unionByName(late)
