"""The audit engine: one snapshot of shared frames, modules that turn it into findings and coverage, one normalised report."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.functions import paths as P
from auditlake.functions.redaction import connection_string, database_error
from auditlake.operators import closures, coverage, dependencies, findings, integrity, ownership, projects, rls, secrets, sqlrls
from auditlake.operators.lineage import cut
from auditlake.plans.scope import changed_scope
from auditlake.sources import catalog as catalogs
from auditlake.sources import commands, configs, files, git, locks, migrations

#: Limitations that a coverage row names; the number of the others stands behind them. Bytes of files whose contents are read.
NOTES, CONTENT_BYTES = 10_000, 20_000_000
CAPABILITIES = {"run_checks": "checks:execute", "network": "network:access"}


@dataclass(frozen=True)
class Request:
    root: str
    exclude: tuple[str, ...] = ()
    changed: bool = False
    base: str | None = None
    security: bool = False
    database: bool = False
    run_checks: bool = False
    network: bool = False
    timeout_ms: int = 120_000
    schemas: tuple[str, ...] = ("public",)
    database_timeout_ms: int = 10_000

    def allowed(self) -> frozenset[str]:
        return frozenset({"repository:read"} | {c for f, c in CAPABILITIES.items() if getattr(self, f)})


@dataclass
class Snapshot:
    """All that modules read; frames are lazy, shared ones are cached once."""

    spark: SparkSession
    request: Request
    frames: dict[str, DataFrame | None] = field(default_factory=dict)
    base: dict | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def get(self, name: str) -> DataFrame | None:
        return self.frames.get(name)


@dataclass
class Outcome:
    findings: DataFrame | None = None
    coverage: DataFrame | None = None
    error: str | None = None


class Module(Protocol):
    """A plug-in: an id, the capabilities it needs, whether it applies, and what it finds."""

    id: str
    capabilities: frozenset[str]

    def supports(self, snapshot: Snapshot) -> bool: ...

    def run(self, snapshot: Snapshot) -> Outcome: ...


@dataclass
class Function:
    """A module made of a function."""

    id: str
    make: Callable[[Snapshot], Outcome]
    capabilities: frozenset[str] = frozenset({"repository:read"})
    applies: Callable[[Snapshot], bool] = lambda s: True

    def supports(self, snapshot: Snapshot) -> bool:
        return self.applies(snapshot)

    def run(self, snapshot: Snapshot) -> Outcome:
        return self.make(snapshot)


def covered(spark: SparkSession, module: str, scope: str, files_: int, limitations: DataFrame | None, statements: tuple[int, int] | None = None) -> DataFrame:
    """A coverage row: partial with limitations, not-applicable for nothing to examine, else completed."""
    notes = []
    if limitations is not None:
        rows = limitations.select("value").distinct()
        notes = [r[0] for r in rows.orderBy("value").limit(NOTES + 1).collect()]
        if len(notes) > NOTES:
            notes = [*notes[:NOTES], f"{rows.count() - NOTES} additional limitations omitted after deterministic sampling."]
    status = "partial" if notes else "not-applicable" if not files_ else "completed"
    return spark.createDataFrame([(module, status, scope, files_, *(statements or (None, None)), notes)], S.COVERAGE)


def project_module(s: Snapshot) -> Outcome:
    return Outcome(projects.structural_findings(s["projects"], s["files"], s["manifests"], s["workspaces"]), covered(s.spark, "project", "repository", s["files"].count(), s["content_notes"]))


def graph_module(s: Snapshot) -> Outcome:
    return Outcome(None, covered(s.spark, "repository/source-graph", "repository", s["nodes"].count(), s["graph_notes"]))


def integrity_module(s: Snapshot) -> Outcome:
    chosen = None
    if s.request.changed:
        chosen = s["impact_seeds"].select(F.col("node").alias("path")).unionByName(s["impact"].select("path"))
    return Outcome(integrity.integrity_findings(s["edges"], chosen), covered(s.spark, integrity.DOCTOR, "repository", s["nodes"].count(), s["graph_notes"]))


def checks_module(s: Snapshot) -> Outcome:
    """Runs the planned checks, unless their runs are given. One that ran out of time fails the module."""
    runs = s.get("check_runs")
    if runs is None:
        runs = cut(commands.run_plans(s.spark, s.request.root, s["plans"]))
        s.frames["check_runs"] = runs
    late = [r[0] for r in runs.where("timed_out").select("label").orderBy("label").collect()]
    skipped = runs.where("status = 'skipped'").select(F.concat("label", F.lit(" could not be started.")).alias("value"))
    return Outcome(projects.check_findings(runs), covered(s.spark, "checks", "repository", s["plans"].count(), skipped), f"{', '.join(late)} ran out of time." if late else None)


def secrets_module(s: Snapshot) -> Outcome:
    if s.request.changed:
        chosen, notes = secrets.changed_files(s["files"], s["changes"])
    else:
        chosen, notes = secrets.shareable(s["files"], s.get("shareable")), s.spark.createDataFrame([], "value string")
    found, more = secrets.audit(chosen, s["contents"], s["contents"].where(P.is_certificate_candidate(F.col("path"))))
    return Outcome(found, covered(s.spark, secrets.DOCTOR, "changed" if s.request.changed else "repository", chosen.count(), notes.unionByName(more)))


def dependencies_module(s: Snapshot) -> Outcome:
    # Each of these feeds several rules, so it is made once.
    managed = cut(ownership.governing_root(ownership.effective_manager(s["projects"], s["files"]), s["workspaces"]))
    targets, members, odd, free, notes = dependencies.select_targets(managed, s["files"], s["manifests"], s["workspaces"], s.get("affected"))
    targets, members = cut(targets), cut(members)
    texts = targets.where("lockfile is not null").join(s["contents"], F.col("lockfile") == F.col("path")).select("lock_root", "content")
    states, entries = locks.parse(cut(texts))
    sections, bad = dependencies.manifest_sections(s["manifests"])
    entries, sections = cut(entries), cut(sections)
    internal = s["projects"].where("package_name is not null").select(F.col("package_name").alias("name"), "root")
    found = findings.capped(dependencies.matches(targets, members, sections, entries, internal), ["path"], dependencies.match_order(), dependencies.PER_ROOT, dependencies.TOTAL)
    said = states.join(targets, "lock_root").select(F.explode("limitations").alias("l"), "lockfile").select(F.concat("lockfile", F.lit(": "), "l").alias("value"))
    unsupported = odd.select(F.concat("root", F.lit(": "), "ecosystem", F.lit(" dependency metadata is not supported.")).alias("value"))
    return Outcome(dependencies.dependency_findings(found), covered(s.spark, dependencies.DOCTOR, "repository", targets.count(), notes.unionByName(bad).unionByName(said).unionByName(unsupported)))


def sql_module(s: Snapshot) -> Outcome:
    streams = migrations.streams(s["files"], s["projects"])
    notes = None
    if s.request.changed:
        keep = sqlrls.affected_streams(streams, s["changes"])
        left_out = cut(sqlrls.unselected_streams(streams, s["changes"]))
        gone = sqlrls.missing_history(streams, s["changes"])
        streams = streams.join(keep, "stream_id", "left_semi")
        notes = gone.select(F.concat("stream_id", F.lit(": historical migration content is unavailable.")).alias("value"))
    ops, troubles = sqlrls.operations(streams, s["contents"])
    state = sqlrls.stream_coverage(ops, troubles)
    rows = state.select(F.lit(sqlrls.DOCTOR).alias("module_id"), "status", F.col("stream_id").alias("scope"), F.lit(None).cast("bigint").alias("files_examined"), "statements_examined", "statements_recognized", "limitations")
    if notes is not None:
        rows = rows.unionByName(notes.select(F.lit(sqlrls.DOCTOR).alias("module_id"), F.lit("partial").alias("status"), F.lit("history").alias("scope"), *[F.lit(None).cast("bigint").alias(c) for c in ("files_examined", "statements_examined", "statements_recognized")], F.array("value").alias("limitations")))
    if s.request.changed:
        said = F.array(F.lit("No changed migration is part of this stream."))
        rows = rows.unionByName(left_out.select(F.lit(sqlrls.DOCTOR).alias("module_id"), F.lit("not-selected").alias("status"), F.col("stream_id").alias("scope"), *[F.lit(None).cast("bigint").alias(c) for c in ("files_examined", "statements_examined", "statements_recognized")], said.alias("limitations")))
    empty = covered(s.spark, sqlrls.DOCTOR, "repository", 0, None).join(rows.agg((F.count(F.lit(1)) == 0).alias("e"))).where("e").drop("e")
    return Outcome(sqlrls.static_findings(cut(sqlrls.replay(ops))), rows.unionByName(empty))


def catalog_module(load: Callable[[Snapshot], Mapping[str, DataFrame]]) -> Function:
    """The live catalog, loaded only where network access is allowed; its errors are reported without credentials."""

    def run(s: Snapshot) -> Outcome:
        found = rls.narrowed(dict(load(s)))
        return Outcome(rls.catalog_findings(found, s.request.schemas), covered(s.spark, rls.DOCTOR, ",".join(s.request.schemas), found["tables"].count(), None))

    return Function(rls.DOCTOR, run, frozenset({"repository:read", "network:access"}))


def catalog_loader(connect: Callable[[str], object], value: str | None, env: Mapping[str, str]) -> Callable[[Snapshot], Mapping[str, DataFrame]]:
    def load(s: Snapshot):
        at = connection_string(value, env)
        if at is None:
            raise RuntimeError("no database connection is configured")
        try:
            return catalogs.frames(s.spark, catalogs.fetch(lambda: connect(at), list(s.request.schemas), s.request.database_timeout_ms))
        except Exception as e:
            raise RuntimeError(database_error(str(e), at)) from None

    return load


def modules_for(request: Request, load: Callable[[Snapshot], Mapping[str, DataFrame]] | None = None) -> list[Module]:
    """In their fixed order."""
    out: list[Module] = [
        Function("project", project_module), Function("repository/source-graph", graph_module), Function(integrity.DOCTOR, integrity_module),
        Function("checks", checks_module, frozenset({"repository:read", "checks:execute"})),
    ]
    if request.security:
        out += [Function(secrets.DOCTOR, secrets_module), Function(dependencies.DOCTOR, dependencies_module)]
    if request.database:
        out.append(Function(sqlrls.DOCTOR, sql_module))
        out.append(catalog_module(load or (lambda s: (_ for _ in ()).throw(RuntimeError("no database connection is configured")))))
    return out


def take_snapshot(spark: SparkSession, request: Request, runner: git.Runner = git.run, extra: dict[str, DataFrame] | None = None) -> Snapshot:
    """Inventory, contents, manifests, projects, source graph and, for a changed scope, changes, impact and affected projects."""
    s = Snapshot(spark, request, dict(extra or {}))
    patterns = [*request.exclude, *files.config(request.root)["exclude"]]
    listed = files.walk(request.root, patterns)
    s.frames["files"] = spark.createDataFrame(listed, S.FILES).cache()
    text_paths = [p for p, kind, _ in listed if kind == "file"]
    s.frames["contents"] = files.contents(spark, request.root, text_paths, CONTENT_BYTES).cache()
    s.frames["content_notes"] = s["files"].where(F.col("size") > CONTENT_BYTES).select(F.concat("path", F.lit(f": content exceeds the {CONTENT_BYTES}-byte limit and was not read.")).alias("value"))
    s.frames["manifests"] = files.manifests(s["files"], s["contents"]).cache()
    s.frames["projects"] = projects.detect(s["files"], s["manifests"]).cache()
    s.frames["workspaces"] = projects.workspaces(s["manifests"], s["projects"]).cache()
    aliases, alias_notes = configs.alias_configs(s["files"], s["contents"])
    prefixes, big = files.ignore_prefixes(s["files"], s["contents"])
    nodes, edges, boundaries, notes = integrity.build_graph(s["files"], s["contents"], s["projects"], s["manifests"], aliases, prefixes)
    s.frames |= {"nodes": nodes.cache(), "edges": edges.cache(), "boundaries": boundaries, "graph_notes": notes.unionByName(alias_notes).unionByName(big).unionByName(s["content_notes"]).distinct().cache()}
    if request.changed:
        s.base, changes = git.changes(spark, request.root, request.base, runner)
        s.frames["changes"] = changes.cache()
        s.frames["impact_seeds"] = closures.impact_seeds(s["changes"], P.is_source).cache()
        s.frames["impact"] = closures.source_impact(s["impact_seeds"], s["edges"], s["nodes"]).cache()
        s.frames["reasons"], s.frames["scope_notes"] = changed_scope(s["changes"], s["projects"], s["impact"])
        s.frames["affected"] = s["reasons"].select("project_id").distinct().cache()
    elif request.security:
        s.frames["shareable"], missing = git.shareable(spark, request.root, runner)
    s.frames["plans"] = projects.planned_checks(s["projects"], s["files"], s["manifests"], request.timeout_ms, s.get("affected")).cache()
    return s


def run_modules(snapshot: Snapshot, modules: list[Module], allowed: frozenset[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, coverage, runs). A module that lacks a capability or support is skipped, one that fails is recorded, the rest go on."""
    spark = snapshot.spark
    found, cover, runs = [spark.createDataFrame([], S.FINDINGS)], [spark.createDataFrame([], S.COVERAGE)], []
    for m in modules:
        began = time.monotonic()
        denied = sorted(m.capabilities - allowed)
        if denied:
            runs.append((m.id, "skipped", 0, 0, None, f"Module requires denied capabilities: {', '.join(denied)}."))
            continue
        if not m.supports(snapshot):
            runs.append((m.id, "skipped", 0, 0, None, "Module does not support this repository."))
            continue
        try:
            out = m.run(snapshot)
            # An action here, so that what fails does so within its module.
            f = None if out.findings is None else cut(out.findings.distinct())
            c = None if out.coverage is None else cut(out.coverage)
        except Exception as e:  # noqa: BLE001
            runs.append((m.id, "failed", int(1000 * (time.monotonic() - began)), 0, str(e).splitlines()[0][:500], None))
            continue
        found += [f] if f is not None else []
        cover += [c] if c is not None else []
        runs.append((m.id, "failed" if out.error else "completed", int(1000 * (time.monotonic() - began)), 0 if f is None else f.count(), out.error, None))
    return findings.union(*found), findings.union(*cover), spark.createDataFrame(runs, S.RUNS)


@dataclass
class Result:
    snapshot: Snapshot
    findings: DataFrame
    coverage: DataFrame
    runs: DataFrame
    domains: DataFrame
    comparison: DataFrame | None = None

    def with_baseline(self, baseline: DataFrame) -> Result:
        self.comparison = findings.compared(self.findings, baseline, self.snapshot.request.changed)
        return self

    def exit_code(self, threshold: str) -> int:
        return findings.exit_code(self.findings, self.runs, threshold, self.comparison)


def scan(spark: SparkSession, request: Request, *, runner: git.Runner = git.run, modules: list[Module] | None = None, load=None, extra: dict[str, DataFrame] | None = None) -> Result:
    """A whole scan. extra: further frames, such as check_runs."""
    if request.base is not None and not request.changed:
        raise ValueError("a base reference needs a changed scope")
    s = take_snapshot(spark, request, runner, extra)
    found, cover, runs = run_modules(s, modules if modules is not None else modules_for(request, load), request.allowed())
    rolled = coverage.module_coverage(runs, cover)
    shown = coverage.evidence(s["projects"], s["files"])
    domains = coverage.domain_coverage(spark, rolled, shown, s["plans"], request.database)
    if request.changed:
        domains = coverage.in_changed_scope(domains, shown, s["changes"], s["affected"])
    return Result(s, findings.ordered(found), cover, runs, domains)


def audit(spark: SparkSession, request: Request, **options) -> Result:
    """A scan with the security and database modules."""
    from dataclasses import replace

    return scan(spark, replace(request, security=True, database=True), **options)
