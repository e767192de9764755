"""Row-level security of a live catalog: role closures, exposure and rules R20 to R31."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import guidance as G
from auditlake.functions import rls as R
from auditlake.functions.core import SEVERITIES, evidence, findings, json_list, severity_rank
from auditlake.operators.closures import component, reachable
from auditlake.operators.lineage import cut as cut_lineage

DOCTOR = "database/rls"
MODES = ("direct", "inherited", "set-role")


class RoleGraph:
    """Closures of the role memberships, computed once. contexts: app_role, selected, effective (what a session can act as)."""

    def __init__(self, catalog: dict[str, DataFrame]):
        c, self.roles, members = catalog, catalog["roles"], catalog["memberships"]
        names = [F.col(n).alias("name") for n in ("grantee", "role", "member", "name", "owner")]
        grantee, role, member, name, owner = names
        parts = [c["relation_privileges"].select(grantee), c["default_privileges"].select(grantee), members.select(role), members.select(member), self.roles.select(name), c["tables"].select(owner)]
        if c.get("schema_privileges") is not None:
            parts.append(c["schema_privileges"].select(grantee))
        spark = self.roles.sparkSession
        known = spark.createDataFrame([("anon",), ("anonymous",), ("authenticated",)], "name string")
        for p in parts:
            known = known.unionByName(p)
        self.app = known.where((F.col("name") != "PUBLIC") & R.is_application_role(F.col("name"))).distinct()
        edges = lambda d: d.select(F.col("member").alias("source"), F.col("role").alias("target"))
        barred = self.roles.where("inherits = false").select(F.col("name").alias("member"))
        # By SET ROLE first, then by inheritance from each role that can be selected.
        self.selected = reachable(self.app.select(F.col("name").alias("start")), edges(members.where("set_option"))).select(F.col("start").alias("app_role"), F.col("node").alias("selected"))
        starts = self.selected.select(F.col("selected").alias("start")).distinct()
        inherited = reachable(starts, edges(members.where("inherit_option").join(barred, "member", "left_anti"))).select(F.col("start").alias("selected"), F.col("node").alias("effective"))
        self.contexts = self.selected.join(inherited, "selected").select("app_role", "selected", "effective")

    def access(self, usage: DataFrame | None = None) -> DataFrame:
        """target, mode, app_role, schema: the best access to each role, in each schema where usage (schema, app_role, selected) is given."""
        rows = self.contexts if usage is None else self.contexts.join(usage, ["app_role", "selected"])
        mode = F.when(F.col("app_role") != F.col("selected"), 2).when(F.col("app_role") == F.col("effective"), 0).otherwise(1)
        keys = ["effective"] if usage is None else ["effective", "schema"]
        best = rows.withColumn("mode", mode).groupBy(*keys).agg(F.min(F.struct("mode", "app_role")).alias("b"))
        return best.select(F.col("effective").alias("target"), *keys[1:], "b.mode", "b.app_role")

    def bypass(self) -> DataFrame:
        """target, mode, app_role: direct or by SET ROLE alone; attributes of roles are never inherited."""
        mode = F.when(F.col("app_role") == F.col("selected"), 0).otherwise(2)
        best = self.selected.withColumn("mode", mode).groupBy("selected").agg(F.min(F.struct("mode", "app_role")).alias("b"))
        return best.select(F.col("selected").alias("target"), "b.mode", "b.app_role")


def phrase(mode: Column, app: Column, target: Column) -> Column:
    """Fixed wording: it is part of the fingerprint."""
    who = F.concat(F.lit("Application role "), app)
    return F.when(mode == 0, who).when(mode == 1, F.concat(who, F.lit(" reaches "), target, F.lit(" through inherited membership"))).otherwise(F.concat(who, F.lit(" reaches "), target, F.lit(" through SET ROLE")))


def schema_usage(graph: RoleGraph, schemas: DataFrame, privileges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(schema: those in which every context holds USAGE; schema, app_role, selected: the contexts that hold it in any other).

    Where schema privileges are unknown every context holds it everywhere. Contexts and schemas are never multiplied.
    """
    if privileges is None:
        return schemas.select("schema").distinct(), graph.contexts.where("false").select(F.lit("").alias("schema"), "app_role", "selected")
    usage = privileges.where("privilege = 'USAGE'").select("schema", "grantee").distinct()
    everyone = usage.where("grantee = 'PUBLIC'").select("schema").distinct()
    named = usage.join(everyone, "schema", "left_anti").withColumnRenamed("grantee", "effective")
    return everyone, named.join(graph.contexts, "effective").select("schema", "app_role", "selected").distinct()


def exposure(tables: DataFrame, privileges: DataFrame, graph: RoleGraph, usage: tuple[DataFrame, DataFrame], accepted: tuple[str, ...]) -> DataFrame:
    """schema, name, phrase of tables that an application role can reach with an accepted privilege."""
    rows = privileges.where(F.col("privilege").isin(*accepted)).select("schema", F.col("table").alias("name"), "grantee", "privilege").join(tables.select("schema", "name"), ["schema", "name"], "left_semi")
    everyone, own = usage
    public = rows.where("grantee = 'PUBLIC'").join(everyone.unionByName(own.select("schema").distinct()), "schema", "left_semi").select("schema", "name", "grantee", "privilege", F.concat(F.lit("PUBLIC has "), "privilege").alias("phrase"))
    roles = rows.where("grantee <> 'PUBLIC'")
    anywhere, there = graph.access().withColumnRenamed("target", "grantee"), graph.access(own).withColumnRenamed("target", "grantee")
    said = F.concat(phrase(F.col("mode"), F.col("app_role"), F.col("grantee")), F.lit(" and can exercise "), "privilege", F.lit(" granted to "), "grantee")
    shown = ["schema", "name", "grantee", "privilege", said.alias("phrase")]
    named = roles.join(everyone, "schema", "left_semi").join(anywhere, "grantee").select(*shown).unionByName(roles.join(there, ["grantee", "schema"]).select(*shown))
    first = public.unionByName(named).groupBy("schema", "name").agg(F.min_by("phrase", F.struct("grantee", "privilege")).alias("phrase"))
    # A superuser within reach exposes every table.
    supers = graph.bypass().join(graph.roles.where("superuser").select(F.col("name").alias("target")), "target").agg(F.min(F.struct("mode", "app_role", "target")).alias("s")).where("s is not null")
    power = F.concat(phrase(F.col("s.mode"), F.col("s.app_role"), F.col("s.target")), F.lit(" and can exercise SUPERUSER object privileges"))
    everything = tables.select("schema", "name").join(F.broadcast(supers.select(power.alias("_power"))))
    joined = first.join(everything, ["schema", "name"], "full_outer")
    return joined.select("schema", "name", F.coalesce("_power", "phrase").alias("phrase"))


def composition(policies: DataFrame) -> DataFrame:
    """schema, table, role, command, permissive, restrictive: the names of the policies that combine.

    ALL stands for the four commands; a policy of the literal role `public` applies to every role that the table's policies name.
    """
    commands = F.when(F.col("command") == "ALL", F.array(*map(F.lit, R.COMMANDS))).otherwise(F.array("command"))
    rows = policies.select("schema", "table", "name", "permissive", "roles", F.explode(commands).alias("command"))
    named = policies.select("schema", "table", F.explode("roles").alias("role")).distinct()
    own = rows.where(~F.array_contains("roles", "public")).select("schema", "table", "name", "permissive", "command", F.explode(F.array_distinct("roles")).alias("role"))
    wide = rows.where(F.array_contains("roles", "public")).join(named, ["schema", "table"]).select("schema", "table", "name", "permissive", "command", "role")
    kind = lambda yes: F.array_sort(F.collect_set(F.when(F.col("permissive") == F.lit(yes), F.col("name"))))
    return own.unionByName(wide).groupBy("schema", "table", "role", "command").agg(kind(True).alias("permissive"), kind(False).alias("restrictive"))


def _quoted(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")


def _finding(rows: DataFrame, rule: str, severity, detail: Column, title: str, schema: Column | None = None, table: Column | None = None, policy: Column | None = None, advice: Column | None = None, schemas: tuple[str, ...] = ()) -> DataFrame:
    said = G.RULES[rule]
    sql = None if table is None else G.suggested_sql(rule, F.col("schema"), table, F.col("name") if "command" in rows.columns else None, F.col("command") if "command" in rows.columns else None)
    at = F.coalesce(F.col("schema") if schema is None else schema, F.lit("<database>"))
    tab = F.lit(None).cast("string") if table is None else table
    return findings(
        rows, rule=F.lit(f"{DOCTOR}/{rule}"), doctor=F.lit(DOCTOR), severity=F.lit(severity) if isinstance(severity, str) else severity, confidence=F.lit("high"), category="database-security",
        title=F.lit(title), message=detail, evidence=F.array(evidence("database", detail, schema=at, table=tab, policy=policy)), identity=json_list(at, tab, F.lit(rule), detail),
        impact=F.lit(said.impact), constraints=F.array(F.lit(said.keep), F.lit(G.live_constraint(schemas))), remediation=G.remediation(F.lit(said.advice) if advice is None else advice, sql), verification=G.live_verification(schemas),
    )


def catalog_findings(catalog: dict[str, DataFrame], schemas: tuple[str, ...] = ("public",)) -> DataFrame:
    """All findings of a catalog: tables, policies, relation_privileges, default_privileges, roles, memberships and, where known, schema_privileges.

    schemas: those that were audited; an audit of the same verifies a remedy."""
    _rule = partial(_finding, schemas=schemas)
    tables, policies = catalog["tables"], catalog["policies"]
    graph = RoleGraph(catalog)
    usage = schema_usage(graph, tables, catalog.get("schema_privileges"))
    name, table = F.concat("schema", F.lit("."), "name"), F.col("name")
    reach = lambda accepted: tables.join(exposure(tables, catalog["relation_privileges"], graph, usage, accepted), ["schema", "name"], "left")
    cut, rows = reach(("TRUNCATE",)).where("phrase is not null"), reach(R.ROW_PRIVILEGES).where("not rls_enabled")
    on = tables.where("rls_enabled")
    mine = policies.join(on.select("schema", F.col("name").alias("table")), ["schema", "table"], "left_semi")
    using, check, command = F.col("using_expression"), F.col("check_expression"), F.col("command")
    public = R.any_role(F.col("roles"), R.PUBLIC_LIKE)
    policy, roles = F.concat(F.lit('Policy "'), "name", F.lit('"')), F.array_join("roles", ", ")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    bare = on.join(policies.select("schema", F.col("table").alias("name")), ["schema", "name"], "left_anti")
    groups = composition(mine).where(F.size("permissive") > 1)
    also = F.when(F.size("restrictive") == 1, say(" Restrictive policy ", _quoted(F.col("restrictive")), " is AND-combined with the permissive result.")).when(F.size("restrictive") > 1, say(" Restrictive policies ", _quoted(F.col("restrictive")), " are AND-combined with the permissive result.")).otherwise("")
    best = graph.access().withColumnRenamed("target", "grantee")
    defaults = catalog["default_privileges"].select("schema", "owner", "grantee", "privilege").distinct().join(best, "grantee", "left").where("grantee = 'PUBLIC' or app_role is not null")
    route = F.when(F.col("grantee") == "PUBLIC", "applies to every role").otherwise(phrase(F.col("mode"), F.col("app_role"), F.col("grantee")))
    # An empty schema name counts as none.
    scope = F.when(F.coalesce("schema", F.lit("")) != "", say("Defaults for owner ", F.col("owner"), " in schema ", F.col("schema"))).otherwise(say("Database-wide defaults for owner ", F.col("owner")))
    bypass = graph.bypass().join(graph.roles.where("superuser or bypass_rls").withColumnRenamed("name", "target"), "target")
    power = F.concat_ws(" and ", F.when(F.col("superuser"), "SUPERUSER"), F.when(F.col("bypass_rls"), "BYPASSRLS"))
    t = F.col("table")
    parts = [
        _rule(cut, "reachable-truncate", "high", say(name, " can be truncated; ", F.col("phrase"), ". RLS never protects TRUNCATE."), "An application role can truncate the table", table=table),
        _rule(rows.where("phrase is not null"), "rls-disabled-exposed", "high", say(name, " has no row-level checks; ", F.col("phrase"), "."), "An application role reaches a table without RLS", table=table),
        _rule(rows.where("phrase is null"), "rls-disabled", "medium", say(name, " has no row-level policy enforcement. No reachable application table privilege was found in this catalog snapshot."), "Row-level security is off", table=table),
        _rule(bare, "rls-enabled-no-policies", "medium", say(name, " will default-deny access for non-owner roles, which may break application reads or writes."), "RLS is on without any policy", table=table),
        _rule(on.where("not force_rls"), "force-rls-disabled", "info", F.lit("The table owner bypasses RLS while FORCE RLS is disabled. Superusers and BYPASSRLS roles bypass RLS regardless of FORCE RLS."), "The owner is not forced through RLS", table=table),
        _rule(mine.where(public & command.isin("SELECT", "ALL") & R.unconditional(using)), "public-unconditional-read", "high", say(policy, " grants ", command, " to ", roles, " with no row predicate."), "Anyone can read every row", table=t),
        _rule(mine.where(public & R.unconditional_write(command, using, check)), "public-unconditional-write", "critical", say(policy, " allows ", command, " for ", roles, " with an unconditional predicate."), "Anyone can write any row", table=t, advice=G.write_advice(command)),
        _rule(mine.where(R.missing_check(command, using, check)), "write-policy-missing-check", "medium", say(policy, " handles ", command, " without an explicit insert/update constraint."), "A write policy checks nothing", table=t),
        _rule(mine.where(F.col("permissive") & public), "public-permissive-policy", "low", say(policy, " is permissive, so it is OR-combined with other permissive policies."), "A permissive policy serves a public role", table=t),
        _rule(groups, "multiple-permissive-policies", F.when(F.lower("role").isin(*R.PUBLIC_LIKE), "medium").otherwise("low"),
              say("Role ", F.col("role"), " has ", F.size("permissive").cast("string"), " permissive policies for ", command, ": ", _quoted(F.col("permissive")), ". Their predicates are OR-combined.", also), "Permissive policies combine", table=t),
        _rule(defaults, "broad-default-table-privilege", R.default_severity(F.col("privilege")),
              say(scope, " grant grantee ", F.col("grantee"), " privilege ", F.col("privilege"), "; ", route, ". Future tables created by ", F.col("owner"), " can receive this object privilege without an explicit table grant; actual access also requires schema USAGE."), "Future tables open by default"),
        _rule(bypass, "rls-bypass-role", "high", say(phrase(F.col("mode"), F.col("app_role"), F.col("target")), ". Role ", F.col("target"), " has ", power, " and bypasses row-level security even when FORCE RLS is enabled."), "A role that bypasses RLS is within reach", schema=F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def policies_by_table(policies: DataFrame) -> DataFrame:
    """schema, table, policies (all fields of each, by name)."""
    fields = [c for c in policies.columns if c not in ("schema", "table", "name")]
    return policies.groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.struct("name", *fields))).alias("policies"))


def privileges_by_table(privileges: DataFrame) -> DataFrame:
    """schema, table, privileges (all fields of each, by privilege and grantee)."""
    fields = [c for c in privileges.columns if c not in ("schema", "table", "privilege", "grantee")]
    return privileges.groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.struct("privilege", "grantee", *fields))).alias("privileges"))


def summary(tables: DataFrame, policies: DataFrame, found: DataFrame) -> DataFrame:
    """One row: tables, without_rls, policies, findings of each severity and in all, and the highest severity (`none` without any)."""
    t = tables.agg(F.count(F.lit(1)).alias("tables"), F.count_if(~F.col("rls_enabled")).alias("without_rls"))
    p = policies.agg(F.count(F.lit(1)).alias("policies"))
    f = found.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("findings"), F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("none")).alias("highest")
    )
    return t.join(p).join(f)  # a row each


def fails(found: DataFrame, threshold: str) -> DataFrame:
    """failed: whether a finding reaches the threshold; `none` never fails."""
    least = SEVERITIES.index(threshold) if threshold != "none" else len(SEVERITIES)
    return found.agg(F.coalesce(F.max(severity_rank(F.col("severity"))) >= least, F.lit(False)).alias("failed"))


def of_table(found: DataFrame, schema: str, name: str) -> DataFrame:
    """The findings on one table."""
    return found.where(F.exists("evidence", lambda e: (e["schema"] == schema) & (e["table"] == name)))


def relevant_roles(catalog: dict[str, DataFrame]) -> DataFrame:
    """name: roles connected to any role that owns, grants or is granted something, or serves the application."""
    members = catalog["memberships"]
    edges = members.where("inherit_option or set_option").select(F.col("member").alias("source"), F.col("role").alias("target"))
    cols = [("tables", "owner"), ("relation_privileges", "grantee"), ("relation_privileges", "grantor"), ("schema_privileges", "grantee"), ("default_privileges", "grantee"), ("default_privileges", "owner")]
    seeds = catalog["roles"].where(R.is_application_role(F.col("name")) | F.col("superuser") | F.col("bypass_rls")).select(F.col("name").alias("node"))
    for t, c in cols:
        if catalog.get(t) is not None:
            seeds = seeds.unionByName(catalog[t].select(F.col(c).alias("node")))
    seeds = seeds.unionByName(catalog["policies"].select(F.explode("roles").alias("node"))).where("node is not null").distinct()
    return component(seeds, edges).select(F.col("node").alias("name"))


def narrowed(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalog with the roles and memberships that can matter: on a shared server most roles belong to other databases."""
    kept = cut_lineage(relevant_roles(catalog))
    members = catalog["memberships"]
    for side in ("role", "member"):
        members = members.join(kept.withColumnRenamed("name", side), side, "left_semi")
    return catalog | {"roles": catalog["roles"].join(kept, "name", "left_semi"), "memberships": members.select(*catalog["memberships"].columns)}
