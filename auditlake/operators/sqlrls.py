"""Row-level security of SQL migrations: ordered replay into final table state, and rules R32 to R42."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import guidance as G
from auditlake.functions import rls as R
from auditlake.functions.core import evidence, findings, json_list
from auditlake.functions.sqltext import sql_operation, sql_statements
from auditlake.operators.lineage import cut
from auditlake.schemas import GRANT_STATE, POLICY_STATE

DOCTOR = "database/sql-rls"
OPERATION_FIELDS = "kind schema name enabled policy command permissive roles using_known using_expression check_known check_expression privileges reason".split()


def operations(streams: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations in replay order: stream_id, path, position, ordinal, line, op; troubles: path, trouble).

    streams: stream_id, files (paths in order).
    """
    files = streams.select("stream_id", F.posexplode("files").alias("position", "path"))
    # Statements are lexed once, whatever reads them, and dealt out: one file may hold most of them.
    split = cut(files.join(contents, "path").select("stream_id", "position", "path", sql_statements("content").alias("s")))
    rows = split.select("stream_id", "position", "path", F.explode("s.statements").alias("t")).select("stream_id", "position", "path", F.col("t.ordinal").alias("ordinal"), F.col("t.start_line").alias("line"), F.col("t.text").alias("text"))
    rows = cut(rows.repartition("path", "ordinal").select("stream_id", "position", "path", "ordinal", "line", sql_operation("text").alias("op")))
    return rows, split.where("s.trouble is not null").select("stream_id", "path", F.col("s.trouble").alias("trouble"))


TABLE = ["stream_id", "schema", "name"]
POLICY_CHANGES, GRANT_CHANGES = ("create-policy", "alter-policy", "drop-policy"), ("grant", "revoke")


def replay(ops: DataFrame) -> DataFrame:
    """The final state of every table. Operations on one table never touch another's state.

    A table's life begins anew with its last CREATE TABLE, and its policies and grants also with its last DROP TABLE, which whatever
    follows revives. In a life the last operation on a flag, a grant or a part of a policy decides.
    """
    at = F.struct("path", F.col("line").cast("int").alias("line")).alias("at")
    flat = ops.where(~F.col("op.kind").isin("ignored", "unsupported-relevant")).select("stream_id", "op.*", F.struct("position", "ordinal").alias("seq"), at)
    flat = flat.select(*TABLE, *[c for c in OPERATION_FIELDS if c not in ("schema", "name", "reason")], "seq", "at")
    kind = lambda *k: F.when(F.col("kind").isin(*k), F.col("seq"))
    lives = flat.groupBy(*TABLE).agg(F.max(kind("create-table")).alias("born"), F.max(kind("create-table", "drop-table")).alias("cleared"))
    live = cut(flat.join(lives, TABLE).where(F.col("born").isNull() | (F.col("seq") >= F.col("born"))))
    flag = lambda k: F.max_by(F.struct("enabled", "at"), kind(k))
    tables = live.groupBy(*TABLE).agg(
        F.max("born").isNotNull().alias("declared"), (F.max_by("kind", "seq") == "drop-table").alias("dropped"), F.max_by("at", "seq").alias("last"), F.max_by("at", kind("create-table")).alias("made"),
        flag("set-rls").alias("rls"), flag("set-force-rls").alias("force"),
    )
    after = live.where(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared")))
    j = tables.join(_replayed_policies(after), TABLE, "left").join(_replayed_grants(after), TABLE, "left")
    off = F.when(F.col("declared"), F.lit(False))
    listed = lambda c, ddl: F.coalesce(c, F.array().cast(ddl)).alias(c)
    return j.select(
        *TABLE, "declared", "dropped", F.coalesce("rls.enabled", off).alias("rls_enabled"), F.coalesce("force.enabled", off).alias("force_rls"), F.col("declared").alias("policies_complete"), F.col("declared").alias("grants_complete"),
        listed("policies", f"array<{POLICY_STATE}>"), listed("grants", f"array<{GRANT_STATE}>"), F.col("last").alias("last_evidence"), F.coalesce("rls.at", "made").alias("rls_evidence"), F.coalesce("force.at", "made").alias("force_rls_evidence"),
    )


def _replayed_grants(after: DataFrame) -> DataFrame:
    """The grants that no later revocation takes back, in order of privilege and role."""
    each = after.where(F.col("kind").isin(*GRANT_CHANGES)).select(*TABLE, "seq", "kind", "at", F.explode("privileges").alias("privilege"), "roles").select(*TABLE, "seq", "kind", "at", "privilege", F.explode("roles").alias("role"))
    last = each.groupBy(*TABLE, "privilege", "role").agg(F.max_by(F.struct("kind", "at"), "seq").alias("l")).where("l.kind = 'grant'")
    ordered = F.array_sort(F.collect_list(F.struct("privilege", "role", F.col("l.at").alias("evidence"))))
    return last.groupBy(*TABLE).agg(F.transform(ordered, lambda g: F.struct(g["role"].alias("role"), g["privilege"].alias("privilege"), g["evidence"].alias("evidence"))).alias("grants"))


def _replayed_policies(after: DataFrame) -> DataFrame:
    """Policies since their last creation or removal, by name; of one that was only altered, what was not is unknown."""
    key = [*TABLE, "policy"]
    rows = after.where(F.col("kind").isin(*POLICY_CHANGES))
    lives = rows.groupBy(*key).agg(F.max(F.when(F.col("kind") != "alter-policy", F.col("seq"))).alias("reset"))
    rows = rows.join(lives, key).where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    made, altered = F.when(F.col("kind") == "create-policy", F.col("seq")), F.when(F.col("kind") == "alter-policy", F.col("seq"))
    part = lambda known, *fields: F.max_by(F.struct(*fields, "at"), F.when(F.col("kind").isin("create-policy", "alter-policy") & known, F.col("seq")))
    one = rows.groupBy(*key).agg(
        F.max_by(F.struct("command", "permissive"), made).alias("base"), F.max_by("at", F.coalesce(altered, made)).alias("evidence"), part(F.col("roles").isNotNull(), "roles").alias("r"),
        part(F.col("using_known"), "using_expression").alias("u"), part(F.col("check_known"), "check_expression").alias("c"),
    ).where("evidence is not null")
    state = F.struct(
        F.col("policy").alias("name"), "base.command", "base.permissive", F.col("r.roles").alias("roles"), F.col("u").isNotNull().alias("using_known"), F.col("u.using_expression").alias("using_expression"), F.col("c").isNotNull().alias("check_known"),
        F.col("c.check_expression").alias("check_expression"), "evidence", F.col("r.at").alias("roles_evidence"), F.col("u.at").alias("using_evidence"), F.col("c.at").alias("check_evidence"),
    )
    by_name = F.array_sort(F.collect_list(F.struct(F.col("policy").alias("n"), state.alias("s"))))
    return one.groupBy(*TABLE).agg(F.transform(by_name, lambda p: p["s"]).alias("policies"))


def stream_coverage(ops: DataFrame, troubles: DataFrame) -> DataFrame:
    """stream_id, status, statements_examined, statements_recognized, limitations."""
    odd = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "op.reason")
    rolled = ops.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("statements_examined"), F.count_if(~F.col("op.kind").isin("ignored", "unsupported-relevant")).alias("statements_recognized"), F.collect_set(F.when(F.col("op.kind") == "unsupported-relevant", odd)).alias("a")
    )
    more = troubles.groupBy("stream_id").agg(F.collect_set(F.concat("path", F.lit(": "), "trouble")).alias("b"))
    none = F.array().cast("array<string>")
    limits = F.array_sort(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    j = rolled.join(more, "stream_id", "full_outer").withColumn("limitations", limits)
    return j.select("stream_id", F.when(F.size("limitations") == 0, "completed").otherwise("partial").alias("status"), F.coalesce("statements_examined", F.lit(0)).alias("statements_examined"), F.coalesce("statements_recognized", F.lit(0)).alias("statements_recognized"), "limitations")


def _rule(rows: DataFrame, rule: str, severity: str, title: str, message: Column, at: Column, identity: list | None = None, policy: Column | None = None) -> DataFrame:
    named = F.lit(None).cast("string") if policy is None else policy
    return findings(
        rows, rule=F.lit(f"{DOCTOR}/{rule}"), doctor=F.lit(DOCTOR), severity=F.lit(severity), confidence=F.lit("high"), category="database-security", title=F.lit(title), message=message,
        evidence=F.array(evidence("database", message, schema=F.col("schema"), table=F.col("name"), policy=policy), evidence("file", F.concat(F.lit("SQL statement at line "), at["line"].cast("string"), F.lit(".")), at["path"])),
        identity=json_list(F.col("stream_id"), F.col("schema"), F.col("name"), named, *(identity or [])), path=at["path"], line=at["line"], located=False,
        impact=F.lit(G.RULES[rule].impact), constraints=F.array(F.lit(G.RULES[rule].keep)), remediation=F.lit(G.RULES[rule].advice),
    )


def static_composition(tables: DataFrame) -> DataFrame:
    """stream_id, schema, name, role, command, policies (names, sorted), at: groups of two permissive policies or more; roles are folded to lower case."""
    known = tables.select("stream_id", "schema", "name", F.filter("policies", R.known_policy).alias("k"))
    roles = F.array_distinct(F.filter(F.flatten(F.transform("k", lambda p: p["roles"])), lambda r: F.lower(r) != "public"))
    each = known.withColumn("named", roles).select("stream_id", "schema", "name", "named", F.explode("k").alias("p")).where("p.permissive")
    wide = F.exists("p.roles", lambda r: F.lower(r) == "public")
    who = F.when(wide, F.concat(F.array(F.lit("public")), F.col("named"))).otherwise(F.col("p.roles"))
    what = F.when(F.col("p.command") == "ALL", F.array(*map(F.lit, R.COMMANDS))).otherwise(F.array("p.command"))
    flat = each.select("stream_id", "schema", "name", "p", F.explode(F.array_distinct(F.transform(who, F.lower))).alias("role"), what.alias("c")).select("stream_id", "schema", "name", "p", "role", F.explode("c").alias("command"))
    g = flat.groupBy("stream_id", "schema", "name", "role", "command").agg(F.array_sort(F.collect_set("p.name")).alias("names"), F.min_by("p.evidence", "p.name").alias("at"))
    return g.where(F.size("names") >= 2)


def static_findings(tables: DataFrame) -> DataFrame:
    """All findings of replayed table states. Dropped tables have none; unknown flags and policies say nothing."""
    # Eleven rules read the states, which are joined and gathered once.
    live = cut(tables.where("not dropped"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.concat("schema", F.lit("."), "name")
    grants = F.filter("grants", lambda g: R.is_application_role(g["role"]))
    app = live.withColumns({"cut": F.get(F.filter(grants, lambda g: g["privilege"] == "TRUNCATE"), F.lit(0)), "open": F.get(F.filter(grants, lambda g: g["privilege"].isin(*R.ROW_PRIVILEGES)), F.lit(0))})
    off, on = app.where("rls_enabled = false"), app.where("rls_enabled = true")
    at = F.coalesce("rls_evidence", "last_evidence")
    p = on.select("stream_id", "schema", "name", F.explode("policies").alias("p")).where(R.known_policy(F.col("p")))
    command, using, check, roles = (F.col(f"p.{c}") for c in ("command", "using_expression", "check_expression", "roles"))
    public, facing = R.any_role(roles, R.PUBLIC_LIKE), R.any_role(roles, R.APPLICATION_ROLES)
    policy, listed, pname = F.concat(F.lit('Policy "'), "p.name", F.lit('"')), F.array_join(roles, ", "), F.col("p.name")
    e = lambda *c: F.coalesce(*[F.col(f"p.{x}") for x in c])
    missing = R.missing_check(command, using, check)
    groups = static_composition(on)
    parts = [
        _rule(app.where("cut is not null"), "reachable-truncate", "high", "An application role may truncate the table", say(name, " grants TRUNCATE directly to ", F.col("cut.role"), ". RLS never protects TRUNCATE."), F.col("cut.evidence"), [F.col("cut.role"), F.lit("TRUNCATE")]),
        _rule(off.where("open is null"), "rls-disabled", "medium", "Row-level security is off", say(name, " has RLS disabled."), at),
        _rule(off.where("open is not null"), "rls-disabled-exposed", "high", "An application role reaches a table without RLS", say(name, " has RLS disabled and grants ", F.col("open.privilege"), " directly to ", F.col("open.role"), "."), F.col("open.evidence"), [F.col("open.role"), F.col("open.privilege")]),
        _rule(on.where(F.col("policies_complete") & (F.size("policies") == 0)), "rls-enabled-no-policies", "medium", "RLS is on without any policy", say(name, " denies non-owners everything: its reconstructed policies are empty."), at),
        _rule(on.where("force_rls = false"), "force-rls-disabled", "info", "The owner is not forced through RLS", say(name, " does not force its owner through RLS policies."), F.coalesce("force_rls_evidence", "last_evidence")),
        _rule(p.where(public & command.isin("SELECT", "ALL") & R.unconditional(using)), "public-unconditional-read", "high", "Anyone can read every row", say(policy, " grants ", command, " to ", listed, " without a row predicate."), e("using_evidence", "evidence"), [command, F.lit("read")], pname),
        _rule(p.where(public & R.unconditional_write(command, using, check)), "public-unconditional-write", "critical", "Anyone can write any row", say(policy, " allows ", command, " for ", listed, " without a write predicate."), e("check_evidence", "using_evidence", "evidence"), [command, F.lit("write")], pname),
        _rule(p.where(facing & missing), "write-policy-missing-check", "medium", "A write policy checks nothing", say(policy, " handles ", command, " without a row check."), e("check_evidence", "using_evidence", "evidence"), [command], pname),
        # Every application-facing DELETE policy lands here: its effective check is always missing.
        _rule(p.where(facing & ~missing & (command != "SELECT") & R.unconditional(R.effective_check(command, using, check))), "write-policy-unconditional-check", "medium", "A write policy's check lets everything pass", say(policy, " has an unconditional check for ", command, "."), e("check_evidence", "evidence"), [command], pname),
        _rule(p.where(F.col("p.permissive") & public), "public-permissive-policy", "low", "A permissive policy serves a public role", say(policy, " is OR-combined with other permissive policies for a public role."), e("roles_evidence", "evidence"), [command], pname),
        _rule(groups, "multiple-permissive-policies", "medium", "Permissive policies combine", say("Role ", F.col("role"), " has ", F.size("names").cast("string"), " permissive policies for ", F.col("command"), ": ", F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", "), ". Their predicates are OR-combined."), F.col("at"), [F.col("role"), F.col("command"), (F.to_json("names"),)]),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def missing_history(streams: DataFrame, changes: DataFrame) -> DataFrame:
    """stream_id of streams from which a migration was deleted or renamed away: their replay is partial. streams: stream_id, root."""
    gone = changes.where("status = 'deleted'").select("path").unionByName(changes.where("status = 'renamed'").select(F.col("previous_path").alias("path")))
    return _streams_of(streams, gone)


def affected_streams(streams: DataFrame, changes: DataFrame) -> DataFrame:
    """stream_id of streams that a change touches: renames count with both paths, copies with their destination."""
    touched = changes.select("path").unionByName(changes.where("status = 'renamed' and previous_path is not null").select(F.col("previous_path").alias("path")))
    return _streams_of(streams, touched)


def unselected_streams(streams: DataFrame, changes: DataFrame) -> DataFrame:
    """stream_id of streams that no change touches: a changed scope leaves them out, and says so."""
    return streams.select("stream_id").distinct().join(affected_streams(streams, changes), "stream_id", "left_anti")


def _streams_of(streams: DataFrame, paths: DataFrame) -> DataFrame:
    from auditlake.functions.paths import ancestors

    up = paths.where(F.endswith("path", F.lit(".sql"))).select(F.explode(ancestors(F.col("path"))).alias("root")).distinct()
    return streams.join(up, "root", "left_semi").select("stream_id").distinct()
