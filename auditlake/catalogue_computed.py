"""Registered queries of rule families whose SQL computes every rule: inputs are columns of the tables in free combination.

Nothing here holds an expected row; both sides define the same views, and the SQL states each rule's predicate and wording itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.catalogue import query, table
from auditlake.catalogue_rules import sql_fingerprint
from auditlake.functions import packages
from auditlake.functions import rls as R
from auditlake.operators import dependencies, rls, sqlrls


def pick(values, at):
    """The value at a number, null beyond."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# A catalog: tables of parts, policies of orders, grants of lines, schema usage of nations, defaults of suppliers, roles and their
# memberships (cycles of twenty) of customers; three application roles are members of the first.

COMMANDS, USING, CHECK = ("ALL", *R.COMMANDS), (None, "true", "(1 = 1)", "owner = me", "( TRUE )"), (None, "owner = me", "1=1")
ROLES = (("public",), ("anon", "Writer"), ("authenticated",), ("staff",), ("PUBLIC",))
MEMBERS = (("r1", "anon", True, False), ("r2", "authenticated", False, True), ("r3", "anonymous", True, True))

CATALOG = f"""n AS (SELECT count(*) AS n FROM part),
tables AS (SELECT 's' || p_size % 5 AS schema, 't' || p_partkey AS name, 'owner' || p_size % 3 AS owner, p_partkey % 3 <> 0 AS on_, p_partkey % 4 = 0 AS forced, p_partkey AS k FROM part),
policies AS (SELECT schema, tables.name AS tab, 'p' || o_orderkey AS name, {sql_list(COMMANDS)}[o_orderkey % 5 + 1] AS command, o_custkey % 3 <> 0 AS permissive, [{", ".join(map(sql_list, ROLES))}][o_custkey % 5 + 1] AS roles,
  {sql_list(USING)}[o_orderkey % 7 % 5 + 1] AS using_, {sql_list(CHECK)}[o_custkey % 3 + 1] AS check_ FROM orders, n JOIN tables ON k = 1 + (o_orderkey * 31 + o_custkey) % n),
grants AS (SELECT DISTINCT schema, name, CASE l_linenumber WHEN 7 THEN 'PUBLIC' WHEN 6 THEN 'anon' ELSE 'r' || l_suppkey % 20 END AS grantee, {sql_list(R.RELATION_PRIVILEGES)}[l_quantity::INT % 7 + 1] AS privilege FROM lineitem JOIN tables ON k = l_partkey + 1),
usage AS (SELECT DISTINCT 's' || n_nationkey % 5 AS schema, CASE WHEN n_nationkey % 11 = 0 THEN 'PUBLIC' ELSE 'r' || n_nationkey % 20 END AS grantee FROM nation),
defaults AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 <> 0 THEN 's' || s_suppkey % 5 END AS schema, 'owner' || s_suppkey % 3 AS owner, CASE WHEN s_suppkey % 7 = 0 THEN 'PUBLIC' ELSE 'r' || s_suppkey % 25 END AS grantee, {sql_list(R.RELATION_PRIVILEGES)}[s_suppkey % 5 + 1] AS privilege FROM supplier),
roles AS (SELECT DISTINCT c_custkey % 20 AS k, 'r' || c_custkey % 20 AS name, c_custkey % 20 % 6 = 5 AS bypass, c_custkey % 20 % 4 <> 3 AS inherits FROM customer),
members(role, member, inherit, setting) AS (SELECT 'r' || (k * 7 + 3) % 20, name, k % 3 <> 0, k % 2 = 0 FROM roles UNION ALL VALUES {", ".join(f"('{r}', '{m}', {i}, {s})" for r, m, i, s in MEMBERS)}),
app(app) AS (VALUES ('anon'), ('anonymous'), ('authenticated')),
sel AS (SELECT app, app AS sel FROM app UNION SELECT app, role FROM sel JOIN members ON member = sel WHERE setting),
eff AS (SELECT DISTINCT sel, sel AS eff FROM sel UNION SELECT sel, role FROM eff JOIN members ON member = eff WHERE inherit AND eff NOT IN (SELECT name FROM roles WHERE NOT inherits)),
ctx AS (SELECT app, sel, eff, CASE WHEN app <> sel THEN 2 WHEN app = eff THEN 0 ELSE 1 END AS mode FROM sel JOIN eff USING (sel)),
held AS (SELECT DISTINCT schema, app, sel FROM usage JOIN ctx ON grantee = 'PUBLIC' OR grantee = eff),
best AS (SELECT schema, eff, min({{'mode': mode, 'app': app}}) AS b FROM held JOIN ctx USING (app, sel) GROUP BY schema, eff),
anywhere AS (SELECT eff, min({{'mode': mode, 'app': app}}) AS b FROM ctx GROUP BY eff),
hits AS (SELECT schema, name, grantee, privilege, 'PUBLIC has ' || privilege AS phrase FROM grants WHERE grantee = 'PUBLIC' AND schema IN (SELECT schema FROM held)
  UNION ALL SELECT grants.schema, name, grantee, privilege, 'Application role ' || b.app || CASE b.mode WHEN 0 THEN '' WHEN 1 THEN ' reaches ' || grantee || ' through inherited membership' ELSE ' reaches ' || grantee || ' through SET ROLE' END || ' and can exercise ' || privilege || ' granted to ' || grantee
  FROM grants JOIN best ON grantee = eff AND grants.schema = best.schema),
reached AS (SELECT schema, name, privilege = 'TRUNCATE' AS truncating, min_by(phrase, {{'g': grantee, 'p': privilege}}) AS phrase FROM hits WHERE privilege IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE') GROUP BY ALL)"""


def v_catalog(spark, d) -> dict[str, DataFrame]:
    k, text = F.col("p_partkey"), lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    part = table(spark, d, "part")
    tables = part.select(text("s", F.col("p_size") % 5).alias("schema"), text("t", k).alias("name"), text("owner", F.col("p_size") % 3).alias("owner"), (k % 3 != 0).alias("rls_enabled"), (k % 4 == 0).alias("force_rls"), k.alias("k"))
    at = lambda rows, key: rows.withColumn("k", key).join(tables.select("k", "schema", F.col("name").alias("table")), "k")
    o, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.broadcast(part.agg(F.count(F.lit(1)).alias("n")))
    lists = F.get(F.array(*[F.array(*map(F.lit, r)) for r in ROLES]), (c % 5).cast("int"))
    policies = at(table(spark, d, "orders").join(n), 1 + (o * 31 + c) % F.col("n")).select(
        "schema", "table", text("p", o).alias("name"), pick(COMMANDS, o % 5).alias("command"), (c % 3 != 0).alias("permissive"), lists.alias("roles"), pick(USING, o % 7 % 5).alias("using_expression"), pick(CHECK, c % 3).alias("check_expression")
    )
    line, key = F.col("l_linenumber"), F.col("n_nationkey")
    who = F.when(line == 7, "PUBLIC").when(line == 6, "anon").otherwise(text("r", F.col("l_suppkey") % 20))
    grants = at(table(spark, d, "lineitem"), F.col("l_partkey") + 1).select("schema", "table", F.lit("boss").alias("grantor"), who.alias("grantee"), pick(R.RELATION_PRIVILEGES, F.round("l_quantity").cast("int") % 7).alias("privilege"), F.lit(False).alias("grantable"))
    usage = table(spark, d, "nation").select(text("s", key % 5).alias("schema"), F.lit("boss").alias("grantor"), F.when(key % 11 == 0, "PUBLIC").otherwise(text("r", key % 20)).alias("grantee"), F.lit("USAGE").alias("privilege"), F.lit(False).alias("grantable"))
    s = F.col("s_suppkey")
    defaults = table(spark, d, "supplier").select(F.when(s % 4 != 0, text("s", s % 5)).alias("schema"), text("owner", s % 3).alias("owner"), F.when(s % 7 == 0, "PUBLIC").otherwise(text("r", s % 25)).alias("grantee"), F.lit("r").alias("object_type"), pick(R.RELATION_PRIVILEGES, s % 5).alias("privilege"), F.lit(False).alias("grantable"))
    i = F.col("i")
    roles = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("i")).distinct()
    members = roles.select(text("r", (i * 7 + 3) % 20).alias("role"), text("r", i).alias("member"), (i % 3 != 0).alias("inherit_option"), (i % 2 == 0).alias("set_option"))
    return {
        "tables": tables.select("schema", "name", "owner", "rls_enabled", "force_rls", F.lit(False).alias("is_partitioned"), null("bigint").alias("estimated_rows")), "policies": policies, "relation_privileges": grants.distinct(), "schema_privileges": usage, "default_privileges": defaults,
        "roles": roles.select(text("r", i).alias("name"), F.lit(False).alias("superuser"), (i % 6 == 5).alias("bypass_rls"), (i % 4 != 3).alias("inherits")), "memberships": members.unionByName(spark.createDataFrame(list(MEMBERS), members.schema)),
    }


PLAIN = "lower(trim(regexp_replace({0}, '[()]', '', 'g'))) IN ('', 'true', '1 = 1', '1=1') OR {0} IS NULL"
TRUE_USING, TRUE_CHECK = f"({PLAIN.format('using_')})", f"({PLAIN.format('checked')})"
PUBLIC = "len(list_filter(roles, lambda r: lower(r) IN ('public', 'anon', 'anonymous'))) > 0"
QUOTED = "array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ', ')"

RULES = f"""mine AS (SELECT policies.*, coalesce(check_, CASE WHEN command IN ('UPDATE', 'ALL') THEN using_ END) AS checked, 'Policy "' || policies.name || '"' AS policy, array_to_string(roles, ', ') AS listed FROM policies JOIN tables ON policies.schema = tables.schema AND tab = tables.name WHERE on_),
each AS (SELECT schema, tab, name, permissive, roles, unnest(CASE WHEN command = 'ALL' THEN ['SELECT', 'INSERT', 'UPDATE', 'DELETE'] ELSE [command] END) AS command FROM mine),
named AS (SELECT DISTINCT schema, tab, unnest(roles) AS role FROM mine),
dealt AS (SELECT schema, tab, name, permissive, command, unnest(list_distinct(roles)) AS role FROM each WHERE NOT list_contains(roles, 'public') UNION ALL SELECT each.schema, each.tab, name, permissive, command, role FROM each JOIN named ON each.schema = named.schema AND each.tab = named.tab WHERE list_contains(roles, 'public')),
sets AS (SELECT schema, tab, role, command, list_sort(list(DISTINCT name) FILTER (permissive)) AS p, list_sort(coalesce(list(DISTINCT name) FILTER (NOT permissive), [])) AS r FROM dealt GROUP BY ALL HAVING count(DISTINCT name) FILTER (permissive) > 1),
open_ AS (SELECT tables.*, phrase FROM tables LEFT JOIN reached ON reached.schema = tables.schema AND reached.name = tables.name AND NOT truncating WHERE NOT on_),
bypassing AS (SELECT sel AS target, min({{'mode': CASE WHEN app = sel THEN 0 ELSE 2 END, 'app': app}}) AS b FROM sel JOIN roles ON sel = name WHERE bypass GROUP BY sel),
found AS (
SELECT 'reachable-truncate' AS rule, 'high' AS severity, schema, name AS tab, schema || '.' || name || ' can be truncated; ' || phrase || '. RLS never protects TRUNCATE.' AS detail FROM reached WHERE truncating
UNION ALL SELECT 'rls-disabled-exposed', 'high', schema, name, schema || '.' || name || ' has no row-level checks; ' || phrase || '.' FROM open_ WHERE phrase IS NOT NULL
UNION ALL SELECT 'rls-disabled', 'medium', schema, name, schema || '.' || name || ' has no row-level policy enforcement. No reachable application table privilege was found in this catalog snapshot.' FROM open_ WHERE phrase IS NULL
UNION ALL SELECT 'rls-enabled-no-policies', 'medium', schema, name, schema || '.' || name || ' will default-deny access for non-owner roles, which may break application reads or writes.' FROM tables WHERE on_ AND NOT EXISTS (SELECT 1 FROM policies WHERE policies.schema = tables.schema AND tab = tables.name)
UNION ALL SELECT 'force-rls-disabled', 'info', schema, name, 'The table owner bypasses RLS while FORCE RLS is disabled. Superusers and BYPASSRLS roles bypass RLS regardless of FORCE RLS.' FROM tables WHERE on_ AND NOT forced
UNION ALL SELECT 'public-unconditional-read', 'high', schema, tab, policy || ' grants ' || command || ' to ' || listed || ' with no row predicate.' FROM mine WHERE {PUBLIC} AND command IN ('SELECT', 'ALL') AND {TRUE_USING}
UNION ALL SELECT 'public-unconditional-write', 'critical', schema, tab, policy || ' allows ' || command || ' for ' || listed || ' with an unconditional predicate.' FROM mine WHERE {PUBLIC} AND (command = 'DELETE' AND {TRUE_USING} OR command = 'INSERT' AND {TRUE_CHECK} OR command IN ('UPDATE', 'ALL') AND ({TRUE_USING} OR {TRUE_CHECK}))
UNION ALL SELECT 'write-policy-missing-check', 'medium', schema, tab, policy || ' handles ' || command || ' without an explicit insert/update constraint.' FROM mine WHERE check_ IS NULL AND command IN ('INSERT', 'UPDATE', 'ALL') AND {TRUE_CHECK}
UNION ALL SELECT 'public-permissive-policy', 'low', schema, tab, policy || ' is permissive, so it is OR-combined with other permissive policies.' FROM mine WHERE permissive AND {PUBLIC}
UNION ALL SELECT 'multiple-permissive-policies', CASE WHEN lower(role) IN ('public', 'anon', 'anonymous') THEN 'medium' ELSE 'low' END, schema, tab, 'Role ' || role || ' has ' || len(p) || ' permissive policies for ' || command || ': ' || {QUOTED.format("p")} || '. Their predicates are OR-combined.'
  || CASE len(r) WHEN 0 THEN '' WHEN 1 THEN ' Restrictive policy ' || {QUOTED.format("r")} || ' is AND-combined with the permissive result.' ELSE ' Restrictive policies ' || {QUOTED.format("r")} || ' are AND-combined with the permissive result.' END FROM sets
UNION ALL SELECT 'broad-default-table-privilege', CASE WHEN privilege IN ('INSERT', 'UPDATE', 'DELETE', 'TRUNCATE') THEN 'high' WHEN privilege = 'SELECT' THEN 'medium' ELSE 'low' END, schema, NULL, CASE WHEN schema IS NULL THEN 'Database-wide defaults for owner ' || owner ELSE 'Defaults for owner ' || owner || ' in schema ' || schema END
  || ' grant grantee ' || grantee || ' privilege ' || privilege || '; ' || CASE WHEN grantee = 'PUBLIC' THEN 'applies to every role' ELSE 'Application role ' || b.app || CASE b.mode WHEN 0 THEN '' WHEN 1 THEN ' reaches ' || grantee || ' through inherited membership' ELSE ' reaches ' || grantee || ' through SET ROLE' END END
  || '. Future tables created by ' || owner || ' can receive this object privilege without an explicit table grant; actual access also requires schema USAGE.' FROM defaults LEFT JOIN anywhere ON grantee = eff WHERE grantee = 'PUBLIC' OR eff IS NOT NULL
UNION ALL SELECT 'rls-bypass-role', 'high', NULL, NULL, 'Application role ' || b.app || CASE b.mode WHEN 0 THEN '' ELSE ' reaches ' || target || ' through SET ROLE' END || '. Role ' || target || ' has BYPASSRLS and bypasses row-level security even when FORCE RLS is enabled.' FROM bypassing)"""

IDENTITY = "'[' || to_json(coalesce(schema, '<database>'))::VARCHAR || ',' || coalesce(to_json(tab)::VARCHAR, 'null') || ',' || to_json(rule)::VARCHAR || ',' || to_json(detail)::VARCHAR || ']'"


@query(f"""WITH RECURSIVE {CATALOG}, {RULES}
SELECT rule, severity, schema, tab AS table_name, detail, {sql_fingerprint("'database/rls'", "'database/rls/' || rule", "'null'", IDENTITY)} AS fingerprint FROM found""")
def r20_computed_rules(spark, d) -> DataFrame:
    """The rules on a live catalog whose tables, policies, grants, usage, defaults and memberships are columns of six tables."""
    found = rls.catalog_findings(v_catalog(spark, d))
    at = F.get("evidence", F.lit(0))
    return found.select(F.substring_index("rule_id", "/", -1).alias("rule"), "severity", F.nullif(at["schema"], F.lit("<database>")).alias("schema"), at["table"].alias("table_name"), F.col("message").alias("detail"), "fingerprint")


def pairs(graph: rls.RoleGraph) -> DataFrame:
    return graph.access().select(F.col("target").alias("role"), F.col("mode").cast("bigint").alias("mode"), "app_role")


@query(f"WITH RECURSIVE {CATALOG} SELECT eff AS role, b.mode::BIGINT AS mode, b.app AS app_role FROM anywhere")
def g6_role_access(spark, d) -> DataFrame:
    """The best access of application roles to each role, over memberships with cycles."""
    return pairs(rls.RoleGraph(v_catalog(spark, d)))


@query(f"""WITH RECURSIVE {CATALOG}, {RULES}, c AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) AS findings FROM found)
SELECT (SELECT count(*) FROM tables) AS tables, (SELECT count(*) FROM tables WHERE NOT on_) AS without_rls, (SELECT count(*) FROM policies) AS policies, * FROM c""")
def a2_computed_summary(spark, d) -> DataFrame:
    """Counts of tables, policies and findings of the same catalog."""
    c = v_catalog(spark, d)
    out = rls.summary(c["tables"], c["policies"], rls.catalog_findings(c))
    return out.select("tables", "without_rls", "policies", *("critical high medium low info".split()), "findings")


# Migrations: a file of nine lines for each part, a stream for each size. Each line is a statement whose form depends on the part's key.

S_ROLES, S_USING, S_CHECK = ("public", "anon, staff", "authenticated", "staff"), (None, "true", "((true))", "owner = me", "1=1"), (None, "owner = me", "TRUE")
G_ROLES, G_PRIVILEGES = ("anon", "staff", 'authenticated, "Reader"', "PUBLIC"), ("select", "truncate", "insert, update", "truncate, delete")


def v_migrations(spark, d) -> tuple[DataFrame, DataFrame]:
    """(streams, contents)."""
    k = F.col("p_partkey")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    part = lambda n: F.floor(k / n)
    t, key = say("t", k.cast("string")), k.cast("string")
    command = F.lower(pick(COMMANDS, part(5) % 5))
    using, check = pick(S_USING, part(2) % 5), pick(S_CHECK, part(4) % 3)
    using = F.when((command != "insert") & using.isNotNull(), say(" USING (", using, ")")).otherwise("")
    check = F.when(~command.isin("select", "delete") & check.isNotNull(), say(" with check (", check, ")")).otherwise("")
    made = say('create policy "P ', key, '" on public.', t, F.when(k % 7 == 0, " as restrictive").otherwise(""), " for ", command, " to ", pick(S_ROLES, part(3) % 4), using, check, ";")
    lines = [
        F.lit("select 0 /* it's ; */;"),
        F.when(k % 5 != 0, say("CREATE TABLE IF NOT EXISTS public.", t, " (id int, note text default ';');")).otherwise("select 1;"),
        F.when(k % 3 != 0, say('alter table "', t, '" ENABLE row level security;')).otherwise(say("comment on table ", t, " is 'x';")),
        F.when(k % 4 == 0, say("alter table ", t, " force\trow level security;")).otherwise("select $q$create policy;$q$;"),
        F.when(k % 2 == 0, say("grant ", pick(G_PRIVILEGES, part(2) % 4), " on table ", t, " to ", pick(G_ROLES, part(6) % 4), ";")).otherwise("select 2;"),
        F.when(k % 4 != 1, made).otherwise("select 3;"), F.when(k % 3 == 1, say("create policy q", key, " on ", t, " for select to public using (true);")).otherwise("select 4;"),
        F.when(k % 11 == 0, say("revoke select, truncate on ", t, " from anon;")).otherwise("select 5;"), F.when(k % 13 == 0, say("drop table ", t, ";")).otherwise("select 6;"),
    ]
    rows = table(spark, d, "part").select(say("st", F.col("p_size").cast("string")).alias("stream_id"), say("m/", F.lpad(key, 12, "0"), ".sql").alias("path"), F.concat_ws("\n", *lines).alias("content"))
    return rows.groupBy("stream_id").agg(F.array_sort(F.collect_list("path")).alias("files")), rows.select("path", "content")


FACING = "len(list_filter(roles, lambda r: lower(r) IN ('public', 'anon', 'anonymous', 'authenticated'))) > 0"
STATES = f"""k AS (SELECT p_partkey AS k, 'st' || p_size AS stream, 't' || p_partkey AS name, p_partkey % 5 <> 0 AS made, CASE WHEN p_partkey % 3 <> 0 THEN true WHEN p_partkey % 5 <> 0 THEN false END AS on_ FROM part WHERE p_partkey % 13 <> 0),
g AS (SELECT *, unnest(string_split({sql_list(G_PRIVILEGES)}[k // 2 % 4 + 1], ', ')) AS privilege FROM k WHERE k % 2 = 0),
h AS (SELECT k, upper(privilege) AS privilege, unnest(string_split(replace(replace({sql_list(G_ROLES)}[k // 6 % 4 + 1], '"', ''), 'PUBLIC', 'public'), ', ')) AS role FROM g),
held AS (SELECT * FROM h WHERE lower(role) IN ('public', 'anon', 'anonymous', 'authenticated') AND NOT (k % 11 = 0 AND role = 'anon' AND privilege IN ('SELECT', 'TRUNCATE'))),
cutting AS (SELECT k, min(role) AS role FROM held WHERE privilege = 'TRUNCATE' GROUP BY k),
opening AS (SELECT k, min({{'p': privilege, 'r': role}}) AS o FROM held WHERE privilege IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') GROUP BY k),
q AS (SELECT k, 'P ' || k AS pname, {sql_list(COMMANDS)}[k // 5 % 5 + 1] AS command, k % 7 <> 0 AS permissive, string_split({sql_list(S_ROLES)}[k // 3 % 4 + 1], ', ') AS roles, {sql_list(S_USING)}[k // 2 % 5 + 1] AS u, {sql_list(S_CHECK)}[k // 4 % 3 + 1] AS c, 6 AS line FROM k WHERE k % 4 <> 1
  UNION ALL SELECT k, 'q' || k, 'SELECT', true, ['public'], 'true', NULL, 7 FROM k WHERE k % 3 = 1),
pol AS (SELECT k, pname, command, permissive, roles, line, CASE WHEN command <> 'INSERT' THEN u END AS using_, CASE WHEN command NOT IN ('SELECT', 'DELETE') THEN c END AS check_ FROM q),
p AS (SELECT stream, name, pol.*, coalesce(check_, CASE WHEN command IN ('UPDATE', 'ALL') THEN using_ END) AS checked, 'Policy "' || pname || '"' AS policy, array_to_string(roles, ', ') AS listed FROM pol JOIN k USING (k) WHERE on_),
w AS (SELECT *, check_ IS NULL AND command IN ('INSERT', 'UPDATE', 'ALL') AND {TRUE_CHECK} AS missing FROM p),
found AS (
SELECT 'reachable-truncate' AS rule, 'high' AS severity, stream, name, NULL AS pname, 5 AS line, 'public.' || name || ' grants TRUNCATE directly to ' || role || '. RLS never protects TRUNCATE.' AS detail, [role, 'TRUNCATE'] AS more, '' AS tail FROM cutting JOIN k USING (k)
UNION ALL SELECT 'rls-disabled', 'medium', stream, name, NULL, 2, 'public.' || name || ' has RLS disabled.', [], '' FROM k WHERE NOT on_ AND k NOT IN (SELECT k FROM opening)
UNION ALL SELECT 'rls-disabled-exposed', 'high', stream, name, NULL, 5, 'public.' || name || ' has RLS disabled and grants ' || o.p || ' directly to ' || o.r || '.', [o.r, o.p], '' FROM opening JOIN k USING (k) WHERE NOT on_
UNION ALL SELECT 'rls-enabled-no-policies', 'medium', stream, name, NULL, 3, 'public.' || name || ' denies non-owners everything: its reconstructed policies are empty.', [], '' FROM k WHERE on_ AND made AND k NOT IN (SELECT k FROM pol)
UNION ALL SELECT 'force-rls-disabled', 'info', stream, name, NULL, 2, 'public.' || name || ' does not force its owner through RLS policies.', [], '' FROM k WHERE on_ AND made AND k % 4 <> 0
UNION ALL SELECT 'public-unconditional-read', 'high', stream, name, pname, line, policy || ' grants ' || command || ' to ' || listed || ' without a row predicate.', [command, 'read'], '' FROM w WHERE {PUBLIC} AND command IN ('SELECT', 'ALL') AND {TRUE_USING}
UNION ALL SELECT 'public-unconditional-write', 'critical', stream, name, pname, line, policy || ' allows ' || command || ' for ' || listed || ' without a write predicate.', [command, 'write'], '' FROM w WHERE {PUBLIC} AND (command = 'DELETE' AND {TRUE_USING} OR command = 'INSERT' AND {TRUE_CHECK} OR command IN ('UPDATE', 'ALL') AND ({TRUE_USING} OR {TRUE_CHECK}))
UNION ALL SELECT 'write-policy-missing-check', 'medium', stream, name, pname, line, policy || ' handles ' || command || ' without a row check.', [command], '' FROM w WHERE {FACING} AND missing
UNION ALL SELECT 'write-policy-unconditional-check', 'medium', stream, name, pname, line, policy || ' has an unconditional check for ' || command || '.', [command], '' FROM w WHERE {FACING} AND NOT missing AND command <> 'SELECT' AND {TRUE_CHECK}
UNION ALL SELECT 'public-permissive-policy', 'low', stream, name, pname, line, policy || ' is OR-combined with other permissive policies for a public role.', [command], '' FROM w WHERE permissive AND {PUBLIC}
UNION ALL SELECT 'multiple-permissive-policies', 'medium', stream, name, NULL, 6, 'Role ' || role || ' has 2 permissive policies for SELECT: "P ' || k || '", "q' || k || '". Their predicates are OR-combined.', [role, 'SELECT'], ',["P ' || k || '","q' || k || '"]'
  FROM (SELECT stream, name, k, unnest(roles) AS role FROM w WHERE line = 6 AND permissive AND command IN ('ALL', 'SELECT') AND k % 3 = 1))"""
S_IDENTITY = "'[' || to_json(stream)::VARCHAR || ',\"public\",' || to_json(name)::VARCHAR || ',' || coalesce(to_json(pname)::VARCHAR, 'null') || array_to_string(list_transform(more, lambda x: ',' || to_json(x)::VARCHAR), '') || tail || ']'"


@query(f"""WITH {STATES} SELECT rule, severity, stream AS stream_id, 'm/' || lpad(name[2:], 12, '0') || '.sql' AS path, line, detail, {sql_fingerprint("'database/sql-rls'", "'database/sql-rls/' || rule", "'null'", S_IDENTITY)} AS fingerprint FROM found""")
def r32_computed_rules(spark, d) -> DataFrame:
    """The rules on migrations: statements are composed from the parts' keys, lexed, read, replayed and judged."""
    streams, contents = v_migrations(spark, d)
    ops, _ = sqlrls.operations(streams, contents)
    found = sqlrls.static_findings(sqlrls.replay(ops))
    stream = F.col("files.stream_id")
    placed = found.alias("found").join(streams.select("stream_id", F.explode("files").alias("path")).alias("files"), "path")
    return placed.select(F.substring_index("rule_id", "/", -1).alias("rule"), "severity", stream.alias("stream_id"), "path", F.col("line").cast("int").alias("line"), F.col("message").alias("detail"), "fingerprint")


@query("""WITH k AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT 'st' || s AS stream_id, 'completed' AS status, 9 * count(*) AS statements_examined, count(*) FILTER (k % 5 <> 0) + count(*) FILTER (k % 3 <> 0) + count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 4 <> 1) + count(*) FILTER (k % 3 = 1) + count(*) FILTER (k % 11 = 0) + count(*) FILTER (k % 13 = 0) AS statements_recognized,
  0::BIGINT AS limitations FROM k GROUP BY s""")
def t7_computed_coverage(spark, d) -> DataFrame:
    """Statements examined and recognised in each stream."""
    ops, troubles = sqlrls.operations(*v_migrations(spark, d))
    return sqlrls.stream_coverage(ops, troubles).withColumn("limitations", F.size("limitations").cast("bigint"))


# Dependencies: a root for each customer, whose orders are dependencies; what is locked and installed follows from the same orders.

SPECS = ("^1", "http://h.test/x.tgz", "git://h.test/x", "github:a/b#main", "github:a/b#" + "0" * 40, "workspace:*", "file:../x", "https://h.test/x.tgz")
CLASSES = ("registry", "insecure-http", "insecure-git", "git-mutable", "git-pinned", "workspace", "local-file", "secure-https")
SECTIONS_, SOURCES_, STATES_ = ("dependencies", "devDependencies", "peerDependencies"), ("registry", "insecure-http", "insecure-git", "secure-https", "git-pinned"), ("valid", "missing", "invalid", "not-required")


def v_dependencies(spark, d) -> tuple[DataFrame, ...]:
    """(targets, covered, sections, entries, internal)."""
    o, c = F.col("o"), F.col("c_custkey")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    name = lambda n: F.concat("lock_root", F.lit("/" + n))
    roots = table(spark, d, "customer").select(text("r", c).alias("lock_root"), pick(("package-lock", "package-lock", "shrinkwrap", "none", "none"), c % 5).alias("authority"), F.when(c % 5 < 3, "governed").when(c % 5 == 3, "explicit-standalone").otherwise("unresolved").alias("lock_ownership"))
    lockfile = F.when(F.col("authority") == "shrinkwrap", name("npm-shrinkwrap.json")).when(F.col("authority") == "package-lock", name("package-lock.json"))
    targets = roots.withColumns({"lockfile": lockfile, "competing": F.when(F.col("authority") == "shrinkwrap", F.array(name("package-lock.json"))).otherwise(F.array().cast("array<string>"))})
    covered = roots.select("lock_root", F.concat(F.lit("project:"), "lock_root").alias("project_id"), F.col("lock_root").alias("root"), name("package.json").alias("manifest_path"))
    orders = table(spark, d, "orders").select(text("r", F.col("o_custkey")).alias("lock_root"), F.col("o_orderkey").alias("o")).join(roots.select("lock_root", "authority"), "lock_root")
    wanted = orders.groupBy("lock_root", "authority", pick(SECTIONS_, o % 3).alias("section"), (o % 40).alias("n")).agg(F.max("o").alias("o"))
    sections = wanted.select(name("package.json").alias("path"), "section", text("d", F.col("n")).alias("name"), pick(SPECS, o % 8).alias("spec"))
    kept = wanted.where("authority <> 'none'")
    spec = F.when(o % 9 == 0, "^9").otherwise(pick(SPECS, o % 8))
    more = kept.where(o % 11 == 0).select("lock_root", F.lit("dependencies").alias("section"), text("z", F.col("n")).alias("name"), F.lit("1").alias("spec")).distinct()
    held = kept.where(o % 10 != 0).select("lock_root", "section", text("d", F.col("n")).alias("name"), spec.alias("spec")).unionByName(more)
    held = held.groupBy("lock_root", "section").agg(F.map_from_entries(F.collect_list(F.struct("name", "spec"))).alias("m")).groupBy("lock_root").agg(F.map_from_entries(F.collect_list(F.struct("section", "m"))).alias("sections"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    head = held.select("lock_root", F.lit("").alias("path"), none.alias("package_name"), no.alias("link"), none.alias("resolved_workspace_path"), F.lit("registry").alias("source_class"), no.alias("git_pinned"), no.alias("tarball"), F.lit("not-required").alias("integrity"), "sections")
    n, source = F.col("n"), pick(SOURCES_, o % 5)
    had = kept.groupBy("lock_root", "n").agg(F.max("o").alias("o")).select(
        "lock_root", text("node_modules/d", n).alias("path"), text("d", n).alias("package_name"), (n % 8 == 0).alias("link"), text("", F.when(o % 3 == 0, F.concat(F.lit("w"), n.cast("string"))).otherwise(F.concat(F.lit("../packages/w"), n.cast("string")))).alias("resolved_workspace_path"),
        source.alias("source_class"), (source == "git-pinned").alias("git_pinned"), no.alias("tarball"), pick(STATES_, F.floor(o / 5) % 4).alias("integrity"), F.lit(None).cast(head.schema["sections"].dataType).alias("sections"),
    )
    internal = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("n")).distinct().where("n % 4 = 0").select(text("d", n).alias("name"), text("packages/w", n).alias("root"))
    return targets, covered, sections, head.unionByName(had), internal


LOCKED = f"""c AS (SELECT 'r' || c_custkey AS root, c_custkey % 5 AS k, CASE c_custkey % 5 WHEN 2 THEN 'r' || c_custkey || '/npm-shrinkwrap.json' WHEN 0 THEN 'r' || c_custkey || '/package-lock.json' WHEN 1 THEN 'r' || c_custkey || '/package-lock.json' END AS lock FROM customer),
w AS (SELECT root, k, lock, {sql_list(SECTIONS_)}[o_orderkey % 3 + 1] AS section, o_orderkey % 40 AS n, max(o_orderkey) AS o FROM orders JOIN c ON root = 'r' || o_custkey GROUP BY ALL),
m AS (SELECT *, 'd' || n AS name, {sql_list(SPECS)}[o % 8 + 1] AS spec, {sql_list(CLASSES)}[o % 8 + 1] AS class, root || '/package.json' AS path FROM w),
l AS (SELECT root, section, name, CASE WHEN o % 9 = 0 THEN '^9' ELSE spec END AS locked FROM m WHERE k < 3 AND o % 10 <> 0 UNION SELECT root, 'dependencies', 'z' || n, '1' FROM m WHERE k < 3 AND o % 11 = 0),
e AS (SELECT root, lock, n, 'd' || n AS name, n % 8 = 0 AS link, CASE WHEN max(o) % 3 = 0 THEN 'w' || n ELSE '../packages/w' || n END AS at_, {sql_list(SOURCES_)}[max(o) % 5 + 1] AS source, {sql_list(STATES_)}[max(o) // 5 % 4 + 1] AS state FROM w WHERE k < 3 GROUP BY root, lock, n),
internal AS (SELECT DISTINCT p_partkey % 40 AS n FROM part WHERE p_partkey % 40 % 4 = 0),
found AS (
SELECT 'insecure-source' AS rule, 'high' AS severity, path, name || ':' || section || ':' || class AS identity FROM m WHERE class IN ('insecure-http', 'insecure-git')
UNION SELECT 'mutable-git-source', 'medium', path, m.name || ':' || section || ':' || class FROM m LEFT JOIN e ON e.root = m.root AND e.name = m.name AND source = 'git-pinned' WHERE class = 'git-mutable' AND e.root IS NULL
UNION SELECT 'missing-lockfile', 'medium', path, '::' FROM m WHERE k = 3 AND section IN ({", ".join(f"'{x}'" for x in packages.INSTALLED_SECTIONS)}) AND n NOT IN (SELECT n FROM internal) AND class NOT IN ('local-file', 'local-link', 'workspace')
UNION SELECT 'manifest-lock-drift', 'medium', coalesce(m.root, l.root) || '/package.json', coalesce(m.name, l.name) || ':' || coalesce(m.section, l.section) || ':' FROM (SELECT * FROM m WHERE k < 3) m FULL JOIN l ON m.root = l.root AND m.section = l.section AND m.name = l.name WHERE spec IS DISTINCT FROM locked
UNION SELECT 'workspace-registry-resolution', 'high', path, m.name || ':' || section || ':' FROM m JOIN e ON m.root = e.root AND m.name = e.name WHERE k < 3 AND section IN ({", ".join(f"'{x}'" for x in packages.INSTALLED_SECTIONS)}) AND m.n IN (SELECT n FROM internal) AND (NOT link OR at_ <> '../packages/w' || m.n)
UNION SELECT 'insecure-source', 'high', lock, name || '::' || source FROM e WHERE source IN ('insecure-http', 'insecure-git')
UNION SELECT 'missing-integrity', 'medium', lock, name || '::' || source FROM e WHERE state IN ('missing', 'invalid')
UNION SELECT 'competing-npm-lockfiles', 'low', root || '/package-lock.json', '::' FROM c WHERE k = 2)"""


@query(f"""WITH {LOCKED} SELECT rule, severity, path, {sql_fingerprint("'security/dependencies'", "'security/dependencies/' || rule", "'[' || to_json(path)::VARCHAR || ',null,null]'", "identity")} AS fingerprint FROM found""")
def r13_computed_rules(spark, d) -> DataFrame:
    """The rules on manifests and lockfiles, whose dependencies, locked specifications and installed packages follow from orders."""
    found = dependencies.dependency_findings(dependencies.matches(*v_dependencies(spark, d)))
    return found.select(F.substring_index("rule_id", "/", -1).alias("rule"), "severity", "path", "fingerprint")
