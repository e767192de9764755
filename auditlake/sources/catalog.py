"""PostgreSQL catalog extracts: the queries' relations, from tables extracted beforehand or through a DB-API connection in one transaction."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.functions import rls as R

# Queries of the catalog; %s is the list of schemas.
QUERIES = {
    "tables": "select n.nspname, c.relname, pg_get_userbyid(c.relowner), c.relrowsecurity, c.relforcerowsecurity, c.relkind = 'p', c.reltuples::bigint from pg_class c join pg_namespace n on n.oid = c.relnamespace where c.relkind in ('r', 'p') and n.nspname = any(%s) order by 1, 2",
    "policies": "select schemaname, tablename, policyname, cmd, permissive, roles::text, qual, with_check from pg_policies where schemaname = any(%s) order by 1, 2, 3",
    "relation_privileges": "select n.nspname, c.relname, pg_get_userbyid(a.grantor), a.grantee, pg_get_userbyid(a.grantee), a.privilege_type, a.is_grantable from pg_class c join pg_namespace n on n.oid = c.relnamespace cross join lateral aclexplode(coalesce(c.relacl, acldefault('r', c.relowner))) a where c.relkind in ('r', 'p') and n.nspname = any(%s)",
    "schema_privileges": "select n.nspname, pg_get_userbyid(a.grantor), a.grantee, pg_get_userbyid(a.grantee), a.privilege_type, a.is_grantable from pg_namespace n cross join lateral aclexplode(coalesce(n.nspacl, acldefault('n', n.nspowner))) a where n.nspname = any(%s)",
    "default_privileges": "select n.nspname, pg_get_userbyid(d.defaclrole), a.grantee, pg_get_userbyid(a.grantee), 'r', a.privilege_type, a.is_grantable from pg_default_acl d left join pg_namespace n on n.oid = d.defaclnamespace cross join lateral aclexplode(d.defaclacl) a where d.defaclobjtype = 'r' and (n.nspname is null or n.nspname = any(%s))",
    "roles": "select rolname, rolsuper, rolbypassrls, rolinherit from pg_roles order by 1",
    "memberships": "select r.rolname, m.rolname, a.inherit_option, a.set_option from pg_auth_members a join pg_roles r on r.oid = a.roleid join pg_roles m on m.oid = a.member",
    "memberships_before_16": "select r.rolname, m.rolname, m.rolinherit, true from pg_auth_members a join pg_roles r on r.oid = a.roleid join pg_roles m on m.oid = a.member",
}
RAW = {
    "tables": S.CATALOG["tables"], "roles": S.CATALOG["roles"], "memberships": S.CATALOG["memberships"],
    "policies": "schema string, table string, name string, command string, permissive string, roles string, using_expression string, check_expression string",
    "relation_privileges": "schema string, table string, grantor string, oid bigint, grantee string, privilege string, grantable boolean",
    "schema_privileges": "schema string, grantor string, oid bigint, grantee string, privilege string, grantable boolean",
    "default_privileges": "schema string, owner string, oid bigint, grantee string, object_type string, privilege string, grantable boolean",
}


def fetch(connect: Callable[[], Any], schemas: list[str], timeout_ms: int = 10_000) -> dict[str, list[tuple]]:
    """The raw rows of all queries, in one read-only transaction of one snapshot; rolled back on an error, always closed."""
    connection = connect()
    try:
        cursor = connection.cursor()
        try:
            cursor.execute("begin transaction isolation level repeatable read read only")
            cursor.execute(f"set local statement_timeout = {int(timeout_ms)}")
            cursor.execute("show server_version_num")
            modern = int(cursor.fetchone()[0]) >= 160_000
            out = {}
            for name in RAW:
                sql = QUERIES[name if name != "memberships" or modern else "memberships_before_16"]
                cursor.execute(sql, (schemas,) if "%s" in sql else ())
                out[name] = [tuple(r) for r in cursor.fetchall()]
            cursor.execute("commit")
            return out
        except Exception:
            cursor.execute("rollback")
            raise
    finally:
        connection.close()


def frames(spark: SparkSession, raw: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    return typed({k: spark.createDataFrame(v, RAW[k]) for k, v in raw.items()})


def typed(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw relations with normal roles, commands, grantees and privileges."""
    out = dict(raw)
    who = R.grantee(F.col("oid"), F.col("grantee"))
    if "policies" in raw:
        out["policies"] = raw["policies"].select("schema", "table", "name", R.policy_command(F.col("command")).alias("command"), R.permissive(F.col("permissive")).alias("permissive"), R.policy_roles(F.col("roles")).alias("roles"), "using_expression", "check_expression")
    for k in ("relation_privileges", "schema_privileges", "default_privileges"):
        if k in raw:
            privilege = F.upper("privilege") if k == "schema_privileges" else R.relation_privilege(F.col("privilege"))
            out[k] = raw[k].withColumns({"grantee": who, "privilege": privilege}).drop("oid")
    return out


def legacy_memberships(members: DataFrame, roles: DataFrame) -> DataFrame:
    """Memberships before version 16: a member's own attribute decides on inheritance, SET ROLE is always open."""
    j = members.select("role", "member").join(roles.select(F.col("name").alias("member"), "inherits"), "member").join(roles.select(F.col("name").alias("role")), "role", "left_semi")
    return j.select("role", "member", F.col("inherits").alias("inherit_option"), F.lit(True).alias("set_option"))


def explode_acl(objects: DataFrame, acl: str = "acl") -> DataFrame:
    """A row for each entry of an array of (grantor, oid, grantee, privilege, grantable)."""
    return objects.select(*[c for c in objects.columns if c != acl], F.explode(acl).alias("_a")).select(*[c for c in objects.columns if c != acl], "_a.*")
