"""Guidance of findings on row-level security."""

import shlex

import pytest
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.functions import guidance
from auditlake.operators import rls, sqlrls


@pytest.fixture(scope="module")
def catalog(spark):
    table = lambda name, on, force: ("it's", name, "owner", on, force, False, 1)
    policy = lambda t, name, command, using, check: ("it's", t, name, command, True, ["public"], using, check)
    frame = lambda rows, name: spark.createDataFrame(rows, S.CATALOG[name])
    return {
        "tables": frame([table("open", False, False), table("shut", False, False), table("bare", True, False), table('quo"ted', True, True)], "tables"),
        "policies": frame([policy('quo"ted', f'p {c}"', c, "true", "true") for c in ("SELECT", "INSERT", "UPDATE", "DELETE", "ALL")] + [policy('quo"ted', "none", "INSERT", None, None)], "policies"),
        "relation_privileges": frame([("it's", "open", "o", "anon", "SELECT", False), ("it's", "open", "o", "anon", "TRUNCATE", False)], "relation_privileges"),
        "default_privileges": frame([("it's", "owner", "anon", "table", "SELECT", False)], "default_privileges"),
        "roles": frame([("anon", False, True, True)], "roles"), "memberships": frame([], "memberships"),
    }


@pytest.fixture(scope="module")
def found(catalog):
    return rls.catalog_findings(catalog, ("it's", "b")).collect()


def test_every_rule_has_guidance_of_its_own(found):
    rules = {r["rule_id"].removeprefix(rls.DOCTOR + "/") for r in found}
    assert rules == {*guidance.RULES} - {"write-policy-unconditional-check"}
    for r in found:
        g = guidance.RULES[r["rule_id"].removeprefix(rls.DOCTOR + "/")]
        assert r["impact"] == g.impact and r["remediation_constraints"] == [g.keep, guidance.live_constraint(("it's", "b"))]
        assert shlex.split(r["verification"]["command"]) == ["auditlake", "audit", ".", "--database-schema", "it's", "--database-schema", "b", "--with-database", "--json"]
        assert "it's, b" in r["verification"]["expected"]


def test_sql_is_suggested_by_rule_command_and_quoted_names(found):
    sql = {}
    for r in found:
        rule, _, text = r["rule_id"].removeprefix(rls.DOCTOR + "/"), *r["remediation"].partition("\n\nSuggested SQL:\n")[1:]
        sql.setdefault(rule, {})[r["message"]] = text.splitlines()
    quoted = '"it\'s"."quo""ted"'
    assert sql["rls-disabled-exposed"].popitem()[1][0] == 'alter table "it\'s"."open" enable row level security;'
    assert [*sql["force-rls-disabled"].values()] == [['alter table "it\'s"."bare" force row level security;']]
    assert [x for x in sql["rls-enabled-no-policies"].values()][0][1:3] == ['create policy "read own bare"', '  on "it\'s"."bare"']
    assert {*map(len, sql["reachable-truncate"].values())} == {0} and {*map(len, sql["multiple-permissive-policies"].values())} == {0}
    own = "((select auth.uid()) = <owner_column>)"
    ends = {"INSERT": [f"  with check {own};"], "DELETE": [f"  using {own};"], "UPDATE": [f"  using {own}", f"  with check {own};"], "ALL": [f"  using {own}", f"  with check {own};"]}
    for command, end in ends.items():
        lines = next(v for k, v in sql["public-unconditional-write"].items() if f'p {command}"' in k)
        assert lines[1:] == [f'alter policy "p {command}"""', f"  on {quoted}", "  to authenticated", *end]
    assert all(v[-1] == "  using (<public_read_predicate>);" for v in sql["public-unconditional-read"].values())
    assert [v[-1] for v in sql["write-policy-missing-check"].values()] == [f"  with check {own};"]
    advice = {r["message"].split('"')[1]: r["remediation"].splitlines()[0] for r in found if r["rule_id"].endswith("public-unconditional-write")}
    assert advice["p INSERT"] == guidance.WRITES["INSERT"] and advice["p DELETE"] == guidance.WRITES["DELETE"] and advice["p ALL"] == guidance.RULES["public-unconditional-write"].advice


def test_static_rules_have_guidance(spark):
    text = "create table t (id int);\ngrant select, truncate on t to anon;\ncreate table u (id int);\nalter table u enable row level security;\ncreate policy p on u for all to public using (true);"
    ops, _ = sqlrls.operations(spark.createDataFrame([("s", ["a.sql"])], "stream_id string, files array<string>"), spark.createDataFrame([("a.sql", text)], S.CONTENTS))
    rows = sqlrls.static_findings(sqlrls.replay(ops)).collect()
    assert len({r["rule_id"] for r in rows}) >= 5
    for r in rows:
        g = guidance.RULES[r["rule_id"].removeprefix(sqlrls.DOCTOR + "/")]
        assert (r["impact"], r["remediation_constraints"], r["remediation"]) == (g.impact, [g.keep], g.advice)


def test_usage_is_not_multiplied(spark):
    """Many schemas and many roles: contexts of schemas that are open to all are looked up without their schema."""
    n = 400
    frame = lambda rows, name: spark.createDataFrame(rows, S.CATALOG[name])
    members = [(f"r{i + 1}", f"r{i}", True, True) for i in range(0, 40)] + [("r0", "anon", True, True), ("r3", "r9", True, True)]
    catalog = {
        "tables": frame([(f"s{i}", "t", "o", False, False, False, 1) for i in range(n)], "tables"), "policies": frame([], "policies"),
        "relation_privileges": frame([(f"s{i}", "t", "o", f"r{i % 60}", "SELECT", False) for i in range(n)], "relation_privileges"), "default_privileges": frame([], "default_privileges"),
        "schema_privileges": frame([(f"s{i}", "o", "PUBLIC" if i % 2 else f"r{i % 7}", "USAGE", False) for i in range(n)], "schema_privileges"),
        "roles": frame([(f"r{i}", False, False, True) for i in range(60)], "roles"), "memberships": frame(members, "memberships"),
    }
    graph = rls.RoleGraph(catalog)
    everyone, own = rls.schema_usage(graph, catalog["tables"], catalog["schema_privileges"])
    assert everyone.count() == n // 2 and own.select("schema").distinct().count() == n // 2
    out = {r["schema"]: r["phrase"] for r in rls.exposure(catalog["tables"], catalog["relation_privileges"], graph, (everyone, own), ("SELECT",)).where(F.col("phrase").isNotNull()).collect()}
    # anon reaches r0 .. r40 by SET ROLE and inheritance; all of them may use each schema.
    assert {*out} == {f"s{i}" for i in range(n) if i % 60 <= 40}
    assert not any(x in own._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_narrowed_roles_change_no_finding(spark, found, catalog):
    """Roles that nothing connects to the audited tables go, with their memberships."""
    more = spark.createDataFrame([(f"x{i}", False, True, True) if i == 0 else (f"x{i}", False, False, True) for i in range(5)], S.CATALOG["roles"])
    links = spark.createDataFrame([("x2", "x1", True, True), ("x4", "x3", True, True), ("x1", "x0", True, True)], S.CATALOG["memberships"])
    wide = catalog | {"roles": catalog["roles"].unionByName(more), "memberships": catalog["memberships"].unionByName(links)}
    kept = rls.narrowed(wide)
    # x0 may bypass policies, so what it reaches stays; x3 and x4 go.
    assert {r["name"] for r in kept["roles"].collect()} == {"anon", "x0", "x1", "x2"} and kept["memberships"].count() == 2
    assert sorted(r["fingerprint"] for r in rls.catalog_findings(kept, ("it's", "b")).collect()) == sorted(r["fingerprint"] for r in found)
