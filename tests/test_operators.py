"""Operators on literal rows: catalogs, lockfiles, configurations, streams, git output."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake import schemas as S
from auditlake.operators import coverage, dependencies, findings, ownership, projects, rls, secrets, sqlrls
from auditlake.plans.scope import changed_scope
from auditlake.sources import catalog, configs, git, locks, migrations
from auditlake.streaming import replay


def catalog_frames(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), ddl) for k, ddl in S.CATALOG.items()}


def test_catalog_rules(spark):
    c = catalog_frames(
        spark, tables=[("public", "a", "boss", False, False, False, 1), ("public", "b", "boss", True, False, False, 1), ("public", "c", "boss", True, True, False, 1)],
        relation_privileges=[("public", "a", "boss", "reader", "SELECT", False), ("public", "b", "boss", "PUBLIC", "TRUNCATE", False)], schema_privileges=[("public", "boss", "anon", "USAGE", False)],
        policies=[("public", "b", "p1", "ALL", True, ["public"], None, None), ("public", "b", "p2", "SELECT", True, ["anon"], "x = 1", None), ("public", "b", "p3", "UPDATE", False, ["staff"], "x", "x")],
        default_privileges=[(None, "boss", "reader", "r", "INSERT", False)], roles=[("reader", False, False, True), ("admin", False, True, True)], memberships=[("reader", "anon", True, False), ("admin", "authenticated", False, True)],
    )
    rows = rls.catalog_findings(c).collect()
    got = sorted(f"{r['rule_id'].split('/')[-1]}:{r['severity']}" for r in rows)
    assert got == sorted([
        "rls-disabled-exposed:high", "reachable-truncate:high", "rls-enabled-no-policies:medium", "force-rls-disabled:info", "public-unconditional-read:high", "public-unconditional-write:critical", "write-policy-missing-check:medium",
        "public-permissive-policy:low", "public-permissive-policy:low", "multiple-permissive-policies:medium", "broad-default-table-privilege:high", "rls-bypass-role:high",
    ])
    said = {r["rule_id"].split("/")[-1]: r["message"] for r in rows}
    assert "Application role anon reaches reader through inherited membership and can exercise SELECT granted to reader" in said["rls-disabled-exposed"]
    assert "through SET ROLE. Role admin has BYPASSRLS" in said["rls-bypass-role"]
    assert {r["name"] for r in rls.relevant_roles(c).collect()} >= {"anon", "reader", "boss", "admin", "authenticated"}


def test_catalog_rules_do_not_depend_on_row_order(spark):
    c = catalog_frames(spark, tables=[("s", f"t{i}", "o", i % 2 == 0, i % 3 == 0, False, 1) for i in range(12)], relation_privileges=[("s", f"t{i}", "o", r, "SELECT", False) for i in range(12) for r in ("anon", "PUBLIC")])
    c["schema_privileges"] = None
    a = sorted(r["fingerprint"] for r in rls.catalog_findings(c).collect())
    d = {k: v if v is None else v.orderBy(F.rand(3)).repartition(5) for k, v in c.items()}
    assert a == sorted(r["fingerprint"] for r in rls.catalog_findings(d).collect()) and a


def test_catalog_types(spark):
    raw = {k: [] for k in catalog.RAW} | {"policies": [("s", "t", "p", "merge", "PERMISSIVE", '{anon,"x"}', None, None)], "relation_privileges": [("s", "t", "o", 0, None, "select", False)]}
    t = catalog.frames(spark, raw)
    assert t["policies"].select("command", "permissive", "roles").first()[:] == ("ALL", True, ["anon", "x"])
    assert t["relation_privileges"].select("grantee", "privilege").first()[:] == ("PUBLIC", "SELECT")
    old = catalog.legacy_memberships(spark.createDataFrame([("r", "m")], "role string, member string"), spark.createDataFrame([("r", False, False, True), ("m", False, False, False)], S.CATALOG["roles"]))
    assert old.first().asDict() == {"role": "r", "member": "m", "inherit_option": False, "set_option": True}


def test_catalog_connection_is_closed_on_errors():
    log = []

    class Connection:
        def cursor(self):
            return self

        def execute(self, sql, args=()):
            log.append(sql.split()[0])
            if sql.startswith("show"):
                raise RuntimeError("gone")

        def close(self):
            log.append("close")

    with pytest.raises(RuntimeError):
        catalog.fetch(Connection, ["public"])
    assert log[-2:] == ["rollback", "close"]


def test_static_sql_rules(spark):
    sql = """create table a (x int); alter table a enable row level security; create policy p on a for delete to authenticated using (x = 1);
create policy q on a to anon; create policy r on a for select to public using (true); grant truncate on a to anon; create table b (x int); grant insert on b to "Public"; create table d (x int); drop table d; grant all on b to anon;"""
    streams = spark.createDataFrame([("s", ["m.sql"])], "stream_id string, files array<string>")
    ops, troubles = sqlrls.operations(streams, spark.createDataFrame([("m.sql", sql)], S.CONTENTS))
    got = sorted(r["rule_id"].split("/")[-1] for r in sqlrls.static_findings(sqlrls.replay(ops)).collect())
    assert got == sorted(["reachable-truncate", "force-rls-disabled", "write-policy-unconditional-check", "public-unconditional-read", "public-unconditional-read", "public-unconditional-write", "write-policy-missing-check", "public-permissive-policy", "public-permissive-policy", "multiple-permissive-policies", "rls-disabled-exposed"])
    cover = sqlrls.stream_coverage(ops, troubles).first()
    assert (cover["status"], cover["statements_examined"], cover["statements_recognized"], cover["limitations"]) == ("partial", 11, 10, ["m.sql:2: Unsupported table privilege."])


def test_streams(spark):
    files = spark.createDataFrame([(p, "file", 1) for p in ("supabase/migrations/2.sql", "supabase/migrations/1.sql", "schema.sql", "app/schema.sql", "app/x.sql", "other/prisma/migrations/a/m.sql")], S.FILES)
    roots = spark.createDataFrame([("root", "."), ("project:app", "app")], "id string, root string")
    got = {r["stream_id"]: r["files"] for r in migrations.streams(files, roots).collect()}
    assert got == {"root:supabase/migrations": ["supabase/migrations/1.sql", "supabase/migrations/2.sql"], "project:app:schema.sql": ["app/schema.sql"]}
    gone = spark.createDataFrame([("supabase/migrations/0.sql",), ("app/db/migrations/1.sql",), ("lib/prisma/migrations/x/y.sql",), ("x/schema.sql",), ("a.txt",)], "path string")
    current = migrations.streams(files, roots)
    assert {r["path"]: r["stream_id"] for r in migrations.identity(gone, current, roots, True).collect()} == {
        "supabase/migrations/0.sql": "root:supabase/migrations", "app/db/migrations/1.sql": "project:app:db/migrations", "lib/prisma/migrations/x/y.sql": "project:lib:prisma/migrations", "x/schema.sql": "project:x:schema.sql"}


def test_lockfiles(spark):
    packages = {"": {"dependencies": {"a": "1", "b": "^2"}}, "node_modules/a": {"resolved": "https://r.test/a.tgz", "integrity": "sha512-abc="}, "node_modules/b": {"resolved": "http://r.test/b.tgz"}, "node_modules/c": {"resolved": "packages/c", "link": True}, "node_modules/d": {"resolved": "https://r.test/d.tgz", "integrity": 5}, "../x": {}}
    rows = [(".", json.dumps({"lockfileVersion": 3, "packages": packages})), ("p", "{"), ("q", "[]"), ("r", '{"lockfileVersion": 1}'), ("s", '{"lockfileVersion": 2, "packages": []}'), ("t", '{"lockfileVersion": 2, "packages": {"a": 1}}')]
    states, entries = locks.parse(spark.createDataFrame(rows, "lock_root string, content string"))
    assert {r["lock_root"]: r["status"] for r in states.collect()} == {".": "supported", "p": "invalid", "q": "invalid", "r": "unsupported", "s": "invalid", "t": "invalid"}
    got = {r["path"]: (r["package_name"], r["source_class"], r["integrity"], r["link"], r["resolved_workspace_path"]) for r in entries.collect()}
    assert got == {
        "": (None, "unknown", "not-required", False, None), "node_modules/a": ("a", "secure-https", "valid", False, None), "node_modules/b": ("b", "insecure-http", "not-required", False, None),
        "node_modules/c": ("c", "git-mutable", "not-required", True, "packages/c"), "node_modules/d": ("d", "secure-https", "invalid", False, None)}
    assert entries.where("path = ''").first()["sections"]["dependencies"] == {"a": "1", "b": "^2"}


def test_manifest_sections(spark):
    m = spark.createDataFrame([("package.json", "valid", json.dumps({"dependencies": {"a": "1", "b": 2, "bad name": "1"}, "devDependencies": []}), None)], S.MANIFESTS)
    rows, notes = dependencies.manifest_sections(m)
    assert [tuple(r) for r in rows.collect()] == [("package.json", "dependencies", "a", "1")]
    assert sorted(r["value"] for r in notes.collect()) == ["package.json: invalid dependency entry limits dependency analysis.", "package.json: invalid dependency section limits dependency analysis."]


def test_alias_configs(spark):
    texts = {
        "tsconfig.json": '{// c\n"extends": "./base", "compilerOptions": {"paths": {"@app/*": ["src/*"], "bad*x*": ["y"]}}}', "base.json": '{"compilerOptions": {"baseUrl": "lib", "paths": {"lib/*": ["z/*"]}}}',
        "web/tsconfig.json": '{"extends": "../base.json"}', "web/jsconfig.json": "{}", "loop/tsconfig.json": '{"extends": "./tsconfig.json"}', "pkg/tsconfig.json": '{"extends": "@x/y", "compilerOptions": {"baseUrl": "../.."}}', "no/tsconfig.json": "{"}
    files = spark.createDataFrame([(p, "file", len(t)) for p, t in texts.items()], S.FILES)
    got, notes = configs.alias_configs(files, spark.createDataFrame([*texts.items()], S.CONTENTS))
    rows = {r["path"]: (r["base_path"], [(a["pattern"], a["targets"]) for a in r["aliases"]]) for r in got.collect()}
    assert rows["tsconfig.json"] == ("lib", [("@app/*", ["src/*"])]) and rows["web/tsconfig.json"] == ("lib", [("lib/*", ["z/*"])]) and rows["pkg/tsconfig.json"] == ("pkg", [])
    said = {r["value"].split(": ", 1)[1] for r in notes.collect()}
    assert said == {"both tsconfig.json and jsconfig.json apply; tsconfig.json was selected.", "a source alias mapping is unsupported or unsafe.", "local source configuration inheritance contains a cycle.", "package-based source configuration inheritance is unsupported.", "source configuration baseUrl is unsupported or unsafe.", "source configuration could not be parsed."}


def test_git_parsers(spark):
    assert git.name_status("M\0a\0R100\0b\0c\0D\0d\0") == [("a", "modified", None), ("c", "renamed", "b"), ("d", "deleted", None)]
    for bad in ("M\0a", "X\0a\0", "R101\0a\0b\0", "R5\0a\0", "M\0../a\0"):
        with pytest.raises(git.GitError):
            git.name_status(bad)
    with pytest.raises(git.GitError) as e:
        git.changes(spark, "/tmp", " ")
    assert e.value.code == "invalid-base-ref"
    assert git.shareable(spark, "/tmp", lambda r, a: (_ for _ in ()).throw(OSError()))[0] is None
    assert git.shareable(spark, "/tmp", lambda r, a: "b\0a\0b\0")[0].count() == 2


def test_changed_scope(spark):
    rows = [("root", ".", ["node"], "top", []), ("project:a", "a", ["node"], "a", []), ("project:b", "b", ["node"], "b", ["a"]), ("project:c", "c", ["node"], "c", ["b"]), ("project:d", "d", ["python"], None, None), ("project:e", "e", ["node"], None, None)]
    p = spark.createDataFrame(rows, "id string, root string, ecosystems array<string>, package_name string, dependency_names array<string>")
    change = lambda *c: spark.createDataFrame([*c], S.CHANGES)
    reasons, notes = changed_scope(change(("a/x.ts", "modified", None)), p)
    assert {(r["project_id"], r["reason"], r["source"]) for r in reasons.collect()} == {("project:a", "direct-change", "a/x.ts"), ("project:b", "workspace-dependent", "a -> b"), ("project:c", "workspace-dependent", "b -> c")}
    assert [r["value"] for r in notes.collect()] == ['Node project "project:e" has no valid package name; it cannot be identified as an internal dependency target.']
    reasons, notes = changed_scope(change(("go.mod", "added", None)), p)
    assert reasons.where("reason = 'root-context'").count() == 6
    reasons, notes = changed_scope(change(("d/n.py", "renamed", "a/package.json")), p)
    assert reasons.where("source = 'a/package.json' and reason = 'workspace-dependent'").count() == 4
    reasons, notes = changed_scope(change(), p)
    assert reasons.count() == notes.count() == 0


def test_nearest_manager_and_python_ownership(spark):
    p = spark.createDataFrame([(".", "root", "pnpm", ["node"]), ("web", "project:web", None, ["node"]), ("web/ui", "project:web/ui", None, ["python"]), ("web/py", "project:web/py", "yarn", ["python"])], "root string, id string, package_manager string, ecosystems array<string>")
    files = spark.createDataFrame([("web/package-lock.json", "file", 1), ("web/py/a/test_x.py", "file", 1), ("web/ui/b.py", "file", 1), ("c.py", "file", 1)], S.FILES)
    got = {r["id"]: r["manager"] for r in ownership.effective_manager(p, files).collect()}
    # The root counts as deep as `web`, and `.` sorts first.
    assert got == {"root": "pnpm", "project:web": "npm", "project:web/ui": "pnpm", "project:web/py": "yarn"}
    assert {tuple(r) for r in ownership.python_owned(files, p).collect()} == {("web/py/a/test_x.py", "project:web/py"), ("web/ui/b.py", "project:web/ui")}
    plans = projects.python_checks(p, files, 5).collect()
    assert [(r["plan_id"], r["executable"], r["args"]) for r in plans] == [("project:web/py:python:pytest", "python", ["-m", "pytest"])]


def test_empty_inputs_still_give_rows(spark):
    none = spark.createDataFrame([], S.FINDINGS)
    assert findings.summary(none).first()["total"] == 0 and findings.exit_code(none, spark.createDataFrame([], S.RUNS), "info") == 0
    modules = coverage.module_coverage(spark.createDataFrame([("project", "completed", 0, 0, None, None), ("security/secrets", "skipped", 0, 0, None, "denied")], S.RUNS), spark.createDataFrame([], S.COVERAGE))
    shown = coverage.evidence(spark.createDataFrame([], S.PROJECTS), spark.createDataFrame([], S.FILES))
    rows = {r["domain"]: (r["status"], r["applicability"], r["coverage_complete"]) for r in coverage.domain_coverage(spark, modules, shown, spark.createDataFrame([], "plan_id string")).collect()}
    assert len(rows) == 9 and rows["repository"] == ("completed", "detected", True) and rows["security"] == ("skipped", "detected", False) and rows["performance"] == ("unsupported", "unknown", False) and rows["ai"] == ("not-applicable", "not-detected", True)


def test_no_value_column_in_findings(spark):
    assert not {"value", "content", "spec", "raw"} & {*spark.createDataFrame([], S.FINDINGS).columns}
    rows = secrets.matches(spark.createDataFrame([("a", "password = 'Zx81-Pq47-Lm02-Vb33'"), ("b", "\0password = 'Zx81-Pq47-Lm02-Vb33'")], S.CONTENTS))
    assert [r["path"] for r in rows.collect()] == ["a"] and "Zx81" not in str(secrets.secret_findings(rows).collect())


def scripts():
    """(rows of operations, final tables by a plain fold) of random scripts of all nine kinds of operations, two tables a stream."""
    import random

    from auditlake.functions import sqltext
    from tests.replay_model import replayed

    draw, rows, want = random.Random(4), [], {}
    forms = [
        "create table {t} (a int)", "drop table {t}", "alter table {t} enable row level security", "alter table {t} disable row level security", "alter table {t} force row level security", "create policy {p} on {t} for select to a, b using (x = {n})",
        "create policy {p} on {t} as restrictive with check (y = {n})", "alter policy {p} on {t} to c", "alter policy {p} on {t} using (z = {n})", "alter policy {p} on {t} with check (w)", "drop policy {p} on {t}", "grant select, insert on {t} to a, b",
        "revoke insert on {t} from a", "grant truncate on {t} to c", "revoke select on {t} from b, c", "select 1",
    ]
    for k in range(60):
        ops = []
        for n in range(draw.randrange(1, 25)):
            sql = draw.choice(forms).format(t=draw.choice("tu"), p=draw.choice("pq"), n=n)
            op = dict.fromkeys(sqlrls.OPERATION_FIELDS) | {"using_known": False, "check_known": False} | sqltext.read_statement(sql)
            ops.append((op, {"path": f"m{n // 10}.sql", "line": n}))
            rows.append((f"s{k}", f"m{n // 10}.sql", n // 10, n % 10, n, tuple(op[c] for c in sqlrls.OPERATION_FIELDS)))
        want |= {(f"s{k}", t["schema"], t["name"]): t for t in replayed(ops)}
    return rows, want


OPERATIONS = f"stream_id string, path string, position int, ordinal int, line int, op {S.OPERATION}"


def test_replay_equals_a_plain_fold(spark):
    rows, want = scripts()
    got = {(r["stream_id"], r["schema"], r["name"]): r.asDict(recursive=True) for r in sqlrls.replay(spark.createDataFrame(rows, OPERATIONS)).collect()}
    assert got.keys() == want.keys() and len(got) > 80
    for key, state in want.items():
        assert {k: v for k, v in got[key].items() if k != "stream_id"} == state, key


def test_registers_take_operations_in_any_order():
    import random

    rows, want = scripts()
    fields = [c for c in sqlrls.OPERATION_FIELDS]
    for seed in range(3):
        tables = {}
        for stream, path, position, ordinal, line, op in random.Random(seed).sample(rows, len(rows)) + rows[:50]:
            op = dict(zip(fields, op)) | {"seq": (position << 32) + ordinal, "path": path, "line": line}
            if op["kind"] in ("ignored", "unsupported-relevant"):
                continue
            flags, policies, grants = tables.setdefault((stream, op["schema"], op["name"]), ({}, {}, {}))
            replay.apply_to_table(flags, op)
            if op["kind"].endswith("policy"):
                replay.apply_to_policy(policies.setdefault(op["policy"], {}), op)
            elif op["kind"] in ("grant", "revoke"):
                for held in ((p, r) for p in op["privileges"] for r in op["roles"]):
                    grants[held] = replay.newer(grants.get(held), op["seq"], op["kind"], [path, line])
        for key, (flags, policies, grants) in tables.items():
            for p in policies.values():
                replay.void(p, flags.get("cleared", -1))
            grants = {k: g for k, g in grants.items() if g[0] > flags.get("cleared", -1)}
            assert {k: v for k, v in replay.row(key, flags, policies, grants).items() if k != "stream_id"} == want[key], key
        assert tables.keys() == want.keys()


def test_stream_and_batch_agree_in_shuffled_order(spark, tmp_path):
    """The whole input of t1 and random scripts, in four triggers and in no order: the last state of each table is the batch's."""
    from auditlake import catalogue

    rows, _ = scripts()
    both = catalogue.v_operations(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame(rows, OPERATIONS))
    flat = replay.sequenced(both).withColumn("part", (F.rand(3) * 4).cast("int")).orderBy(F.rand(7))
    flat.repartition("part").write.partitionBy("part").parquet(str(tmp_path / "all"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.PROVIDER)
    try:
        schema, names = flat.drop("part").schema, []
        for k in range(4):
            spark.read.parquet(str(tmp_path / "all")).where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

        def keep(frame, number):
            frame.withColumn("trigger", F.lit(number)).write.mode("append").parquet(str(tmp_path / "out"))
            names.append(number)

        q = replay.replay_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert len(names) >= 4
    batch = {(r["stream_id"], r["schema"], r["name"]): r.asDict(recursive=True) for r in sqlrls.replay(both).collect()}
    states = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["trigger"]):
        states[r["stream_id"], r["schema"], r["name"]] = {k: v for k, v in r.asDict(recursive=True).items() if k != "trigger"}
    assert states == batch


def test_positions_are_those_of_one_sort(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("a"), (F.col("id") % 3).alias("b"))
    got = [(r["position"], r["b"], r["a"]) for r in findings.positions(rows, [F.col("b").desc(), F.col("a")]).collect()]
    assert [r[1:] for r in sorted(got)] == sorted(((r[1], r[2]) for r in got), key=lambda r: (-r[0], r[1])) and sorted(r[0] for r in got) == [*range(1, 1001)]
    assert findings.positions(rows.where("false"), [F.col("a")]).count() == 0
