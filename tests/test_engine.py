"""Whole scans of small repositories."""

import json
import subprocess
import time

import pytest

from auditlake import cli
from auditlake.plans import engine, reports
from auditlake.sources import catalog, commands
from auditlake.sources import files as sources

TOKEN = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1L2"


def write(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


TREE = {
    "package.json": json.dumps({"name": "top", "packageManager": "npm@10", "workspaces": ["packages/*", "apps/none"], "scripts": {"test": "x", "lint": "y"}, "dependencies": {"lib": "1.0.0", "left": "http://example.test/left.tgz"}}),
    "package-lock.json": json.dumps({"lockfileVersion": 3, "packages": {
        "": {"dependencies": {"lib": "1.0.0"}}, "packages/lib": {}, "node_modules/lib": {"resolved": "packages/lib", "link": True},
        "node_modules/x": {"resolved": "https://registry.test/x.tgz"}}}),
    "yarn.lock": "", "packages/lib/package.json": json.dumps({"name": "lib", "main": "index.ts"}), "packages/lib/index.ts": "export const a = 1;\n",
    "src/app.ts": "import { a } from './util';\nimport './gone.ts';\nimport lib from 'lib';\nimport fs from 'node:fs';\nconst x = import(name);\n",
    "src/util.ts": "export * from './deep/more';\n", "src/deep/more.ts": "export const b = 2;\n", "bad/package.json": "{", "settings.txt": f"token = {TOKEN}\n",
    "supabase/migrations/001.sql": "create table t (id int);\ngrant select on t to anon;\ncreate policy p on t for delete to authenticated using (id = 1);\n",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    write(root, TREE)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    return root, git


@pytest.fixture(scope="module")
def audited(spark, repository):
    return engine.audit(spark, engine.Request(str(repository[0])))


def test_full_audit(audited):
    rules = {r["rule_id"] for r in audited.findings.collect()}
    assert rules == {
        "repository/conflicting-lockfiles", "repository/invalid-manifest", "repository/missing-workspace", "repository/no-visible-tests", "source/import-target-missing",
        "security/secrets/provider-token", "security/dependencies/manifest-lock-drift", "security/dependencies/insecure-source", "security/dependencies/missing-integrity",
        "database/sql-rls/rls-disabled-exposed",
    }
    runs = {r["doctor_id"]: r["status"] for r in audited.runs.collect()}
    assert runs["checks"] == runs["database/rls"] == "skipped" and "failed" not in runs.values()
    assert audited.exit_code("high") == 1 and audited.exit_code("none") == 0


def test_reports(audited, spark, tmp_path):
    data = json.loads(reports.to_json(audited))
    assert data["summary"]["total"] == len(data["findings"]) and len(data["domainCoverage"]) == 9 and TOKEN not in json.dumps(data)
    assert [p["planId"] for p in data["plannedChecks"]] == ["root:javascript:test", "root:javascript:lint"]
    sarif = json.loads(reports.to_sarif(audited))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == data["summary"]["total"]
    assert TOKEN not in (text := reports.to_text(audited)) and "10 findings" in text
    path = tmp_path / "base.json"
    path.write_text(reports.to_json(audited))
    audited.with_baseline(sources.baseline(spark, str(path)))
    assert audited.exit_code("high") == 0
    audited.comparison = None


def test_changed_scope(spark, repository):
    root, git = repository
    (root / "src/deep/more.ts").write_text("export const b = 3;\n")
    result = engine.scan(spark, engine.Request(str(root), changed=True))
    impact = {r["path"]: r["dependency_path"] for r in result.snapshot["impact"].collect()}
    assert impact == {"src/util.ts": ["src/deep/more.ts", "src/util.ts"], "src/app.ts": ["src/deep/more.ts", "src/util.ts", "src/app.ts"]}
    assert {(r["project_id"], r["reason"]) for r in result.snapshot["reasons"].collect()} == {("root", "direct-change"), ("root", "source-dependent")}
    assert any(r["rule_id"] == "source/import-target-missing" for r in result.findings.collect())
    git("checkout", "-q", "--", ".")


def test_failing_module_is_recorded(spark, repository):
    def fail(snapshot):
        raise RuntimeError("broken")

    result = engine.scan(spark, engine.Request(str(repository[0])), modules=[engine.Function("project", fail)])
    assert result.runs.first()["status"] == "failed" and result.exit_code("none") == 2


def test_command_line(capsys):
    with pytest.raises(SystemExit):
        cli.main(["scan", "--base", "main"])
    with pytest.raises(SystemExit):
        cli.main(["audit", ".", "--json", "--format", "text"])
    assert cli.schemas([" a ", "a", "b", ""]) == ("a", "b") and cli.schemas(None) == ("public",)
    capsys.readouterr()


class Catalog:
    """A database that answers the catalog's queries, and remembers what became of the transaction."""

    def __init__(self):
        self.said, self.closed = [], False

    def cursor(self):
        return self

    def execute(self, sql, parameters=()):
        self.said.append(sql)

    def fetchone(self):
        return ("170002",)

    def fetchall(self):
        rows = {
            "tables": [("public", "t", "boss", False, False, False, 1)], "policies": [], "relation_privileges": [("public", "t", "boss", 5, "anon", "SELECT", False)], "schema_privileges": [("public", "boss", 0, None, "USAGE", False)],
            "default_privileges": [], "roles": [("anon", False, False, True)], "memberships": [],
        }
        return rows[next(k for k, v in catalog.QUERIES.items() if v == self.said[-1])]

    def close(self):
        self.closed = True


def test_command_line_reads_a_database(repository, capsys, monkeypatch):
    monkeypatch.setenv("DATABASE_URL", "postgres://me:hidden-word@db.test/x")
    database, seen = Catalog(), []
    args = ["audit", str(repository[0]), "--with-database", "--json", "--fail-on", "none"]
    assert cli.main(args, connect=lambda at: seen.append(at) or database) == 0
    report = json.loads(capsys.readouterr().out)
    assert "database/rls/rls-disabled-exposed" in {f["ruleId"] for f in report["findings"]} and database.closed and database.said[-1] == "commit" and seen == ["postgres://me:hidden-word@db.test/x"]

    def refuse(at):
        raise RuntimeError(f"can't reach {at}")

    assert cli.main(args, connect=refuse) == 2
    out = capsys.readouterr().out
    assert "hidden-word" not in out and "can't reach" in out


def test_planned_checks_are_run(spark, tmp_path):
    plans = spark.createDataFrame(
        [("p:1", "p", "one", "sh", ["-c", "echo $CI $SECRET_TOKEN; exit 3"], ".", 5000, 0), ("p:2", "p", "two", "sh", ["-c", "sleep 60 & sleep 60"], ".", 300, 1), ("p:3", "p", "three", "no-such-program", [], ".", 5000, 2), ("p:4", "p", "four", "sh", ["-c", "yes | head -c 100000; echo hush-hush"], ".", 5000, 3)],
        "plan_id string, project_id string, label string, executable string, args array<string>, cwd string, timeout_ms int, position int",
    )
    import os

    began = time.monotonic()
    runs = {r["label"]: r for r in commands.run_plans(spark, str(tmp_path), plans, {"PATH": os.environ["PATH"], "SECRET_TOKEN": "hush-hush"}).collect()}
    assert {k: (r["status"], r["exit_code"]) for k, r in runs.items() if k != "two"} == {"one": ("failed", 3), "three": ("skipped", None), "four": ("passed", 0)}
    assert runs["two"]["status"] == "timed-out" and runs["two"]["timed_out"] and time.monotonic() - began < 20
    assert runs["one"]["output"].strip() == "1" and len(runs["four"]["output"]) <= commands.OUTPUT


def test_checks_module_runs_plans(spark, repository):
    request = engine.Request(str(repository[0]), run_checks=True)
    result = engine.scan(spark, request, modules=[m for m in engine.modules_for(request) if m.id == "checks"])
    runs = result.snapshot["check_runs"].collect()
    assert {r["plan_id"] for r in runs} == {"root:javascript:test", "root:javascript:lint"}
    assert result.runs.first()["status"] == "completed"


def test_no_limitation_is_lost(spark):
    many = spark.range(engine.NOTES + 5).selectExpr("concat('note ', id) as value")
    row = engine.covered(spark, "m", "s", 1, many).first()
    assert len(row["limitations"]) == engine.NOTES + 1 and row["limitations"][-1].startswith("5 additional limitations")


def test_many_ignore_rules_hold(spark, tmp_path):
    """Every ignore rule counts, however many there are."""
    write(tmp_path, {".gitignore": "\n".join(f"out{i}/" for i in range(10_500)), "src/a.ts": "import '../out9999/gone.ts';\nimport './lost.ts';\n", "package.json": "{}"})
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    s = engine.take_snapshot(spark, engine.Request(str(tmp_path)))
    proofs = {r["target_path"]: r["missing_target_proof"] for r in s["edges"].collect()}
    assert proofs == {"out9999/gone.ts": None, "src/lost.ts": "relative-explicit"}


def test_reports_written_by_executors(spark, audited, repository, tmp_path):
    """The same documents as those made on the driver; a failed attempt leaves the earlier one."""
    from pyspark.sql import functions as F

    from auditlake.plans import export

    at = str(tmp_path / "report")
    audited.comparison = None
    export.write_sarif(audited, at)
    assert json.loads(open(at).read()) == json.loads(reports.to_sarif(audited))
    export.write_json(audited, at)
    assert json.loads(open(at).read()) == json.loads(reports.to_json(audited))
    assert [p.name for p in tmp_path.iterdir()] == ["report"]
    broken = audited.findings.select(F.when(F.col("severity") == "high", F.raise_error(F.lit("lost"))).otherwise("1").alias("item"))
    with pytest.raises(Exception):  # noqa: B017
        export.write_list(broken, at, "[", "]")
    assert json.loads(open(at).read()) == json.loads(reports.to_json(audited)) and [p.name for p in tmp_path.iterdir()] == ["report"]
    paths = spark.createDataFrame([("a b/ç*~+%/x(1).ts",)], "p string").select(export.uri(F.col("p"))).first()[0]
    from urllib.parse import quote

    assert paths == "/".join(quote(x, safe="") for x in "a b/ç*~+%/x(1).ts".split("/"))
    export.write_list(spark.createDataFrame([], "item string"), at, "[", "]")
    assert json.loads(open(at).read()) == []


def test_many_findings_are_written_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from auditlake.functions import core
    from auditlake.plans import export

    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("i"))
    many = core.findings(rows, rule=F.concat(F.lit("r/"), (F.col("i") % 9).cast("string")), doctor=F.lit("d"), severity=F.get(F.array(*map(F.lit, core.SEVERITIES)), (F.col("i") % 5).cast("int")), confidence=F.lit("high"), category="c", title=F.lit("t"),
                         message=F.lit('say "it"\n'), evidence=F.array(core.evidence("observation", F.lit("d"))), identity=F.col("i").cast("string"), path=F.concat(F.lit("p"), F.col("i").cast("string")))
    at = str(tmp_path / "many.json")
    export.write_list(export.sarif_results(many), at, "[", "]")
    found = json.loads(open(at).read())
    ranks = [{"error": 2, "warning": 1, "note": 0}[f["level"]] for f in found]
    assert len(found) == 100_000 and ranks == sorted(ranks, reverse=True) and len({f["partialFingerprints"]["auditlake/v1"] for f in found}) == 100_000


def test_runs_count_their_findings_and_text_shows_limitations(audited):
    counts = {r["doctor_id"]: r["finding_count"] for r in audited.runs.collect()}
    by = {r["doctor_id"]: r["count"] for r in audited.findings.groupBy("doctor_id").count().collect()}
    assert sum(counts.values()) == sum(by.values()) and counts["security/secrets"] == by["security/secrets"] and counts["checks"] == 0
    text = reports.to_text(audited)
    assert f"security/secrets: completed, {counts['security/secrets']} findings" in text and "Limitations" in text
