"""Many repositories in one job give what each gives alone."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.operators import findings, integrity, projects, secrets
from auditlake.plans import fleet
from auditlake.sources import configs, files, repositories
from tests.test_engine import TOKEN, write

TREES = {
    "alias": {
        "tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["lib/*"], "one": ["lib/a.ts"]}}}), "lib/a.ts": "export {}", "lib/b/index.tsx": "export const v = <p>it's</p>;",
        "src/x.ts": "import '@app/a';\nimport '@app/b';\nimport 'one';\nimport '@app/none';\nimport './y';\nimport './y.js'", "src/y.ts": "import react from 'react'", "src/z.test.ts": "",
    },
    "spaces": {
        "package.json": json.dumps({"name": "top", "workspaces": ["packages/*"]}), "package-lock.json": "{}", "yarn.lock": "", "packages/a/package.json": json.dumps({"name": "@s/a", "main": "main.ts"}), "packages/a/main.ts": "import b from 'b'",
        "packages/b/package.json": json.dumps({"name": "b", "exports": "./out.js"}), "packages/b/x.ts": "import a from '@s/a'; import './lost.ts'", "nested/one/two.ts": "import c from 'c'",
    },
    # The same names elsewhere: nothing may be resolved in another repository.
    "empty": {"src/x.ts": "import '@app/a';\nimport './y';\nimport b from 'b';\nimport './lost.ts'", "packages/a/none.txt": ""},
    "leaks": {"settings.txt": f"token = {TOKEN}\n", "a/deep/settings.txt": f"x {TOKEN}", ".env": f"token = {TOKEN}", "bad/package.json": "{", "node_modules/x.ts": "import './gone.ts'", "broken.ts": "import './a'; function {"},
    "configured": {".auditlake.json": json.dumps({"exclude": ["skip/**"]}), "skip/a.ts": "import './gone.ts'", "keep/a.ts": "import './gone.ts'"},
    "ignoring": {".gitignore": "out/\n", "src/a.ts": "import '../out/x.ts';\nimport './lost.ts'"},
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("fleet")
    for name, tree in TREES.items():
        write(top / name, tree)
    (top / "leaks" / "link.ts").symlink_to(top / "alias" / "src" / "y.ts")
    write(top / "misconfigured", {".auditlake.json": "{", "a.ts": ""})
    write(top / "deep", {"a/b/c/d/e/f/g/h/i/j.ts": "", "k.ts": f"// {TOKEN}"})
    write(top / "wide", {f"f{i}.txt": "" for i in range(60)})
    (top / "none").mkdir()
    (top / "a file").write_text("no repository")
    return top


@pytest.fixture(scope="module")
def scanned(spark, root):
    return fleet.scan(spark, str(root), max_files=50, max_depth=8)


def rows(frame, repo=None):
    frame = frame if repo is None else frame.where(F.col("repo_id") == repo).drop("repo_id")
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


@pytest.mark.parametrize("name", ["alias", "leaks", "spaces"])
def test_each_repository_as_alone(spark, root, scanned, name):
    patterns = files.config(str(root / name))["exclude"]
    listed = files.inventory(spark, str(root / name), patterns)
    texts = files.contents(spark, str(root / name), [r["path"] for r in listed.where("kind = 'file'").collect()])
    manifests = files.manifests(listed, texts)
    found = projects.detect(listed, manifests)
    spaces = projects.workspaces(manifests, found)
    aliases, _ = configs.alias_configs(listed, texts)
    nodes, edges, _, notes = integrity.build_graph(listed, texts, found, manifests, aliases, files.ignore_prefixes(listed, texts)[0])
    leaks, said = secrets.audit(secrets.shareable(listed, None), texts, texts)
    for mine, theirs in ((scanned.files, listed), (scanned.projects, found), (scanned.workspaces, spaces), (scanned.nodes, nodes), (scanned.edges, edges)):
        assert rows(mine, name) == rows(theirs)
    assert rows(scanned.findings, name) == rows(findings.union(projects.structural_findings(found, listed, manifests, spaces), integrity.integrity_findings(edges), leaks))
    cover = {r["module_id"]: r for r in scanned.coverage.where(F.col("repo_id") == name).collect()}
    assert cover["inventory"]["status"] == "completed" and cover["inventory"]["files_examined"] == listed.count()
    graph = cover["repository/source-graph"] if "repository/source-graph" in cover else None
    values = sorted({r[0] for r in notes.collect()})
    assert (graph["limitations"] if graph else []) == values and (graph["status"] if graph else "completed") == ("partial" if values else "completed")


def test_what_the_repositories_hold(scanned):
    edges = {(r["repo_id"], r["importer_path"], r["target_path"], r["target_exists"]) for r in scanned.edges.collect()}
    assert {e for e in edges if e[0] == "alias"} == {("alias", "src/x.ts", p, t) for p, t in (("lib/a.ts", True), ("lib/b/index.tsx", True), ("lib/none.ts", False), ("src/y.ts", True))}
    assert ("spaces", "packages/b/x.ts", "packages/a/main.ts", True) in edges and ("spaces", "packages/a/main.ts", "packages/b/out.js", False) in edges
    # A missing target without an extension proves nothing; one named in full does.
    assert {e for e in edges if e[0] == "empty"} == {("empty", "src/x.ts", "src/y.ts", False), ("empty", "src/x.ts", "src/lost.ts", False)}
    missing = {(r["repo_id"], r["path"]) for r in scanned.findings.where("rule_id = 'source/import-target-missing'").collect()}
    assert missing == {("spaces", "packages/b/x.ts"), ("empty", "src/x.ts"), ("configured", "keep/a.ts"), ("ignoring", "src/a.ts")}
    assert {(r["repo_id"], r["path"]) for r in scanned.findings.where("doctor_id = 'security/secrets'").collect()} == {("leaks", "settings.txt"), ("leaks", "a/deep/settings.txt")}
    totals = {r["repo_id"]: r["total"] for r in scanned.summary().collect()}
    assert totals["leaks"] == scanned.findings.where("repo_id = 'leaks'").count()


def test_repositories_that_fail_are_named_and_left_out(scanned):
    gone = {r["repo_id"]: r["limitations"] for r in scanned.coverage.where("module_id = 'inventory' and status = 'partial'").collect()}
    assert {*gone} == {"misconfigured", "deep", "wide"} and gone["wide"] == ["the repository has more than 50 files"] and gone["deep"] == ["the repository is deeper than 8 levels"]
    for frame in (scanned.files, scanned.edges, scanned.findings):
        assert not frame.where(F.col("repo_id").isin(*gone)).count()


def test_only_named_repositories_are_listed(spark, root):
    some = repositories.listed(spark, str(root), only=["leaks", "gone"])
    assert {r["repo_id"] for r in some.collect()} == {"leaks"}
    parts = repositories.RepositoryReader({"path": str(root), "partitions": "2", "only": '["leaks"]'}).partitions()
    assert len(parts) == 2 and sorted(u for p in parts for u in p.units) == [("leaks", ""), ("leaks", "a"), ("leaks", "bad")]


def test_thousand_repositories(spark, tmp_path):
    for i in range(1000):
        write(tmp_path / f"r{i:04}", {"src/a.ts": f"import './b';\nimport './gone{i}.ts'", "src/b.ts": "", **({f"src/m{j}.ts": "import './a'" for j in range(300)} if i == 7 else {})})
    out = fleet.scan(spark, str(tmp_path))
    assert out.edges.groupBy("target_exists").count().orderBy("target_exists").collect() == [(False, 1000), (True, 1300)]
    assert out.findings.where("rule_id = 'source/import-target-missing'").select("repo_id").distinct().count() == 1000
    # What the driver lists are names of top-level folders; no task walks much more than its share.
    parts = repositories.RepositoryReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 64 and max(len(p.units) for p in parts) <= 32


def test_budgets_hold_for_each_repository(spark):
    sizes = [(r, f"f{i:04}", "file", 10) for r, n in (("hot", 3000), ("b", 20), ("c", 3)) for i in range(n)]
    listed = spark.createDataFrame(sizes, "repo_id string, path string, kind string, size bigint")
    got = findings.running_budget(listed, 10, 1005).where("within").groupBy("repo_id").agg(F.count("*").alias("n"), F.max("path").alias("last")).collect()
    assert {(r["repo_id"], r["n"], r["last"]) for r in got} == {("hot", 100, "f0099"), ("b", 20, "f0019"), ("c", 3, "f0002")}
