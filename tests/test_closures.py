"""Closures against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import closures


def brute(seeds, edges):
    """node -> (shortest path, the smallest among equals)."""
    out, front = {s: [s] for s in seeds}, {s: [s] for s in seeds}
    while front:
        step = {}
        for node, path in front.items():
            for a, b in edges:
                if a == node and b not in out:
                    step[b] = min(step.get(b, [*path, b]), [*path, b])
        out |= step
        front = step
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_shortest_paths(spark, kind):
    draw = random.Random(5)
    as_ = (lambda x: x) if kind == "bigint" else (lambda x: f"n{x}/é{x % 3}")
    for n, m in ((8, 12), (40, 70), (60, 200)):
        edges = [(as_(draw.randrange(n)), as_(draw.randrange(n))) for _ in range(m)]
        edges += edges[:5]
        seeds = [as_(x) for x in (0, 1, n + 3, 0)]
        got = closures.shortest_paths(spark.createDataFrame([(s,) for s in seeds], f"node {kind}"), spark.createDataFrame(edges, f"source {kind}, target {kind}"))
        want = brute(seeds, edges)
        assert {r["node"]: r["path"] for r in got.collect()} == want and all(r["level"] == len(r["path"]) - 1 for r in got.collect())
    # The nearest are kept, then those with the smallest path.
    few = closures.shortest_paths(spark.createDataFrame([(s,) for s in seeds], f"node {kind}"), spark.createDataFrame(edges, f"source {kind}, target {kind}"), 7).collect()
    order = sorted((len(p), p) for p in want.values() if len(p) > 1)[:7]
    assert sorted(r["path"] for r in few if r["level"]) == sorted(p for _, p in order)


def test_reachable_and_component(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(55)]
    frame = spark.createDataFrame(edges, "source bigint, target bigint")
    got = {(r["start"], r["node"]) for r in closures.reachable(spark.createDataFrame([(1,), (2,), (99,)], "start bigint"), frame).collect()}
    assert got == {(s, n) for s in (1, 2, 99) for n in brute([s], edges)}
    got = [r["node"] for r in closures.component(spark.createDataFrame([(3,), (3,)], "node bigint"), frame).collect()]
    assert sorted(got) == sorted(brute([3], edges + [(b, a) for a, b in edges]))
    empty = spark.createDataFrame([], "node bigint")
    assert closures.shortest_paths(empty, frame).count() == closures.component(empty, frame).count() == 0
    assert closures.shortest_paths(spark.createDataFrame([(3,)], "node bigint"), frame.where("false")).collect() == [(3, [3], 0)]


def test_a_long_chain_is_written_in_proportion(spark):
    """The table has a row for each node and no path; doublings rebuild the paths. A level takes about 0.7 s here, so the chain is kept short."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        n = 64
        edges = spark.range(n).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
        table, deepest = closures._grown(spark.createDataFrame([(0,)], "node bigint"), edges, closures.LEVELS)
        assert deepest == n and table.all().count() == n + 1
        paths = closures.paths_of(table.all(), deepest).collect()
        assert all(r["path"] == list(range(r["node"] + 1)) for r in paths) and len(paths) == n + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_levels_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """The driver builds what is broadcast: a level, and what was seen, stay away from it once they have more rows than the bound."""
    monkeypatch.setattr(closures, "BROADCAST", 8, raising=False)
    plans, append = [], closures.Levels.append

    def spied(self, rows, level, *order):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return append(self, rows, level, *order)

    monkeypatch.setattr(closures.Levels, "append", spied)
    edges = spark.range(80).select(F.floor(F.col("id") / 2).alias("source"), F.col("id").alias("target"))
    got = closures.component(spark.createDataFrame([(1,)], "node bigint"), edges)
    assert sorted(r["node"] for r in got.collect()) == list(range(80))
    joins = [p.count("BroadcastHashJoin") for p in plans[1:]]
    # Levels of 1, 3, 4, 8, 16 and 32 rows; 1, 4, 8, 16, 32 and 64 were seen.
    assert joins[:6] == [2, 2, 2, 1, 0, 0] and all("SortMergeJoin" in p for p in plans[4:7])


def test_source_impact_goes_as_deep_as_its_sql(spark, tmp_path):
    """Beyond 3 * 2^13 documents files are reached by paths of more than 14 nodes, which the SQL leaves out; it has no limit on visits."""
    import duckdb

    from auditlake import catalogue

    spark.range(51_000).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["g1_source_impact"](spark, str(tmp_path)).select("node", "path", "level").collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(f"select node, path, level from ({catalogue.ORACLE['g1_source_impact']})").fetchall())
    assert max(r[2] for r in want) == 13 and got == want
