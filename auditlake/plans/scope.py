"""Changed scope: which projects a change reaches, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators.closures import shortest_paths
from auditlake.operators.ownership import owned


def relevant_paths(changes: DataFrame) -> DataFrame:
    """path: where a change is, and for renames where it was."""
    old = changes.where("status = 'renamed' and previous_path is not null").select(F.col("previous_path").alias("path"))
    return changes.select("path").unionByName(old).distinct()


def reverse_edges(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependency, consumer, name over package names that one project has; limitations (value))."""
    node = projects.where(F.array_contains("ecosystems", "node")).withColumn("n", F.coalesce(F.trim("package_name"), F.lit("")))
    names = node.where("n <> ''").groupBy("n").agg(F.min("id").alias("dependency"), F.count(F.lit(1)).alias("c"), F.array_sort(F.collect_list("id")).alias("ids"))
    wanted = projects.select(F.col("id").alias("consumer"), F.explode("dependency_names").alias("d")).select("consumer", F.trim("d").alias("name"))
    edges = wanted.join(names.where("c = 1").select(F.col("n").alias("name"), "dependency"), "name").where("dependency <> consumer").select("dependency", "consumer", "name").distinct()
    bare = node.where("n = ''").select(F.concat(F.lit('Node project "'), "id", F.lit('" has no valid package name; it cannot be identified as an internal dependency target.')).alias("value"))
    blind = node.where("n <> '' and dependency_names is null").select(F.concat(F.lit('Node project "'), "id", F.lit('" ('), "n", F.lit(") has unavailable dependency metadata; reverse workspace dependency relationships may be incomplete.")).alias("value"))
    twice = names.where("c > 1").select(F.concat(F.lit('Package name "'), "n", F.lit('" is declared by multiple projects: '), F.array_join("ids", ", "), F.lit("; dependency propagation for that name was skipped.")).alias("value"))
    return edges, bare.unionByName(blind).unionByName(twice)


def changed_scope(changes: DataFrame, projects: DataFrame, impact: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(project_id, reason, source; limitations (value)).

    Direct changes and root context come first; changed nested manifests reach every Node project not yet affected; then
    workspace dependents, each once, through the first project that reaches it; then source dependents of the impact
    (path, project_id, dependency_path). No change, no reason and no limitation.
    """
    paths = relevant_paths(changes)
    context = paths.where(P.is_root_context(F.col("path")))
    ids = projects.select(F.col("id").alias("project_id"))
    root = context.crossJoin(ids).select("project_id", F.lit("root-context").alias("reason"), F.col("path").alias("source"))
    direct = owned(paths.where(~P.is_root_context(F.col("path"))), projects).where("project_id is not null").select("project_id", F.lit("direct-change").alias("reason"), F.col("path").alias("source"))
    # A changed root file is a reason of every project, so these rows are the result and not a by-product; Spark chooses the side by its size.
    seeds = direct.unionByName(root).distinct()
    manifests = paths.where(F.endswith("path", F.lit("/package.json")))
    untouched = projects.where(F.array_contains("ecosystems", "node")).select(F.col("id").alias("project_id")).join(seeds, "project_id", "left_anti")
    stale = untouched.crossJoin(manifests).select("project_id", F.lit("workspace-dependent").alias("reason"), F.col("path").alias("source"))
    first = seeds.unionByName(stale)
    edges, notes = reverse_edges(projects)
    reached = shortest_paths(first.select(F.col("project_id").alias("node")).distinct(), edges.select(F.col("dependency").alias("source"), F.col("consumer").alias("target")), None).where("level > 0")
    by = reached.select(F.col("node").alias("consumer"), F.get("path", F.size("path") - 2).alias("dependency")).join(edges, ["consumer", "dependency"]).groupBy("consumer").agg(F.min("name").alias("name"))
    named = by.join(projects.select(F.col("id").alias("consumer"), F.coalesce(F.nullif(F.trim("package_name"), F.lit("")), F.col("id")).alias("own")), "consumer")
    dependents = named.select(F.col("consumer").alias("project_id"), F.lit("workspace-dependent").alias("reason"), F.concat("name", F.lit(" -> "), "own").alias("source"))
    out = first.unionByName(dependents)
    if impact is not None:
        shown = impact.where("project_id is not null").groupBy("project_id").agg(F.min_by(F.array_join("dependency_path", " -> "), "path").alias("source"))
        out = out.unionByName(shown.join(ids, "project_id", "left_semi").select("project_id", F.lit("source-dependent").alias("reason"), "source"))
    some = changes.agg((F.count(F.lit(1)) > 0).alias("some"))
    stale_note = manifests.select(F.concat("path", F.lit(": previous Node package identity and dependency metadata are unavailable; Node workspace scope was conservatively expanded.")).alias("value"))
    return out.distinct(), notes.unionByName(stale_note).distinct().join(F.broadcast(some)).where("some").drop("some")
