"""One job over many repositories: the modules of a scan on relations that carry repo_id.

Every join, budget, cap and limitation holds within a repository. Contents are read on executors by the modules that need them, each
for its own files; the driver sees no path and no text. Repositories that can't be listed are named in the coverage of `inventory`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions.core import SEVERITIES, severity_rank
from auditlake.operators import findings, integrity, projects, secrets
from auditlake.operators.lineage import cut
from auditlake.sources import configs, files, repositories

#: Limitations that a coverage row names.
NOTES = 100


@dataclass
class Fleet:
    files: DataFrame
    projects: DataFrame
    workspaces: DataFrame
    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    coverage: DataFrame

    def summary(self) -> DataFrame:
        """repo_id with a count for each severity, total and the highest, for repositories that have findings."""
        counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
        return self.findings.groupBy("repo_id").agg(*counts, F.count(F.lit(1)).alias("total"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest"))


def covered(module: str, examined: DataFrame, notes: DataFrame, most: int = NOTES) -> DataFrame:
    """repo_id, module_id, status, files_examined, limitations (the first by text), limitations_total; examined: repo_id of each file examined."""
    n = examined.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_examined"))
    rows = notes.select("repo_id", "value").distinct()
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("repo_id").orderBy("value"))).where(F.col("_r") <= most)
    first = ranked.groupBy("repo_id").agg(F.array_sort(F.collect_list("value")).alias("limitations"))
    said = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("limitations_total")).join(first, "repo_id")
    out = n.join(said, "repo_id", "full_outer")
    status = F.when(F.col("limitations_total") > 0, "partial").otherwise("completed")
    return out.select("repo_id", F.lit(module).alias("module_id"), status.alias("status"), F.coalesce("files_examined", F.lit(0)).alias("files_examined"),
                      F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"), F.coalesce("limitations_total", F.lit(0)).alias("limitations_total"))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, only: list[str] | None = None, max_files: int = files.FILES, max_depth: int = files.DEPTH, partitions: int = 64) -> Fleet:
    """Inventory, projects, source graph, missing targets and secrets of all repositories below root, or of those named in `only`."""
    return audit(*repositories.inventory(repositories.listed(spark, root, exclude, only, max_depth, partitions), max_files), repositories.reader(root))


def audit(listed: DataFrame, problems: DataFrame, read) -> Fleet:
    """The same of given inventories; read: a function that adds content to chosen files (repo_id, path)."""
    regular = listed.where("kind = 'file'")
    named = lambda *names: regular.where(P.basename(F.col("path")).isin(*names))
    manifests = cut(files.manifests(listed, read(named("package.json"))))
    found = cut(projects.detect(listed, manifests))
    spaces = cut(projects.workspaces(manifests, found))
    # A configuration may inherit from any JSON file beside it.
    aliases, alias_notes = configs.alias_configs(listed, read(regular.where(F.endswith("path", F.lit(".json")))))
    ignored, big = files.ignore_prefixes(listed, read(named(".gitignore").where(F.col("size") <= files.IGNORE_BYTES)))
    nodes, edges, _, notes = integrity.build_graph(listed, read, found, manifests, cut(aliases), ignored)
    nodes, edges, notes = cut(nodes), cut(edges), cut(notes.unionByName(alias_notes).unionByName(big))
    shared = secrets.shareable(listed, None)
    leaks, said = secrets.audit(shared, read, regular.where(P.is_certificate_candidate(F.col("path"))))
    everything = findings.union(projects.structural_findings(found, listed, manifests, spaces), integrity.integrity_findings(edges), leaks)
    coverage = covered("inventory", listed, problems.select("repo_id", F.col("problem").alias("value")))
    for module, examined, limits in (("repository/source-graph", nodes, notes), (integrity.DOCTOR, nodes, notes), (secrets.DOCTOR, shared, said)):
        coverage = coverage.unionByName(covered(module, examined, limits))
    return Fleet(listed, found, spaces, nodes, edges, cut(everything), cut(coverage))
