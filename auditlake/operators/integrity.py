"""The source graph and its missing import targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions.core import evidence, findings, json_list
from auditlake.functions.imports import source_imports
from auditlake.operators.closures import first_edges
from auditlake.operators.findings import first_of_each, running_budget
from auditlake.operators.lineage import cut, repo_key, with_content
from auditlake.operators.ownership import owned
from auditlake.operators.resolution import resolve

DOCTOR, RULE, MOST = "repository/source-integrity", "source/import-target-missing", 1_000
FILE_BYTES, TOTAL_BYTES, EDGES = 1_048_576, 52_428_800, 100_000


def select_sources(files: DataFrame, each: int = FILE_BYTES, total: int = TOTAL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(supported files within the byte budgets; limitations (value))."""
    k = repo_key(files)
    rows = files.where(P.is_source(F.col("path")))
    links = rows.where("kind = 'symlink'").select(*k, F.concat("path", F.lit(": source symlink was not read.")).alias("value"))
    sized = running_budget(rows.where("kind = 'file'"), each, total)
    big = sized.where("oversize").select(*k, F.concat("path", F.lit(f": source file exceeds the {each}-byte limit.")).alias("value"))
    stop = sized.where("not oversize and not within").groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(*k, F.lit(f"Source selection stopped at the {total}-byte total limit.").alias("value"))
    return sized.where("within").select(*k, "path", "size"), links.unionByName(big).unionByName(stop)


def build_graph(files: DataFrame, contents, projects: DataFrame, manifests: DataFrame, configs: DataFrame, ignored: DataFrame | None = None):
    """(nodes, edges, boundaries, limitations): selection, imports, resolution, first edge of each key, ownership."""
    k = repo_key(files)
    chosen, notes = select_sources(files)
    # Every file is read and its tokens are cut once.
    read = cut(with_content(chosen, contents).select(*k, "path", source_imports("path", "content").alias("s")))
    nodes = owned(chosen.select(*k, "path"), projects)
    found = read.select(*k, "path", F.explode("s.imports").alias("i")).select(*k, "path", "i.*")
    resolved = cut(resolve(found, files, projects, manifests, configs, ignored))
    edges = first_edges(resolved.where("outcome = 'internal'"), EDGES).select(*k, "importer_path", "target_path", "kind", "target_exists", "missing_target_proof", "line", "col")
    external, dynamic = resolved.groupBy(*k).agg(F.count_if(F.col("outcome") == "external").alias("external")), read.groupBy(*k).agg(F.coalesce(F.sum("s.dynamic"), F.lit(0)).alias("dynamic"))
    boundaries = dynamic.join(external, k, "left").na.fill(0, ["external"]) if k else external.join(dynamic)
    broken = read.where("not s.parsed").select(*k, F.concat("path", F.lit(": source syntax could not be parsed.")).alias("value"))
    limits = notes.unionByName(broken).unionByName(resolved.where("limitation is not null").select(*k, F.col("limitation").alias("value"))).distinct()
    return nodes, edges, boundaries, limits


def provably_missing(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("target_exists") & F.col("missing_target_proof").isNotNull())


def edge_order():
    return ["importer_path", "target_path", "kind", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0))]


def integrity_findings(edges: DataFrame, selected: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Missing targets of the selected importers (all of them without a selection), the first `most` in edge order."""
    rows, k = provably_missing(edges), repo_key(edges)
    if selected is not None:
        rows = rows.join(selected.select(*k, F.col("path").alias("importer_path")).distinct(), [*k, "importer_path"], "left_semi")
    rows = first_of_each(rows, k, edge_order(), most)
    detail = F.concat(F.lit("Expected "), "target_path", F.lit(" ("), "kind", F.lit(", "), "missing_target_proof", F.lit(")."))
    return findings(
        rows, rule=F.lit(RULE), doctor=F.lit(DOCTOR), severity=F.lit("high"), confidence=F.lit("high"), category="correctness", title=F.lit("An import points to no file"),
        message=F.lit("A statically resolved import names an internal file that the inventory does not have."), evidence=F.array(evidence("file", detail, F.col("importer_path"))),
        identity=json_list(F.col("target_path"), F.col("kind"), F.col("missing_target_proof")), path=F.col("importer_path"), line=F.col("line"), col=F.col("col"),
        impact=F.lit("Type checks, builds or runtime loading may fail here."), remediation=F.lit("Restore the target or correct the import."),
    )
