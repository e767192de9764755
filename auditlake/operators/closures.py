"""Transitive closures as level-synchronous joins over an append-only table of levels.

A level is written once, with the parent through which each node was reached first, and never again; paths are rebuilt at the end by
doubling the pointers to parents. What is written is so in proportion to the nodes (and to the paths that are returned).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators.findings import first_of_each
from auditlake.operators.lineage import cut, repo_key, shared_dir

VISITS, LEVELS = 100_000, 10_000
#: Rows up to which a level, or all of them, are broadcast. Spark would go by the size of the files, in which a sorted column of keys takes
#: a fraction of its memory.
BROADCAST = 50_000


class Levels:
    """Rows (keys, parent, level) in the shared folder, appended level by level, each in the order of its ranks.

    A row's rank in its level is its place in the files: the number of the file, then that of the row.
    """

    def __init__(self, spark: SparkSession, keys: list[T.StructField], parent: T.DataType):
        self.spark, self.root = spark, f"{shared_dir(spark)}/auditlake/levels-{uuid.uuid4().hex[:12]}"
        self.schema = T.StructType([*keys, T.StructField("parent", parent), T.StructField("level", T.IntegerType())])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files, self.path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
        self.files.deleteOnExit(path)

    def append(self, rows: DataFrame, level: int, *order: str) -> int:
        """The number of rows."""
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("level", F.lit(level))
        placed.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.option("maxRecordsPerFile", "0").parquet(f"{self.root}/{level}")
        return self.at(level).count()

    def at(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{level}").select("*", rank().alias("rank"))

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root).select("*", rank().alias("rank"))

    def drop(self) -> None:
        self.files.delete(self.path, True)


def rank() -> Column:
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def _bounded(side: DataFrame, rows: int) -> DataFrame:
    """The side of a join, which is broadcast only if its rows are few; else both sides are merged, which spills and never meets the driver."""
    return F.broadcast(side) if rows <= BROADCAST else side.hint("merge")


def _grown(seeds: DataFrame, edges: DataFrame, levels: int) -> tuple[Levels, int]:
    """(levels of what seeds reach over edges (source, target), the last level). seeds: node, and whatever it is reached for.

    Among the parents of the level before, the one of the least rank counts, and ranks follow the parent's rank and then the node: they
    are in the order of the paths, element by element, although no path is written.
    """
    spark, keys = seeds.sparkSession, seeds.columns
    table = Levels(spark, [T.StructField(f.name, f.dataType) for f in seeds.schema], seeds.schema["node"].dataType)
    rows = table.append(seeds.distinct().withColumn("parent", F.lit(None)), 0, *keys)
    # Dealt by source and sorted once, so that a level shuffles its frontier and not the edges.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = edges.select(F.col("source").alias("parent"), F.col("target").alias("_to")).distinct().repartition(parts, "parent").sortWithinPartitions("parent").persist()
    level, seen = 0, rows
    while level < levels:
        front = _bounded(table.at(level).drop("parent").withColumnRenamed("node", "parent"), rows)
        step = front.join(near, "parent").groupBy(*[F.col("_to").alias(k) if k == "node" else F.col(k) for k in keys]).agg(F.min(F.struct("rank", "parent")).alias("_b"))
        new = step.join(_bounded(table.all().select(*keys), seen), keys, "left_anti").select(*keys, "_b.*")
        rows = table.append(new, level + 1, "rank", *keys)
        if not rows:
            break
        level, seen = level + 1, seen + rows
    near.unpersist()
    return table, level


def paths_of(tree: DataFrame, deepest: int) -> DataFrame:
    """tree (node, parent, level; no parent is null but a seed's) with path, from the seed to the node: pointers are doubled, each round the paths grow twofold."""
    rows = cut(tree.select("node", "level", F.col("parent").alias("_up"), F.array("node").alias("path")))
    reach = 1
    while reach <= deepest:
        above = rows.select(F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_head"))
        longer = F.concat(F.coalesce("_head", F.array_repeat("node", F.lit(0))), "path")
        rows = cut(rows.join(above, "_up", "left").select("node", "level", F.col("_next").alias("_up"), longer.alias("path")))
        reach *= 2
    return rows.select("node", "path", "level")


def shortest_paths(seeds: DataFrame, edges: DataFrame, visits: int | None = VISITS, levels: int = LEVELS) -> DataFrame:
    """node, path, level: for every node reachable from seeds (node) over edges (source, target), its shortest path from a
    seed, the smallest element by element among equals. Seeds have level 0. Cycles end by themselves. At most `visits`
    other nodes are kept, nearest first and then by path."""
    table, deepest = _grown(seeds.select("node"), edges, levels)
    found = table.all()
    if visits is not None and table.all().where("level > 0").count() > visits:
        # A path's nodes are nearer than its end, so the first rows hold their own parents.
        found = found.where("level = 0").unionByName(found.where("level > 0").orderBy("level", "rank").limit(visits))
    out = paths_of(found, deepest)
    table.drop()
    return out


def reachable(starts: DataFrame, edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """start, node: everything that each start reaches over edges (source, target), itself included."""
    table, _ = _grown(starts.select("start", F.col("start").alias("node")), edges, levels)
    return table.all().select("start", "node")


def component(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node: all nodes connected to a seed, whatever the edges' direction."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    table, _ = _grown(seeds.select("node"), both, 2**31 - 1)
    return table.all().select("node")


def impact_seeds(changes: DataFrame, supported) -> DataFrame:
    """node: changed supported paths, and for renames the path they had."""
    old = changes.where("status = 'renamed' and previous_path is not null").select(F.col("previous_path").alias("node"))
    return changes.select(F.col("path").alias("node")).unionByName(old).where(supported(F.col("node"))).distinct()


def source_impact(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, visits: int = VISITS) -> DataFrame:
    """path, project_id, dependency_path, level of every file that a changed file reaches through its importers, untruncated."""
    found = shortest_paths(seeds, edges.select(F.col("target_path").alias("source"), F.col("importer_path").alias("target")), visits)
    owners = nodes.select(F.col("path").alias("node"), "project_id")
    return found.where("level > 0").join(owners, "node", "left").select(F.col("node").alias("path"), "project_id", F.col("path").alias("dependency_path"), "level")


def reported(impact: DataFrame, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(the first rows by path, one row of total and omitted counts)."""
    top = impact.orderBy("path", F.array_join("dependency_path", "\0")).limit(most)
    counts = impact.agg(F.count(F.lit(1)).alias("impacted_files"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return top, counts


def first_edges(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """The first edge of each (importer, target, kind, exists), by ordinal; at most `most` of them (of each repository) in source order."""
    k = repo_key(edges)
    w = W.partitionBy(*k, "importer_path", "target_path", "kind", "target_exists").orderBy("ordinal", "line", "col")
    one = edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first_of_each(one, k, ["importer_path", "ordinal"], most)
