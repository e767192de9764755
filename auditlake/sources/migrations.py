"""SQL migration streams of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.operators.ownership import owned_or_first

# Folders that hold migrations, below a project's root.
ROOTS = ("database/migrations", "db/migrations", "drizzle", "migrations", "prisma/migrations", "supabase/migrations")
FALLBACK = "schema.sql"


def streams(files: DataFrame, projects: DataFrame) -> DataFrame:
    """stream_id, project_id, root, files (in order): a stream for each migration folder of each project; a project's
    schema.sql only where none of its folders holds a migration. The deepest project owns a file."""
    base = projects.select("id", "root")
    alone = files.sparkSession.createDataFrame([("root", ".")], "id string, root string").join(base.agg(F.count(F.lit(1)).alias("n")).where("n = 0")).select("id", "root")
    base = base.unionByName(alone)
    sql = owned_or_first(files.where("kind = 'file'").where(F.endswith(F.lower("path"), F.lit(".sql"))).select("path"), base)
    rows = sql.join(base.select(F.col("id").alias("project_id"), F.col("root").alias("home")), "project_id")
    hit = None
    for r in reversed(ROOTS):
        at = P.at_root(F.col("home"), F.lit(r))
        hit = F.when(F.startswith("path", F.concat(at, F.lit("/"))), at) if hit is None else F.when(F.startswith("path", F.concat(at, F.lit("/"))), at).otherwise(hit)
    rows = rows.withColumn("root", hit)
    found = rows.where("root is not null")
    single = rows.where(F.col("path") == P.at_root(F.col("home"), F.lit(FALLBACK))).join(found.select("project_id").distinct(), "project_id", "left_anti").withColumn("root", F.col("path"))
    both = found.unionByName(single)
    return both.groupBy("project_id", "root").agg(F.min("home").alias("home"), F.array_sort(F.collect_set("path")).alias("files")).select(F.concat("project_id", F.lit(":"), P.relative(F.col("home"), F.col("root"))).alias("stream_id"), "project_id", "root", "files")


def identity(paths: DataFrame, current: DataFrame, projects: DataFrame, former_schema: bool = False) -> DataFrame:
    """path, stream_id of SQL paths, gone ones too: a current stream, else a migration folder of the owning project, else of a
    folder that looks like a project, else (for history) a schema.sql."""
    sql = paths.select("path").where(F.endswith(F.lower("path"), F.lit(".sql"))).distinct()
    up = sql.select("path", F.explode(P.ancestors(F.col("path"))).alias("root")).join(current.select("root", "stream_id"), "root").groupBy("path").agg(F.min("stream_id").alias("now"))
    own = owned_or_first(sql, projects.select("id", "root")).join(projects.select(F.col("id").alias("project_id"), F.col("root").alias("home")), "project_id", "left")
    inside = F.when(F.col("home") == ".", F.col("path")).when(F.startswith("path", F.concat("home", F.lit("/"))), P.relative(F.col("home"), F.col("path")))
    folder = F.regexp_extract(inside, "^(" + "|".join(ROOTS) + ")/", 1)
    by_depth = sorted(ROOTS, key=lambda r: (-r.count("/"), r))
    guess = None
    for r in reversed(by_depth):
        head = F.regexp_extract("path", f"^(.+)/{r}/", 1)
        one = F.when(head != "", F.concat(F.lit("project:"), head, F.lit(f":{r}")))
        guess = one if guess is None else F.coalesce(one, guess)
    former = F.when(F.rlike("path", F.lit(r"(?:^|/)schema\.sql\z")), F.concat(P.project_id(P.dirname(F.col("path"))), F.lit(":schema.sql"))) if former_schema else F.lit(None).cast("string")
    known = F.when(folder != "", F.concat("project_id", F.lit(":"), folder))
    return own.join(up, "path", "left").select("path", F.coalesce("now", known, guess, former).alias("stream_id")).where("stream_id is not null")
