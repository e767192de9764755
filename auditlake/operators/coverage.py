"""Coverage: status lattices, module roll-ups and the nine audit domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.core import STATUS_PRIORITY, ranked
from auditlake.functions.packages import is_ai_dependency

# Fixed values.
DOMAINS = ("repository", "validation", "frontend", "backend", "database", "security", "infrastructure", "performance", "ai")
FRONTEND, BACKEND = ("nextjs", "react", "vite"), ("nestjs",)


def status_of(status: Column) -> Column:
    """Aggregate: failed, else partial, else partial again for completed beside anything withheld, else the gravest; nothing: not-applicable."""
    has = lambda *s: F.coalesce(F.bool_or(status.isin(*s)), F.lit(False))
    mixed = has("completed") & has("unsupported", "skipped", "not-selected")
    top = F.coalesce(F.max_by(status, ranked(status, STATUS_PRIORITY, 0)), F.lit("not-applicable"))
    return F.when(has("failed"), "failed").when(has("partial") | mixed, "partial").otherwise(top)


def domain_of(doctor: Column) -> Column:
    head = F.split_part(doctor, F.lit("/"), F.lit(1))
    return F.when(doctor == "project", "repository").when(doctor == "checks", "validation").when(head.isin(*DOMAINS), head)


def module_coverage(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """module_id, domain, status, scopes, limitations of each module run (doctor_id, status, error, skip_reason)."""
    rolled = coverage.groupBy(F.col("module_id").alias("doctor_id")).agg(
        status_of(F.col("status")).alias("_status"), F.array_sort(F.collect_set("scope")).alias("scopes"), F.array_distinct(F.flatten(F.collect_list("limitations"))).alias("_l")
    )
    own = F.when(F.col("status").isin("failed", "skipped"), F.col("status")).otherwise(F.coalesce("_status", F.lit("completed")))
    none = F.array().cast("array<string>")
    said = F.array_compact(F.array("skip_reason", "error"))
    joined = runs.join(rolled, "doctor_id", "left")
    return joined.select(
        F.col("doctor_id").alias("module_id"), domain_of(F.col("doctor_id")).alias("domain"), own.alias("status"), F.coalesce("scopes", none).alias("scopes"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("_l", none), said))).alias("limitations"),
    )


def infrastructure(path: Column) -> Column:
    low = F.lower(path)
    named = lambda *n: F.rlike(low, F.lit("(?:^|/)(?:" + "|".join(n) + r")\z"))
    return (
        F.when(named("dockerfile") | F.endswith(low, F.lit(".dockerfile")), "docker")
        .when(F.startswith(low, F.lit(".github/workflows/")) & F.rlike(low, F.lit(r"\.ya?ml\z")), "github-actions")
        .when(named(r"vercel\.json"), "vercel")
        .when(named(r"railway\.json", r"railway\.toml"), "railway")
    )


def evidence(projects: DataFrame, files: DataFrame) -> DataFrame:
    """domain, type, value, path, project_id: frameworks, infrastructure files and AI dependencies, each once."""
    null = F.lit(None).cast("string")
    frameworks = projects.select("id", F.explode("frameworks").alias("f")).select(
        F.when(F.lower("f").isin(*FRONTEND), "frontend").when(F.lower("f").isin(*BACKEND), "backend").alias("domain"), F.lit("framework").alias("type"), F.lower("f").alias("value"), null.alias("path"), F.col("id").alias("project_id")
    )
    infra = files.select(F.lit("infrastructure").alias("domain"), F.lit("file").alias("type"), infrastructure(F.col("path")).alias("value"), "path", null.alias("project_id"))
    ai = projects.select("id", F.explode("dependency_names").alias("d")).where(is_ai_dependency(F.col("d"))).select(F.lit("ai").alias("domain"), F.lit("dependency").alias("type"), F.col("d").alias("value"), null.alias("path"), F.col("id").alias("project_id"))
    return frameworks.where("domain is not null").unionByName(infra.where("value is not null")).unionByName(ai).distinct()


def domain_coverage(spark: SparkSession, modules: DataFrame, found: DataFrame, plans: DataFrame, database: bool = True) -> DataFrame:
    """domain, position, applicability, status, coverage_complete, n_evidence, limitations: always nine rows.

    modules: module_coverage(); found: evidence(); plans: planned checks.
    """
    base = spark.createDataFrame([(d, i) for i, d in enumerate(DOMAINS)], "domain string, position int")
    rolled = modules.where("domain is not null").groupBy("domain").agg(
        status_of(F.col("status")).alias("s"), F.count(F.lit(1)).alias("m"), F.bool_or(F.col("status").isin("completed", "partial", "failed")).alias("ran"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("limitations")))).alias("l"),
    )
    seen = found.groupBy("domain").agg(F.count(F.lit(1)).alias("e"))
    planned = plans.agg(F.count(F.lit(1)).alias("p"))
    j = base.join(F.broadcast(rolled), "domain", "left").join(F.broadcast(seen), "domain", "left").join(F.broadcast(planned))
    d, s = F.col("domain"), F.coalesce("s", F.lit("not-applicable"))
    semantic = d.isin("frontend", "backend", "infrastructure", "ai")
    has = F.coalesce("e", F.lit(0)) > 0
    no_security = (d == "security") & F.col("m").isNull()
    status = (
        F.when(semantic, F.when(has, "unsupported").otherwise("not-applicable"))
        .when((d == "performance") | no_security, "unsupported")
        .when(d == "validation", F.when(F.col("p") > 0, s).otherwise("not-applicable"))
        .when(d == "database", s if database else F.lit("not-selected"))
        .otherwise(s)
    )
    applicability = (
        F.when(d == "repository", "detected")
        .when(d == "validation", F.when(F.col("p") > 0, "detected").otherwise("not-detected"))
        .when(semantic, F.when(has, "detected").otherwise("not-detected"))
        .when(d == "database", F.when(F.coalesce("ran", F.lit(False)), "detected").otherwise("unknown"))
        .when((d == "performance") | no_security, "unknown")
        .otherwise(F.when(s == "not-applicable", "not-detected").otherwise("detected"))
    )
    complete = F.when(d == "repository", status == "completed").when(semantic, ~has).otherwise(status.isin("completed", "not-applicable"))
    none = F.array().cast("array<string>")
    said = lambda text: F.array(F.lit(text))
    limits = (
        F.when(semantic & has, F.array(F.concat(F.initcap(d), F.lit(" evidence was detected, but semantic analysis is not implemented."))))
        .when(semantic, none)
        .when(d == "performance", said("Performance applicability and semantic analysis are not implemented."))
        .when(no_security, said("General security applicability and semantic analysis are not implemented."))
        .when((d == "database") & F.lit(not database), said("The repository-only scan command does not select database audit modules."))
        .when((d == "validation") & (F.col("p") == 0), none)
        .otherwise(F.coalesce("l", none))
    )
    return j.select("domain", "position", applicability.alias("applicability"), status.alias("status"), complete.alias("coverage_complete"), F.coalesce("e", "m", F.lit(0)).alias("n_evidence"), limits.alias("limitations"))


def in_changed_scope(domains: DataFrame, found: DataFrame, changes: DataFrame, affected: DataFrame) -> DataFrame:
    """domain_coverage() rows under a changed scope: domains without changed or affected evidence become not-selected.

    The paths that copies came from count here, unlike in scope planning.
    """
    paths = changes.select("path").unionByName(changes.where("previous_path is not null").select(F.col("previous_path").alias("path"))).distinct()
    hit = found.join(paths, "path", "left_semi").select("domain").unionByName(found.join(affected.select("project_id"), "project_id", "left_semi").select("domain")).distinct().withColumn("_hit", F.lit(True))
    some = changes.agg((F.count(F.lit(1)) > 0).alias("_c")).join(affected.agg((F.count(F.lit(1)) > 0).alias("_a")))
    d = F.col("domain")
    selected = (
        F.when(d.isin("repository", "database"), F.lit(True))
        .when(d == "validation", F.col("applicability") == "detected")
        .when(d.isin("security", "performance"), F.col("_c") | F.col("_a"))
        .otherwise(F.coalesce("_hit", F.lit(False)))
    )
    out = ~(selected | F.col("status").isin("not-selected", "not-applicable"))
    note = F.array(F.lit("This domain was outside the selected changed scope."))
    j = domains.join(F.broadcast(hit), "domain", "left").join(F.broadcast(some)).withColumn("_out", out)
    return j.withColumns({
        "status": F.when(F.col("_out"), "not-selected").otherwise(F.col("status")), "coverage_complete": ~F.col("_out") & F.col("coverage_complete"),
        "limitations": F.when(F.col("_out"), F.array_sort(F.array_union("limitations", note))).otherwise(F.col("limitations")),
    }).drop("_hit", "_c", "_a", "_out")
