"""Findings as a set: union, exact dedupe, order, counts, thresholds, bounding and comparison with a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.core import SEVERITIES, STATUS_PRIORITY, finding_order, ranked, severity_rank
from auditlake.operators.lineage import cut, repo_key

# Reasons that a path may head in a limitation.
PATH_REASONS = (
    "npm lock ownership is unresolved; missing-lockfile analysis was withheld.",
    "private key matched an inventoried localhost-only test certificate; no finding was emitted.",
    "relative source target is covered by a literal ignore rule and may be generated.",
    "relative source target is declared publication output and may require generation.",
    "relative source target is fixture-controlled.",
    "relative source target was not found in the current inventory.",
    "source syntax could not be parsed.",
    "workspace publication target was not found in the current inventory; the entry may require a build.",
    "workspace source target was not found in the current inventory.",
)
ECOSYSTEM_REASON = r"^(?:node:(?:pnpm|yarn|bun)|python|rust|go|java) dependency metadata is not supported\.\z"
RECORDS, SAMPLE_PATHS, INLINE = 200, 5, 100


def union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, each once: whole rows are compared, not fingerprints."""
    return reduce(DataFrame.unionByName, parts).distinct()


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(*finding_order())


def positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """rows with their place, from 1, in an order: places in ranges, after the sizes of the ranges before; rows that tie take any."""
    parted = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))  # a row for each range
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_at", inside).join(start, "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def summary(found: DataFrame) -> DataFrame:
    """One row: a count for each severity, total, and highest (null for no finding)."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return found.agg(*counts, F.count(F.lit(1)).alias("total"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest"))


def reaches(found: DataFrame, threshold: str) -> DataFrame:
    """One row, reached: whether a finding is at or above the threshold; `none` is never reached."""
    if threshold == "none":
        return found.agg(F.lit(False).alias("reached"))
    return found.agg(F.coalesce(F.max(severity_rank(F.col("severity"))) >= SEVERITIES.index(threshold), F.lit(False)).alias("reached"))


def exit_code(found: DataFrame, runs: DataFrame, threshold: str, comparison: DataFrame | None = None) -> int:
    """2 if a module failed, else 1 if a finding (a new one, where there is a baseline) reaches the threshold, else 0."""
    if runs.where("status = 'failed'").limit(1).count():
        return 2
    if comparison is not None:
        found = found.join(comparison.where("state = 'new'").select("fingerprint"), "fingerprint", "left_semi")
    return int(reaches(found, threshold).first()["reached"])


def compared(current: DataFrame, baseline: DataFrame, changed: bool = False) -> DataFrame:
    """fingerprint, state for each fingerprint: new, unchanged or resolved. A changed scope can't tell what is resolved."""
    a = current.select("fingerprint").distinct().withColumn("_now", F.lit(True))
    b = baseline.select("fingerprint").distinct().withColumn("_then", F.lit(True))
    state = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNotNull(), "unchanged").otherwise("resolved")
    out = a.join(b, "fingerprint", "full_outer").select("fingerprint", state.alias("state"))
    return out.where("state <> 'resolved'") if changed else out


def baseline_state(found: DataFrame, comparison: DataFrame) -> DataFrame:
    return found.join(comparison.withColumnRenamed("state", "baseline_state"), "fingerprint", "left")


def bounded(rows: DataFrame, key: list, most: int = RECORDS) -> DataFrame:
    """The first `most` rows by key with total, emitted and omitted of the whole."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(*key).limit(most)
    return top.join(F.broadcast(counts)).withColumns({"emitted": F.least("total", F.lit(most)), "omitted": F.greatest(F.col("total") - most, F.lit(0))})


def bounded_coverage(coverage: DataFrame, most: int = RECORDS) -> DataFrame:
    """Coverage rows by module and scope; where there are more than `most`, those of grave status come first."""
    many = coverage.agg((F.count(F.lit(1)) > most).alias("_many"))
    # `supported` states in order of gravity: failed first, not-applicable last.
    rows = coverage.join(F.broadcast(many)).withColumn("_p", F.when(F.col("_many"), -ranked(F.col("status"), STATUS_PRIORITY, 0)).otherwise(F.lit(0))).drop("_many")
    return bounded(rows, ["_p", "module_id", "scope"], most).drop("_p")


def path_scoped(value) -> tuple:
    """(path, reason) Columns of a limitation headed by a path; nulls for others."""
    at = F.locate(": ", value)
    path, reason = F.substring(value, F.lit(1), at - 1), F.substring(value, at + 2, F.length(value))
    ok = (at > 1) & (reason.isin(*PATH_REASONS) | F.rlike(reason, F.lit(ECOSYSTEM_REASON))) & F.rlike(path, F.lit(r"^[A-Za-z0-9._@/+: -]+\z"))
    ok = ok & ~F.contains(path, F.lit("..")) & ~F.contains(path, F.lit("//"))
    return F.when(ok, path), F.when(ok, reason)


def bounded_limitations(values: DataFrame, inline: int = INLINE, sample: int = SAMPLE_PATHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(limitations, groups, summary) of values (value): a reason of more than `sample` paths becomes a group with sample paths
    and counts, the rest stay, at most `inline` of them; the summary has exact totals."""
    path, reason = path_scoped(F.col("value"))
    rows = values.select("value").distinct().withColumns({"path": path, "reason": reason})
    scoped = rows.where("reason is not null")
    first = scoped.withColumn("_r", F.row_number().over(W.partitionBy("reason").orderBy("path"))).where(F.col("_r") <= sample)
    first = first.groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("sample_paths"))
    groups = scoped.groupBy("reason").agg(F.count(F.lit(1)).alias("total")).join(first, "reason").select("reason", "total", "sample_paths")
    groups = groups.where(F.col("total") > sample).withColumn("omitted_path_count", F.col("total") - sample)
    loose = rows.join(groups.select("reason"), "reason", "left_anti").select("value")
    kept = loose.orderBy("value").limit(inline)
    totals = rows.agg(F.count(F.lit(1)).alias("total"))
    emitted = kept.agg(F.count(F.lit(1)).alias("_k")).join(groups.agg(F.coalesce(F.sum(F.size("sample_paths")), F.lit(0)).alias("_g"), F.coalesce(F.sum("omitted_path_count"), F.lit(0)).alias("_o")))
    summary = totals.join(emitted).select("total", (F.col("_k") + F.col("_g")).alias("emitted"), F.greatest(F.col("total") - F.col("_k") - F.col("_g"), F.lit(0)).alias("omitted"), "_o")
    grouped = groups.select(F.concat("reason", F.lit(" "), "total", F.lit(" paths observed; "), "omitted_path_count", F.lit(" paths omitted after deterministic sampling.")).alias("value"))
    more = summary.where("omitted > _o").select(F.concat((F.col("omitted") - F.col("_o")).cast("string"), F.lit(" additional limitations omitted after deterministic sampling.")).alias("value"))
    return kept.unionByName(grouped).unionByName(more), groups, summary.drop("_o")


def capped(found: DataFrame, group: list[str], order: list, each: int, most: int) -> DataFrame:
    """The first `each` rows of each group, and of those the first `most` (of each repository), in order; group columns come first in the order."""
    repo = repo_key(found)
    first = found.withColumn("_r", F.row_number().over(W.partitionBy(*repo, *group).orderBy(*order))).where(F.col("_r") <= each).drop("_r")
    return first_of_each(first, repo, [*group, *order], most)


def first_of_each(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group; without groups, of all. Ranks are cut off before anything is shuffled."""
    if not group:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def merged_changes(*views: DataFrame) -> DataFrame:
    """One row for each changed path: of its statuses the strongest, ties by previous path and status."""
    rank = ranked(F.col("status"), {"deleted": 6, "renamed": 5, "copied": 4, "added": 3, "untracked": 2, "modified": 1})
    rows = reduce(DataFrame.unionByName, views)
    best = rows.groupBy("path").agg(F.min(F.struct((-rank).alias("r"), F.coalesce("previous_path", F.lit("")).alias("p"), "status", "previous_path")).alias("b"))
    return best.select("path", "b.status", "b.previous_path")


def running_budget(files: DataFrame, each: int, total: int, group: list[str] | None = None) -> DataFrame:
    """files with oversize, and within: whether the sizes up to here, by path, fit the total. What no longer fits ends the run.

    Groups (by default, repositories) have a budget each. Sums are of two levels, ranges of paths and paths in a range, so that one
    group with most of the files is read by many tasks; the sums of ranges are as many as partitions and groups.
    """
    group = repo_key(files) if group is None else group
    small = files.where(F.col("size") <= each)
    over = files.where(F.col("size") > each).select("*", F.lit(True).alias("oversize"), F.lit(False).alias("within"))
    parted = cut(small.repartitionByRange(*group, "path").withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = parted.groupBy(*group, "_part").agg(F.sum("size").alias("_n"))
    start = start.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_at"), before.alias("_before"))
    w = W.partitionBy(*group, "_part").orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    summed = parted.withColumn("_sum", F.sum("size").over(w)).join(start, reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_at")))
    return summed.select(*files.columns, F.lit(False).alias("oversize"), (F.col("_sum") + F.col("_before") <= total).alias("within")).unionByName(over)


def skipping_budget(files: DataFrame, each: int, total: int) -> DataFrame:
    """files with within: an ordered fold in which what doesn't fit is skipped and a later, smaller one may still fit.

    The fold is sequential by nature: a group (column `grp`) is read in order by one task, which keeps nothing but the sum.
    """
    kept = files.select("grp", "path", "size").repartition("grp").sortWithinPartitions("grp", "path")

    def fold(batches):
        import pyarrow as pa

        group, used, first = None, 0, True
        for batch in batches:
            out = []
            for g, size in zip(batch.column("grp").to_pylist(), batch.column("size").to_pylist()):
                if first or g != group:
                    group, used, first = g, 0, False
                fits = size is not None and size <= each and used + size <= total
                used += size if fits else 0
                out.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "within"])

    done = kept.mapInArrow(fold, T.StructType([*kept.schema.fields, T.StructField("within", T.BooleanType())]))
    rest = [c for c in files.columns if c not in ("grp", "path", "size")]
    return done if not rest else files.join(done.drop("size"), ["grp", "path"])
