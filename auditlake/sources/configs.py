"""Alias configurations: one for each directory, with bounded local inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions.imports import jsonc_to_json
from auditlake.operators.lineage import cut, repo_key

EXTENDS = 8


def alias_is_supported(pattern: Column) -> Column:
    return F.rlike(pattern, F.lit(r"^@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.*-]+)*\z")) & (F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit(""))) <= 1)


def target_is_supported(base: Column, target: Column) -> Column:
    stars = F.length(target) - F.length(F.replace(target, F.lit("*"), F.lit("")))
    return (stars <= 1) & P.safe_config_path(base, F.replace(target, F.lit("*"), F.lit("x"))).isNotNull()


def alias_configs(files: DataFrame, contents: DataFrame, extends: int = EXTENDS) -> tuple[DataFrame, DataFrame]:
    """(path, directory, base_path, aliases sorted by pattern; limitations (value)).

    tsconfig.json wins over jsconfig.json in a directory. A configuration inherits along a chain of local files of bounded
    depth; its own paths replace inherited ones, its own base path too. Cycles and missing or unreadable parents end the
    whole configuration with a limitation.
    """
    k = repo_key(files)
    named = files.where(P.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json")).withColumn("directory", P.dirname(F.col("path")))
    links = named.where("kind = 'symlink'").select(*k, F.concat("path", F.lit(": source configuration symlink was not read.")).alias("value"))
    chosen = named.where("kind = 'file'").groupBy(*k, "directory").agg(F.max("path").alias("path"), F.count(F.lit(1)).alias("n"))
    both = chosen.where("n > 1").select(*k, F.concat("directory", F.lit(": both tsconfig.json and jsconfig.json apply; tsconfig.json was selected.")).alias("value"))
    # Everything a file says, once for each file that may be inherited from.
    texts = files.where("kind = 'file'").where(F.endswith("path", F.lit(".json"))).select(*k, "path").join(contents.select(*k, "path", "content"), [*k, "path"]).withColumn("j", jsonc_to_json("content"))
    v = lambda p: F.variant_get(F.try_parse_json("j"), p, "variant")
    text = lambda p: F.get_json_object("j", p)
    is_text = lambda p: F.coalesce(F.schema_of_variant(v(p)) == "STRING", F.lit(False))
    read = texts.select(
        *k, F.col("path").alias("current"), F.coalesce(F.startswith(F.to_json(F.try_parse_json("j")), F.lit("{")), F.lit(False)).alias("parsed"), F.when(is_text("$.extends"), text("$.extends")).alias("extends"), v("$.extends").isNotNull().alias("extended"),
        F.when(is_text("$.compilerOptions.baseUrl"), text("$.compilerOptions.baseUrl")).alias("base_url"), v("$.compilerOptions.baseUrl").isNotNull().alias("based"), text("$.compilerOptions.paths").alias("paths"),
    )
    rows = cut(chosen.select(*k, F.col("path").alias("origin"), F.col("path").alias("current"), F.array("path").alias("chain"), F.lit(0).alias("depth")))
    steps = rows
    for depth in range(1, extends + 2):
        here = rows.join(read, [*k, "current"]).where("parsed and extended and extends is not null").where(F.startswith("extends", F.lit(".")))
        to = P.safe_config_path(P.dirname(F.col("current")), F.col("extends"))
        to = F.when(P.extension(to) == "", F.concat(to, F.lit(".json"))).otherwise(to)
        rows = here.select(*k, "origin", to.alias("current"), "chain").where("current is not null")
        rows = cut(rows.select(*k, "origin", "current", F.concat("chain", F.array("current")).alias("chain"), F.lit(depth).alias("depth")))
        if rows.isEmpty():
            break
        steps = steps.unionByName(rows)
        rows = rows.where(F.size(F.array_distinct("chain")) == F.size("chain"))
    steps = cut(steps)
    cyclic, deep = F.size(F.array_distinct("chain")) < F.size("chain"), F.col("depth") > extends
    said = steps.join(read, [*k, "current"], "left")
    at = lambda t: F.concat("origin", F.lit(": " + t))
    bad_base = F.col("based") & (F.col("base_url").isNull() | P.safe_config_path(P.dirname(F.col("current")), F.col("base_url")).isNull())
    fatal = (
        F.when(deep, at(f"local source configuration inheritance exceeds the {extends}-file depth limit."))
        .when(cyclic, at("local source configuration inheritance contains a cycle."))
        .when(F.col("parsed").isNull(), F.when(F.col("depth") == 0, at("source configuration could not be read.")).otherwise(at("local source configuration inheritance could not be read.")))
        .when(~F.col("parsed"), at("source configuration could not be parsed."))
    )
    mild = F.array_compact(F.array(
        F.when(F.col("extended") & (F.col("extends").isNull() | ~F.startswith("extends", F.lit("."))), at("package-based source configuration inheritance is unsupported.")),
        F.when(bad_base, at("source configuration baseUrl is unsupported or unsafe.")),
    ))
    said = said.withColumns({"fatal": fatal, "mild": F.when(fatal.isNull(), mild).otherwise(F.array().cast("array<string>"))})
    # A parent that fails leaves what its child says; the origin itself must be readable.
    ok = said.where("fatal is null")
    base = F.when(F.col("based") & ~bad_base, P.safe_config_path(P.dirname(F.col("current")), F.col("base_url")))
    per = ok.groupBy(*k, "origin").agg(F.min_by(base, F.when(base.isNotNull(), F.col("depth"))).alias("_b"), F.max_by(P.dirname(F.col("current")), "depth").alias("_d"), F.min_by("paths", F.when(F.col("paths").isNotNull(), F.col("depth"))).alias("paths"), F.min("depth").alias("first"))
    per = per.where("first = 0").withColumn("base_path", F.coalesce("_b", "_d"))
    listed = per.select(*k, "origin", "base_path", F.explode_outer(F.map_entries(F.from_json("paths", "map<string,array<string>>"))).alias("e"))
    good = alias_is_supported(F.col("e.key")) & (F.size("e.value") > 0) & F.forall("e.value", lambda t: t.isNotNull() & target_is_supported(F.col("base_path"), t))
    refused = listed.where(F.col("e").isNotNull() & ~F.coalesce(good, F.lit(False))).select(*k, at("a source alias mapping is unsupported or unsafe.").alias("value")).distinct()
    kept = listed.withColumn("a", F.when(F.coalesce(good, F.lit(False)), F.struct(F.col("e.key").alias("pattern"), F.col("e.value").alias("targets"))))
    out = kept.groupBy(*k, "origin", "base_path").agg(F.array_sort(F.collect_list("a")).alias("aliases")).select(*k, F.col("origin").alias("path"), P.dirname(F.col("origin")).alias("directory"), "base_path", "aliases")
    notes = said.select(*k, F.explode(F.array_compact(F.concat(F.array("fatal"), "mild"))).alias("value"))
    return out, links.unionByName(both).unionByName(refused).unionByName(notes).distinct()
