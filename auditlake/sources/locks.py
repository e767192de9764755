"""npm lockfiles as entry rows. Raw specifications stay in a column that no finding carries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import packages as N
from auditlake.functions import paths as P

INVALID_JSON, NOT_OBJECT = "Selected npm lockfile is not valid JSON.", "Selected npm lockfile must contain a JSON object."
VERSION, NO_PACKAGES = "Selected npm lockfile version is unsupported.", "Selected npm lockfile has no packages object."
BAD_ENTRY, UNSAFE = "Selected npm lockfile contains an invalid package entry.", "Selected npm lockfile contains an unsafe package path."


def parse(locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status of each lockfile: lock_root, status, version, limitations; entries of the supported ones). locks: lock_root, content."""
    v = F.try_parse_json("content")
    text = F.to_json(v)
    version = F.get_json_object("content", "$.lockfileVersion").cast("int")
    packages = F.get_json_object("content", "$.packages")
    entries = F.from_json(packages, "map<string,string>")
    odd = F.exists(F.map_values(entries), lambda e: e.isNull() | ~F.startswith(F.ltrim(e), F.lit("{")))
    said = (
        F.when(v.isNull(), INVALID_JSON).when(~F.startswith(text, F.lit("{")), NOT_OBJECT).when(~F.coalesce(version.isin(2, 3), F.lit(False)), VERSION)
        .when(packages.isNull() | ~F.startswith(F.ltrim(packages), F.lit("{")), NO_PACKAGES).when(F.coalesce(odd, F.lit(False)), BAD_ENTRY)
    )
    rows = locks.select("lock_root", said.alias("said"), version.alias("version"), entries.alias("entries"))
    status = F.when(F.col("said").isNull(), "supported").when(F.col("said") == VERSION, "unsupported").otherwise("invalid")
    each = rows.where("said is null").select("lock_root", F.explode("entries").alias("path", "j"))
    safe = each.where(P.safe_lock_path(F.col("path")).isNotNull())
    g = lambda p: F.get_json_object("j", p)
    kind = lambda p: F.schema_of_variant(F.variant_get(F.try_parse_json("j"), p, "variant"))
    link = F.coalesce(g("$.link") == "true", F.lit(False)) & F.coalesce(kind("$.link") == "BOOLEAN", F.lit(False))
    resolved = F.when(kind("$.resolved") == "STRING", g("$.resolved"))
    source = N.source_class(F.coalesce(resolved, F.lit("")))
    tarball = N.is_tarball(resolved)
    integrity = F.when(kind("$.integrity") == "STRING", g("$.integrity"))
    section = lambda s: F.map_filter(F.coalesce(F.from_json(g(f"$.{s}"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), lambda k, x: N.safe_name(k).isNotNull() & x.isNotNull())
    sections = F.map_from_arrays(F.array(*map(F.lit, N.SECTIONS)), F.array(*map(section, N.SECTIONS)))
    made = safe.select("lock_root", "path", N.name_from_path(F.col("path")).alias("package_name"), link.alias("link"), resolved.alias("_r"), source.alias("source_class"), tarball.alias("tarball"),
                       integrity.alias("_i"), kind("$.integrity").isNotNull().alias("_has"), sections.alias("sections"))
    out = made.select(
        "lock_root", "path", "package_name", "link", F.when(F.col("link") & F.col("_r").isNotNull(), P.safe_lock_path(F.col("_r"))).alias("resolved_workspace_path"), "source_class",
        (F.col("source_class") == "git-pinned").alias("git_pinned"), "tarball", N.integrity_status(F.col("path"), F.col("link"), F.col("source_class"), F.col("tarball"), F.col("_has"), F.col("_i")).alias("integrity"), "sections",
    )
    unsafe = each.where(P.safe_lock_path(F.col("path")).isNull()).select("lock_root").distinct().withColumn("_u", F.lit(True))
    stray = made.where(F.col("link") & F.col("_r").isNotNull() & P.safe_lock_path(F.col("_r")).isNull()).select("lock_root").distinct().withColumn("_w", F.lit(True))
    notes = F.array_compact(F.array("said", F.when(F.col("_u"), UNSAFE), F.when(F.col("_w"), "Selected npm lockfile contains an unsafe workspace link path.")))
    states = rows.select("lock_root", "said", status.alias("status"), "version").join(unsafe, "lock_root", "left").join(stray, "lock_root", "left")
    return states.select("lock_root", "status", F.when(F.col("status") == "supported", F.col("version")).alias("version"), notes.alias("limitations")), out
