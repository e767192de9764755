"""Resolution of import specifiers: paths without their extensions are looked up by equality, the extensions by order of preference.

Where the relations have a repo_id, every lookup stays within its repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import packages as N
from auditlake.functions import paths as P
from auditlake.operators.lineage import cut, repo_key
from auditlake.operators.ownership import nearest

# Extensions in order of preference, and what a JavaScript extension may stand for.
TYPESCRIPT_FIRST = P.SOURCE_EXTENSIONS
JAVASCRIPT_FIRST = P.SOURCE_EXTENSIONS[4:] + P.SOURCE_EXTENSIONS[:4]
SUBSTITUTES = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


PROBES = "array<struct<stem:string,endings:array<string>>>"


def probes(base: Column, target: Column, importer: Column) -> Column:
    """The stems that a target may name and, for each, the endings to look for in order; null if it leaves the repository.

    A name without an extension has two stems, its own and its index file's; one with a source extension has one; any other none.
    """
    typed = F.lower(P.extension(importer)).isin(".ts", ".tsx", ".mts", ".cts")
    order = F.when(typed, F.array(*map(F.lit, TYPESCRIPT_FIRST))).otherwise(F.array(*map(F.lit, JAVASCRIPT_FIRST)))
    probe = lambda stem, endings: F.struct(stem.alias("stem"), endings.alias("endings"))

    def of(whole: Column, ext: Column, low: Column) -> Column:
        endings = F.array(ext)
        for js, ts in SUBSTITUTES.items():
            endings = F.when(low == js, F.array(ext, *map(F.lit, ts))).otherwise(endings)
        stem = F.left(whole, F.length(whole) - F.length(ext))
        bare = F.array(probe(whole, order), probe(F.concat(whole, F.lit("/index")), order))
        return F.when(ext == "", bare).when(low.isin(*P.SOURCE_EXTENSIONS), F.array(probe(stem, endings))).otherwise(F.array().cast(PROBES))

    return P.let(P.joined(base, target), lambda w: F.when(w.isNotNull(), P.let(P.extension(w), lambda e: of(w, e, F.lower(e)))))


def first_choice(probed: Column) -> Column:
    """The path that is meant if nothing is there: the first stem with its first ending."""
    return F.when(F.size(probed) > 0, F.concat(F.get(probed, F.lit(0))["stem"], F.get(F.get(probed, F.lit(0))["endings"], F.lit(0))))


def stem_index(sources: DataFrame) -> DataFrame:
    """stem, there: a row for each source path without its extension, with the extensions it has."""
    ext = P.extension(F.col("path"))
    rows = sources.select(*repo_key(sources), F.left("path", F.length("path") - F.length(ext)).alias("stem"), ext.alias("_ext"))
    return rows.groupBy(*repo_key(sources), "stem").agg(F.collect_set("_ext").alias("there"))


def looked_up(requests: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """key, found: the paths that are there, in order of preference, for requests (key, probes) of which one is; one equality join of two rows a request at most."""
    k = repo_key(index)
    each = requests.select(*key, F.posexplode("probes").alias("_at", "_p")).select(*key, "_at", F.col("_p.stem").alias("stem"), F.col("_p.endings").alias("_wanted"))
    hits = each.join(index, [*k, "stem"]).withColumn("_found", F.transform(F.filter("_wanted", lambda e: F.array_contains("there", e)), lambda e: F.concat("stem", e))).where(F.size("_found") > 0)
    return hits.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_found"))), lambda s: s["_found"])).alias("found"))


def first_hit(requests: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """requests with target_path, target_exists: the first path that is there, else the first choice; nulls without probes."""
    joined = requests.join(looked_up(requests, index, key), key, "left")
    hit = F.get("found", F.lit(0))
    return joined.withColumns({"target_path": F.coalesce(hit, first_choice(F.col("probes"))), "target_exists": F.when(F.size("probes") > 0, hit.isNotNull())}).drop("found")


def alias_replacement(pattern: Column, specifier: Column) -> Column:
    """What the pattern's star stands for in the specifier; empty without a star; null if it doesn't match."""
    head, tail = F.split_part(pattern, F.lit("*"), F.lit(1)), F.split_part(pattern, F.lit("*"), F.lit(2))
    starred = F.contains(pattern, F.lit("*"))
    fits = F.startswith(specifier, head) & F.endswith(specifier, tail)
    middle = F.substring(specifier, F.length(head) + 1, F.greatest(F.length(specifier) - F.length(head) - F.length(tail), F.lit(0)))
    return F.when(~starred & (pattern == specifier), F.lit("")).when(starred & fits, middle)


def workspace_entry(manifest: Column, subpath: Column, type_only: Column) -> Column:
    """struct(entry, unsupported, explicit) of a package's manifest (JSON text, null if there is none)."""
    text = lambda path: F.get_json_object(manifest, path)
    kind = lambda path: F.schema_of_variant(F.variant_get(F.try_parse_json(manifest), path, "variant"))
    is_text, has = lambda p: F.coalesce(kind(p) == "STRING", F.lit(False)), lambda p: kind(p).isNotNull()
    make = lambda entry, bad, explicit: F.struct(entry.alias("entry"), F.lit(bad).alias("unsupported"), explicit.alias("explicit"))
    exports = F.from_json(text("$.exports"), "map<string,string>")
    exported = F.get(F.filter(F.map_values(F.map_filter(exports, lambda k, v: k == F.concat(F.lit("./"), subpath))), lambda v: ~F.rlike(v, F.lit(r"^[\[{]"))), F.lit(0))
    root = F.get(F.filter(F.map_values(F.map_filter(exports, lambda k, v: k == ".")), lambda v: ~F.rlike(v, F.lit(r"^[\[{]"))), F.lit(0))
    object_exports = F.startswith(F.trim(text("$.exports")), F.lit("{"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    plain = F.coalesce(F.when(is_text("$.module"), text("$.module")), F.when(is_text("$.main"), text("$.main")))
    below = F.when(~F.coalesce(object_exports, no), make(subpath, False, no)).when(exported.isNotNull(), make(exported, False, yes)).otherwise(make(none, True, no))
    own = (
        F.when(type_only & is_text("$.types"), make(text("$.types"), False, yes))
        .when(is_text("$.exports"), make(text("$.exports"), False, yes))
        .when(has("$.exports") & root.isNotNull(), make(root, False, yes))
        .when(has("$.exports"), make(none, True, no))
        .otherwise(make(F.coalesce(plain, F.lit("index")), False, plain.isNotNull()))
    )
    return F.when(subpath != "", below).otherwise(own)


def publication_outputs(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """rows (importer_path, target_path) with published: whether the nearest manifest above the importer lists the target among its published files."""
    k = repo_key(rows)
    valid = manifests.where("status = 'valid'").select(*k, P.dirname(F.col("path")).alias("directory"), F.col("path").alias("place"))
    listed = manifests.select(*k, F.col("path").alias("place"), F.from_json(F.get_json_object("data", "$.files"), "array<string>").alias("_files"))
    near = nearest(rows.select(*k, F.col("importer_path").alias("path")).distinct(), valid).join(listed, [*k, "place"], "left")
    root = P.dirname(F.col("place"))
    inside = P.relative(root, F.col("path"))
    roots = F.when(F.rlike(inside, F.lit(r"^npm(?:/|\z)")), F.array(root, P.at_root(root, F.lit("npm")))).otherwise(F.array(root))
    entries = F.filter(F.transform(F.coalesce("_files", F.array().cast("array<string>")), P.publication_entry), lambda e: e.isNotNull())
    near = near.select(*k, F.col("path").alias("importer_path"), roots.alias("_roots"), entries.alias("_entries"))

    def at(root_, entry):
        whole = P.safe_plain_path(root_, entry["path"])
        return F.coalesce((F.col("target_path") == whole) | (entry["prefix"] & F.startswith(F.col("target_path"), F.concat(whole, F.lit("/")))), F.lit(False))

    hit = F.exists("_entries", lambda e: F.exists("_roots", lambda r: at(r, e)))
    return rows.join(near, [*k, "importer_path"], "left").withColumn("published", F.coalesce(hit, F.lit(False))).drop("_roots", "_entries")


def disposition(published: Column, target: Column, importer: Column, prefixes: Column) -> Column:
    return (
        F.when(published, "declared-publication-output")
        .when(P.under_prefix(target, prefixes), "literal-ignored-output")
        .when(P.is_fixture(importer) | P.is_fixture(target), "fixture-controlled")
        .otherwise("provable")
    )


RELATIVE_NOTES = {
    "declared-publication-output": "relative source target is declared publication output and may require generation.",
    "literal-ignored-output": "relative source target is covered by a literal ignore rule and may be generated.",
    "fixture-controlled": "relative source target is fixture-controlled.",
}


def resolve(imports: DataFrame, files: DataFrame, projects: DataFrame, manifests: DataFrame, configs: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """imports (path, kind, specifier, line, col, ordinal) with outcome (internal, external, unsupported), target_path,
    target_exists, missing_target_proof and limitation.

    Relative specifiers are looked up first, then schemes are external, then aliases of the nearest configuration apply in
    the order of their pattern text, then workspace packages by a unique name; all else is external. ignored: prefix, the paths
    that literal ignore rules cover; a target lies under one if an ancestor of it is one, by equality.
    """
    k = repo_key(imports)
    # Probed by three joins, so made once.
    index = cut(stem_index(files.where("kind = 'file'").where(P.is_source(F.col("path")))))
    key = [*k, "importer_path", "ordinal"]
    rows = imports.withColumnRenamed("path", "importer_path")
    spec, importer = F.col("specifier"), F.col("importer_path")
    none = F.lit(None).cast("string")
    note = lambda text: F.concat(importer, F.lit(": "), text if isinstance(text, Column) else F.lit(text))
    final = [*rows.columns, "outcome", "target_path", "target_exists", "missing_target_proof", "limitation"]

    # Relative.
    rel = rows.where(F.startswith(spec, F.lit("."))).withColumn("probes", probes(P.dirname(importer), spec, importer))
    rel = first_hit(rel, index, key)
    rel = publication_outputs(rel, manifests)
    none_under = F.array().cast("array<string>")
    if ignored is None:
        rel = rel.withColumn("_under", none_under)
    else:
        up = rel.where("not target_exists").select(*key, F.explode(P.ancestors(F.col("target_path"))).alias("prefix"))
        under = up.join(ignored.select(*k, "prefix").distinct(), [*k, "prefix"]).groupBy(*key).agg(F.collect_set("prefix").alias("_under"))
        rel = rel.join(under, key, "left").withColumn("_under", F.coalesce("_under", none_under))
    prefixes = F.col("_under")
    why = F.when(F.col("target_exists") | ~P.is_explicit_target(spec), "provable").otherwise(disposition(F.col("published"), F.col("target_path"), importer, prefixes))
    said = F.lit("relative source target was not found in the current inventory.")
    for name, text in RELATIVE_NOTES.items():
        said = F.when(F.col("_why") == name, F.lit(text)).otherwise(said)
    lost = F.col("probes").isNull()
    rel = rel.withColumn("_why", why).withColumns({
        "outcome": F.when(lost | (F.size("probes") == 0), "unsupported").otherwise("internal"),
        "missing_target_proof": F.when(~F.col("target_exists") & P.is_explicit_target(spec) & (F.col("_why") == "provable"), "relative-explicit"),
        "limitation": F.when(lost, note("source import escapes the repository.")).when(F.size("probes") == 0, note("relative source target is unsupported.")).when(~F.col("target_exists"), note(said)),
    }).select(final)

    # Absolute and schemes.
    other = rows.where(~F.startswith(spec, F.lit(".")))
    absolute = F.startswith(spec, F.lit("/")) | F.contains(spec, F.lit("\0"))
    scheme = F.rlike(spec, F.lit("(?i)^[a-z][a-z0-9+.-]*:"))
    fixed = other.where(absolute | scheme).withColumns({
        "outcome": F.when(absolute, "unsupported").otherwise("external"), "target_path": none, "target_exists": F.lit(None).cast("boolean"), "missing_target_proof": none,
        "limitation": F.when(absolute, note("source import escapes the repository.")),
    }).select(final)

    # Aliases of the nearest configuration: the first matching pattern decides.
    bare = other.where(~absolute & ~scheme)
    near = nearest(bare.select(*k, importer.alias("path")).distinct(), configs.select(*k, "directory", F.col("path").alias("place")))
    conf = configs.select(*k, F.col("path").alias("place"), "base_path", F.explode("aliases").alias("alias"))
    offers = bare.join(near.withColumnRenamed("path", "importer_path"), [*k, "importer_path"]).join(conf, [*k, "place"]).withColumn("_with", alias_replacement(F.col("alias.pattern"), spec)).where("_with is not null")
    chosen = offers.groupBy(*key).agg(F.min_by(F.struct("base_path", F.col("alias.targets").alias("targets"), "_with"), "alias.pattern").alias("a"))
    targets = chosen.select(*key, "a.targets", F.posexplode("a.targets").alias("_i", "_t"), F.col("a.base_path").alias("_b"), F.col("a._with").alias("_w"))
    star = lambda c, w: F.when(F.contains(c, F.lit("*")), F.concat(F.substring_index(c, "*", 1), w, F.substring(c, F.locate("*", c) + 1, F.length(c)))).otherwise(c)
    lists = targets.withColumn("_c", F.coalesce(probes(F.col("_b"), star(F.col("_t"), F.col("_w")), importer), F.array().cast(PROBES)))
    flat = lists.groupBy(*key, "targets").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda s: s["_c"])).alias("probes"))
    there = looked_up(flat, index, key).select(*key, F.array_distinct("found").alias("found"))
    al = bare.join(flat, key).join(there, key, "left").withColumns({"_n": F.coalesce(F.size("found"), F.lit(0)), "_hit": F.array_min("found")})
    al = al.withColumn("_n", F.greatest("_n", F.lit(0)))
    single = (F.size("targets") == 1) & (F.size("probes") > 0)
    ambiguous = (F.col("_n") > 1) | ((F.col("_n") == 0) & ~single)
    al = al.withColumns({
        "outcome": F.when(ambiguous, "unsupported").otherwise("internal"), "target_path": F.when(~ambiguous, F.coalesce("_hit", first_choice(F.col("probes")))),
        "target_exists": F.when(~ambiguous, F.col("_n") == 1), "missing_target_proof": F.when(~ambiguous & (F.col("_n") == 0) & P.is_explicit_target(F.get("targets", F.lit(0))), "alias-explicit"),
        "limitation": F.when(ambiguous, note("source alias resolves ambiguously.")).when(F.col("_n") == 0, note("source alias target was not found in the current inventory.")),
    }).select(final)

    # Workspace packages: a name that exactly one project has.
    left = bare.join(al.select(*key), key, "left_anti").withColumn("_id", N.package_identity(spec))
    named = projects.where("package_name is not null").groupBy(*k, F.col("package_name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_project"), F.min("root").alias("_root"))
    valid = manifests.where("status = 'valid'").select(*k, F.col("path").alias("_m"), "data")
    first = projects.select(*k, F.col("id").alias("_project"), F.explode("manifest_paths").alias("_m")).join(valid, [*k, "_m"]).groupBy(*k, "_project").agg(F.min_by("data", "_m").alias("_data"))
    ws = left.withColumn("_name", F.col("_id.name")).join(named, [*k, "_name"], "left").join(first, [*k, "_project"], "left")
    ws = ws.withColumn("_e", workspace_entry(F.col("_data"), F.col("_id.subpath"), F.col("kind") == "type-only"))
    ws = first_hit(ws.withColumn("probes", F.when(F.col("_n") == 1, probes(F.col("_root"), F.col("_e.entry"), importer))), index, key)
    bad = F.col("_e.unsupported") | F.coalesce(F.size("probes") == 0, F.lit(True)) | (F.size("probes") <= 0)
    unique = F.coalesce(F.col("_n") == 1, F.lit(False))
    ws = ws.withColumns({
        "outcome": F.when(F.col("_n").isNull(), "external").when(~unique | bad, "unsupported").otherwise("internal"),
        "target_path": F.when(unique & ~bad, F.col("target_path")), "target_exists": F.when(unique & ~bad, F.col("target_exists")), "missing_target_proof": none,
        "limitation": F.when(F.col("_n") > 1, note("internal workspace package identity is ambiguous."))
        .when(unique & bad, note("workspace package entry point is unsupported or ambiguous."))
        .when(unique & ~F.col("target_exists") & F.col("_e.explicit"), note("workspace publication target was not found in the current inventory; the entry may require a build."))
        .when(unique & ~F.col("target_exists"), note("workspace source target was not found in the current inventory.")),
    }).select(final)
    return rel.unionByName(fixed).unionByName(al).unionByName(ws)
