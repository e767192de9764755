"""Line dedup by a log-template tree, with DataFrame functions alone.

A line's tokens are split at spaces and tabs; a token with a digit in it is a variable field, `<*>`. The tree is of fixed depth:
token count, then the leading tokens (`depth` of them), which name a leaf. Below the leaf, the other tokens are cut into BLOCKS
blocks (of one token each, in lines of few tokens). A block that lines of fewer than `min_docs` contexts have there is a variable
field too; what is left makes the line's template, at least `alike` of the tokens below the leaf, and half of all tokens must be
no field. Lines of fewer than `min_tokens` tokens have no template.

A template recurs if it stands in at least `min_docs` different documents. Copies and near copies of one text are no different
documents: they are left to the near-duplicate operator. What tells documents apart is the context of a line, the ten longest
words of the document's other lines (the whole text, where there is no such word). Of a template's documents, those that share
half of these words with its most frequent context count as one, and each context beside them counts once; so a group of any
number of copies neither makes its own lines recur nor hides those that stand elsewhere too. Recurring lines are dropped from
every document but the one with the lowest doc_id, so no text disappears altogether.

Most lines' leaves hold one document. They are left out before anything is shuffled by a bitmap of fixed size that is broadcast,
and exactly by the join behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Tables, let, order_key

DEPTH, MIN_TOKENS, MIN_DOCS, ALIKE, BLOCKS = 3, 3, 3, 0.6, 8
#: Words of a context, their least length, and how many of a document's longest ones are looked through for it.
WORDS, LETTERS, LOOKED = 10, 10, 40
#: Bits of the bitmap of leaves: 2 MB.
BITS = 1 << 24


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.replace(line, F.lit("\t"), F.lit(" ")), " "), "")


def masked(words: Column) -> Column:
    return F.transform(words, lambda x: F.when(F.rlike(x, F.lit("[0-9]")), "<*>").otherwise(x))


def constants(words: Column) -> Column:
    return F.size(F.filter(words, lambda x: x != "<*>"))


def leaf(words: Column, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> Column:
    """The token count and the leading tokens; null for lines of fewer than min_tokens tokens."""
    return F.when(F.size(words) >= min_tokens, F.concat_ws(" ", F.size(words).cast("string"), masked(F.slice(words, 1, depth))))


def blocks(words: Column, depth: int = DEPTH) -> Column:
    """array<struct<at, n, firm, block>>: the blocks below the leaf that hold tokens (or an empty one), with their tokens and those that are no field."""

    def of(w: Column) -> Column:
        m = F.size(w) - depth
        edge = lambda j: F.floor(j * m / BLOCKS).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: F.struct(j.alias("at"), F.slice(w, edge(j) + depth + 1, edge(j + 1) - edge(j)).alias("part")))
        none = F.array(F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("part")))
        return F.transform(
            F.when(m > 0, F.filter(cut, lambda b: F.size(b["part"]) > 0)).otherwise(none),
            lambda b: F.struct(b["at"].alias("at"), F.size(b["part"]).alias("n"), constants(b["part"]).alias("firm"), F.array_join(b["part"], " ").alias("block")),
        )

    return let(masked(words), of)


def cut_lines(text: Column, depth: int, min_tokens: int) -> Column:
    """array<struct<line, leaf, long>>: each line, its leaf, and its long words (length, word, less the line's number)."""

    def of(line: Column, i: Column) -> Column:
        def parts(w: Column) -> Column:
            long = F.transform(F.filter(w, lambda x: F.length(x) >= LETTERS), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"), (-i).alias("i")))
            return F.struct(line.alias("line"), leaf(w, depth, min_tokens).alias("leaf"), long.alias("long"))

        return let(tokens(line), parts)

    return F.transform(F.split(text, "\n"), of)


def longest(long: Column) -> Column:
    """array<struct<h, i>>: hashes of the document's longest words (ties: the greatest) with the numbers of their lines, longest first."""
    return F.transform(F.slice(F.sort_array(F.flatten(long), False), 1, LOOKED), lambda x: F.struct(F.xxhash64(x["w"]).alias("h"), (-x["i"]).alias("i")))


def context(long: Column, pos: Column, text_hash: Column) -> Column:
    """The hashes of the longest words of the other lines; the text's own hash where there are none."""
    words = F.slice(F.array_distinct(F.transform(F.filter(long, lambda x: x["i"] != pos), lambda x: x["h"])), 1, WORDS)
    return let(words, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(text_hash)))


def _recurring(rows: DataFrame, key: str, min_docs: int, t: Tables, name: str) -> DataFrame:
    """key, first (the lowest doc): the keys that stand in at least min_docs different documents."""
    per = rows.groupBy(key, "context", "doc", "tie").agg(F.min("pos").alias("pos"), F.first("words").alias("words"))
    per = per.groupBy(key, "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at"), F.first("words").alias("words"))
    per = t.keep(per, f"{name}_contexts")
    first = F.struct(F.col("n"), (-F.col("at.doc").cast("decimal(20,0)")).alias("doc"), (-F.col("at.pos")).alias("pos"))
    most = per.groupBy(key).agg(F.max_by("words", first).alias("most"), F.min("at.doc").alias("first"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= min_docs)
    other = 2 * F.size(F.array_intersect("words", "most")) < F.greatest(F.size("words"), F.size("most"))
    found = per.join(most, key).groupBy(key).agg(F.min("first").alias("first"), F.sum(other.cast("int")).alias("others"))
    return t.keep(found.where(F.col("others") >= min_docs - 1).select(key, "first"), name)


def _in_bitmap(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose leaf may be one of the leaves. What is broadcast are BITS bits, whatever the number of leaves."""
    bit = F.pmod(F.xxhash64("leaf"), F.lit(BITS)) + 1
    maps = leaves.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, (at % 8).cast("int")) == 1
    return lines.join(F.broadcast(maps), (F.bitmap_bucket_number(bit) == F.col("bucket")) & there, "left_semi")


def drop_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """docs with recurring lines removed from text, plus n_lines and n_dropped.

    Null texts stay null with 0 lines; an empty text is one line; a text that loses every line becomes empty. Rows with
    equal doc_id count as documents of their own; null ids come first. Columns named n_lines or n_dropped are replaced,
    all other columns stay, whatever their names. Lines are separated by \\n alone. An empty table gives an empty result.
    """
    t = Tables(docs.sparkSession, "lines")
    doc, tie = order_key(F.col("doc_id")), F.xxhash64("text")
    # What is of the document is computed in a row of its own, below the explosion into lines.
    whole = docs.where(F.col("text").isNotNull()).select(doc.alias("doc"), tie.alias("tie"), cut_lines(F.col("text"), depth, min_tokens).alias("per"))
    whole = whole.select("doc", "tie", "per", longest(F.col("per.long")).alias("long"))
    # The outer form, as an array of lines is never empty: the other one has its filter compute all of it once more.
    lines = whole.select("doc", "tie", "long", F.posexplode_outer("per").alias("pos", "l"))
    lines = lines.select("doc", "tie", "pos", F.col("l.leaf").alias("leaf"), context(F.col("long"), F.col("pos"), F.col("tie")).alias("words"), F.col("l.line").alias("line"))
    lines = t.keep(lines.select("*", F.xxhash64("words").alias("context")), "lines", **{"parquet.enable.dictionary#line": "false"}).where(F.col("leaf").isNotNull())
    # Two contexts at least are told by the least and the greatest.
    busy = t.keep(lines.groupBy("leaf").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a < b").select("leaf"), "busyleaves")
    rows = t.keep(_in_bitmap(lines, busy).join(busy, "leaf"), "busy")
    rows = t.keep(rows.join(_recurring(rows, "leaf", min_docs, t, "leaves"), "leaf", "left_semi"), "rows")
    each = rows.select("leaf", "context", "doc", "tie", "pos", F.explode_outer(blocks(tokens(F.col("line")), depth)).alias("b")).select("leaf", "context", "doc", "tie", "pos", "b.*")
    each = t.keep(each, "blocks")
    constant = each.groupBy("leaf", "at", "block").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a < b").select("leaf", "at", "block")
    constant = each.join(constant, ["leaf", "at", "block"], "left_semi").groupBy("leaf", "at", "block", "context").agg(F.lit(1).alias("one")).groupBy("leaf", "at", "block").agg(F.count("one").alias("n"))
    constant = t.keep(constant.where(F.col("n") >= min_docs).select("leaf", "at", "block"), "constant")
    fixed = each.join(constant, ["leaf", "at", "block"], "left_semi").groupBy("leaf", "doc", "tie", "pos")
    fixed = fixed.agg(F.sum("n").alias("n"), F.sum("firm").alias("firm"), F.array_sort(F.collect_set(F.struct("at", "block"))).alias("fixed"))
    size = F.split_part("leaf", F.lit(" "), F.lit(1)).cast("int")
    fixed = fixed.where((F.col("n") >= F.lit(alike) * (size - depth)) & (2 * (F.col("firm") + constants(F.split("leaf", " ")) - 1) >= size))
    fixed = fixed.select("doc", "tie", "pos", F.concat(F.col("leaf"), F.lit(": "), F.to_json("fixed")).alias("template"))
    placed = t.keep(rows.select("doc", "tie", "pos", "context", "words").join(fixed, ["doc", "tie", "pos"]), "placed")
    dropped = (
        placed.join(_recurring(placed, "template", min_docs, t, "templates"), "template").where(F.col("doc") != F.col("first"))
        .groupBy("doc", "tie").agg(F.collect_set("pos").alias("gone"))
    )
    dropped = t.keep(dropped, "dropped")
    t.drop("lines", "busyleaves", "busy", "rows", "blocks", "constant", "placed", "leaves", "leaves_contexts", "templates", "templates_contexts")
    # No row of docs is lost: the left side keeps documents without dropped lines.
    joined = docs.select(doc.alias("doc"), tie.alias("tie"), F.struct("*").alias("row")).join(dropped, ["doc", "tie"], "left")
    before, gone = F.col("row.text"), F.coalesce("gone", F.array().cast("array<int>"))
    all_lines = F.split(before, "\n")

    def rest(l: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(l) - 1), gone)
        return F.array_join(F.transform(F.array_sort(kept), lambda i: F.get(l, i)), "\n")

    text = F.when(F.col("gone").isNull(), before).otherwise(let(all_lines, rest))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(before.isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_dropped"),
    )


def _sql_recurring(name: str, rows: str, key: str) -> str:
    """Common table expressions of DuckDB: `name` holds the keys of `rows` that recur, and their first documents."""
    return f"""{name}_c AS (SELECT {key} AS k, words, count(DISTINCT row_id) AS n, min({{'doc': doc_id, 'pos': pos}}) AS loc FROM {rows} GROUP BY {key}, words),
{name}_m AS (SELECT k, max_by(words, {{'n': n, 'doc': -loc.doc, 'pos': -loc.pos}}) AS most, min(loc.doc) AS first FROM {name}_c GROUP BY k HAVING count(*) >= {MIN_DOCS}),
{name} AS (SELECT k, any_value(first) AS first FROM {name}_c JOIN {name}_m USING (k) WHERE 2 * len(list_intersect(words, most)) < greatest(len(words), len(most)) GROUP BY k HAVING count(*) >= {MIN_DOCS} - 1)"""


#: DuckDB SQL with the result of op7 over the view documents.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
l AS (SELECT row_id, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT row_id, pos, unnest(list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: length(x) >= {LETTERS})) AS w FROM l),
b AS (SELECT row_id, list(w ORDER BY length(w) DESC, w DESC, pos)[1:{LOOKED}] AS long, list(pos ORDER BY length(w) DESC, w DESC, pos)[1:{LOOKED}] AS places FROM w GROUP BY row_id),
o AS (SELECT l.row_id, doc_id, l.pos, line, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: x <> '') AS toks, text,
  list_filter(list_zip(long, places), lambda x: x[2] <> l.pos) AS others FROM l LEFT JOIN b USING (row_id)),
c AS (SELECT row_id, doc_id, pos, toks, CASE WHEN coalesce(len(others), 0) = 0 THEN [' ' || text] ELSE list_transform(list_filter(others, lambda x, i: i = list_position(list_transform(others, lambda y: y[1]), x[1])), lambda x: x[1])[1:{WORDS}] END AS words,
  {{'n': len(toks), 'lead': list_transform(toks[1:{DEPTH}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)}} AS leaf FROM o WHERE len(toks) >= {MIN_TOKENS}),
{_sql_recurring('leaves', 'c', 'leaf')},
r AS (SELECT c.* FROM c JOIN leaves ON leaf = k),
m AS (SELECT row_id, pos, leaf, words, list_transform(toks, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks, len(toks) - {DEPTH} AS m, unnest(range(0, {BLOCKS})) AS loc FROM r),
q AS (SELECT row_id, pos, leaf, words, loc, toks[{DEPTH} + 1 + loc * m // {BLOCKS} : {DEPTH} + (loc + 1) * m // {BLOCKS}] AS part FROM m WHERE (loc + 1) * m // {BLOCKS} > loc * m // {BLOCKS} OR m <= 0 AND loc = 0),
e AS (SELECT row_id, pos, leaf, words, loc, len(part) AS size, len(list_filter(part, lambda x: x <> '<*>')) AS firm, array_to_string(part, ' ') AS block FROM q),
f AS (SELECT leaf, loc, block FROM e GROUP BY leaf, loc, block HAVING count(DISTINCT words) >= {MIN_DOCS}),
x AS (SELECT row_id, pos, leaf, sum(size) AS n, sum(firm) AS firm, list({{'at': loc, 'block': block}} ORDER BY loc) AS fixed FROM e JOIN f USING (leaf, loc, block) GROUP BY row_id, pos, leaf),
p AS (SELECT r.row_id, r.doc_id, r.pos, r.words, {{'leaf': r.leaf, 'fixed': fixed}} AS template FROM r JOIN x ON r.row_id = x.row_id AND r.pos = x.pos WHERE x.n >= {ALIKE} * (r.leaf.n - {DEPTH}) AND 2 * (x.firm + len(list_filter(r.leaf.lead, lambda y: y <> '<*>'))) >= r.leaf.n),
{_sql_recurring('templates', 'p', 'template')},
g AS (SELECT DISTINCT row_id, pos FROM p JOIN templates ON template = k WHERE doc_id <> first),
s AS (SELECT l.row_id, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN g ON l.row_id = g.row_id AND l.pos = g.pos GROUP BY l.row_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN s USING (row_id)
"""
