"""Importance resampling towards a target text's distribution of hashed n-grams, over a table of word positions.

Words are exploded with their positions; a window over each document puts the words that follow beside each word, and their
concatenations are the n-grams that begin there. Each is hashed to one of BUCKETS buckets. A bucket's gain is the scaled logarithm of
its share in the target over its share in the corpus, both smoothed by one; a document's weight is the sum of the gains of its n-grams;
weight plus Gumbel noise drawn by a hash of the id ranks the documents, and the first of them are a sample without replacement
in proportion to the importance weights.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import Tables, number_rows, order_key
from auditlake.llm.sharding import SQL_CRC_TABLE, sql_crc32

ORDER, BUCKETS, SHARE, LEAST, SEED = 3, 10_000, 5, 20, 42
#: Fixed value: what separates words, in lower-case text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Exploded words need about ten times the room of the compressed text: partitions of positions are that much smaller than those of a scan.
FINER = 8
#: More partitions than this cost more in blocks than they save in spills.
MOST_PARTS = 50_000


def words(text: Column) -> Column:
    """array<string>: the words in order; only A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def positions(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, b1 .. b<order>: for each word of each row, the buckets of the n-grams that begin at it (null past the end).

    Rows are told apart by their places, so repeated ids and texts are documents of their own; docs should be read from files, where
    places are the same whenever a lost task is run again. A row without words has one position, of null buckets.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, FINER * own.rdd.getNumPartitions()))
    table = own.repartition(parts, "row").sortWithinPartitions("row").select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "w1"))
    after = W.partitionBy("row").orderBy("pos")
    table = table.select("*", *[F.lead("w1", i).over(after).alias(f"w{i + 1}") for i in range(1, order)])
    grams = [F.concat(*[c for i in range(n) for c in (F.lit(" "), F.col(f"w{i + 1}"))][1:]) for n in range(1, order + 1)]
    return table.select("row", "doc_id", *[(F.crc32(g.cast("binary")) % buckets).cast("int").alias(f"b{n + 1}") for n, g in enumerate(grams)])


def counts(table: DataFrame, name: str, order: int = ORDER) -> DataFrame:
    """bucket, and under `name` the number of n-grams in it: pre-aggregated to the buckets in each task."""
    each = table.select(F.col("b1").alias("bucket"))
    for n in range(2, order + 1):
        each = each.unionAll(table.select(F.col(f"b{n}").alias("bucket")))
    return each.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: as many rows as there are buckets, whatever the corpus."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * (F.col("all_s") + float(buckets)) / ((s + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise of an id; a null id has that of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; target is any table with a column text.

    `share` hundredths of the rows with at least `least` words (rounded down) are drawn: those of the highest scores, ties to the smaller
    id, null ids first; the others' rank is null. Null, empty and wordless texts have no features and weight 0. Rows with equal ids are
    documents of their own with equal noise. A text of any length counts whole. Other columns are ignored, whatever their names. An empty target
    leaves smoothing alone; an empty table gives an empty result.
    """
    t = Tables(docs.sparkSession, "importance")
    table = t.keep(positions(docs, order, buckets), "positions")
    aim = positions(target.select(F.lit(0).alias("doc_id"), "text"), order, buckets)
    gain = t.keep(gains(counts(table, "s", order), counts(aim, "t", order), buckets), "gains")
    found = table
    for n in range(1, order + 1):
        found = found.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    worth = [F.coalesce(f"g{n}", F.lit(0)) for n in range(1, order + 1)]
    of = [F.count(f"b{n}") for n in range(1, order + 1)]
    per = found.groupBy("row", "doc_id").agg(of[0].alias("n_words"), sum(of[1:], of[0]).alias("n_features"), F.sum(sum(worth[1:], worth[0])).alias("weight"))
    per = per.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    # Documents that are too short are numbered after all others.
    numbered = number_rows(per, [(F.col("n_words") < least).cast("int"), -F.col("score"), order_key(F.col("doc_id"))], t)
    drawn = numbered.agg(F.count_if(F.col("row.n_words") >= least).alias("n")).select(F.expr(f"n * {share} div 100").alias("drawn"))
    rank = F.when(F.col("number") < F.col("drawn"), F.col("number") + 1)
    return numbered.join(F.broadcast(drawn)).select("row.*", rank.alias("rank"))


def _sql_grams(rows: str) -> str:
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), '{}', '{}'), '{}'), lambda x: x <> '')".format(string.ascii_uppercase, string.ascii_lowercase, BETWEEN)
    exploded = f"SELECT row_id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM (SELECT row_id, {words} AS w FROM {rows})"
    after = "".join(f", lead(w1, {i}) OVER (PARTITION BY row_id ORDER BY pos) AS w{i + 1}" for i in range(1, ORDER))
    grams = ", ".join(" || ' ' || ".join(f"w{i + 1}" for i in range(n)) for n in range(1, ORDER + 1))
    return f"SELECT * FROM (SELECT row_id, unnest([{grams}]) AS gram, unnest([1, {', '.join('0' * (ORDER - 1))}]) AS word FROM (SELECT *{after} FROM ({exploded}))) WHERE gram IS NOT NULL"


#: DuckDB SQL with the result of op13 over the views documents and benchmark.
ORACLE = f"""
WITH {SQL_CRC_TABLE},
d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
dg AS ({_sql_grams("d")}),
b AS (SELECT row_number() OVER () AS row_id, text FROM benchmark),
bg AS ({_sql_grams("b")}),
u AS (SELECT gram, {sql_crc32("gram")} % {BUCKETS} AS bucket FROM (SELECT gram FROM dg UNION SELECT gram FROM bg), crc),
s AS (SELECT bucket, count(*) AS s FROM dg JOIN u USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bg JOIN u USING (gram) GROUP BY bucket),
a AS (SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM a) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM a) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM a),
p AS (SELECT row_id, sum(word) AS n_words, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dg JOIN u USING (gram) JOIN g USING (bucket) GROUP BY row_id),
f AS (SELECT row_id, doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN p USING (row_id)),
r AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, {SHARE} * count(*) OVER () // 100 AS drawn FROM f WHERE n_words >= {LEAST})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM f LEFT JOIN r USING (row_id)
"""
