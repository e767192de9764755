"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of all shingles of all documents are counted in a table of fixed size (a hash picks the counter; the
   mean load of a counter is taken off), so what is broadcast doesn't grow with the corpus.
2. A shingle's weight is its count in the text times 1 + idf * ln(N / df) / ln(N). The logarithm is damped: a text copied
   thousands of times has frequent shingles, and an undamped one would let a few edited words outweigh all it shares.
   Weights lie on a logarithmic grid of 1/16.
3. Each text gets BANDS x ROWS consistent weighted samples. Two texts agree in a sample with the probability of their
   weighted Jaccard similarity. Texts that agree in all rows of a band meet in a bucket.
4. Equal texts are one member of a bucket. Members are compared with the bucket's hub, the one that meets most others in all
   its buckets (the original of a group of copies), and what is similar is contracted to classes. Members of buckets that still
   hold several classes are compared by an exact prefix join: shingles are ordered from rare to frequent, and two texts of
   similarity s share a shingle within the leading 1 - s of their weight, a passage that a crowd shares coming last. Every pair
   that shares a bucket is so compared, of one class already, or proven unlike; no bucket is cut off.
5. Compared pairs are verified by their exact weighted Jaccard similarity. Links are contracted to connected classes by
   alternating large-star and small-star steps; every step is a written table.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import LONG_MIN, Tables, order_key, worker_cache
from auditlake.llm.textkit import GOLD, MIX1, U, mix, odd_constants, shingles, slices, word_hashes

WIDTH, SIMILAR, BANDS, ROWS, IDF, COUNTERS, BLOCKS = 5, 0.8, 12, 4, 0.25, 1 << 20, 64
LEVELS = 16
#: Bands whose buckets are worked on at a time: a group of copies brings that many rows a copy into a join.
STRIDE = 6
#: Slack of bounds on sums of weights.
SLACK = 1e-6
SHINGLE_SCHEMA = "doc bigint, shingles binary, weights binary"


def unique_shingles(texts: list[str], width: int = WIDTH):
    """(sorted distinct shingle hashes, counts) of each text."""
    words, at = word_hashes(texts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        s = shingles(words[a:b], width)
        s.sort()
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        yield s[first], np.diff(first, append=len(s))


def counter_of(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """COUNTERS document frequencies over all rows; partitions send compressed blocks, which are summed in two steps."""
    size = COUNTERS // BLOCKS

    def pack(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    def unpack(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()

    def count(batches):
        import pyarrow as pa

        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                found = [s for s, _ in unique_shingles(texts)]
                total += np.bincount(counter_of(np.concatenate(found)), minlength=COUNTERS)
        if total.any():
            salt = int(total.sum() % 16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([pack(x) for x in total.reshape(BLOCKS, size)], pa.binary())],
                names=["block", "salt", "data"],
            )

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                sums[block] = sums.get(block, 0) + unpack(data.as_py()).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([pack(x) for x in sums.values()], pa.binary())], names=["block", "salt", "data"]
            )

    schema = "block int, salt int, data binary"
    parts = docs.select("text").mapInArrow(count, schema)
    summed = parts.repartition("block", "salt").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((BLOCKS, size), np.int64)
    for r in summed.collect():  # COUNTERS counts, whatever the corpus
        out[r["block"]] += unpack(r["data"])
    return out.ravel()


def idf_levels(counters: np.ndarray, n: int, idf: float = IDF) -> np.ndarray:
    """The grid level of the idf factor for each counter."""
    load = max(0.0, (counters.sum() - counters.max(initial=0)) / len(counters))
    df = np.clip(counters - load, 1, max(1, n))
    damped = 1 + idf * np.log(max(1, n) / df) / math.log(max(2, n))
    return np.round(LEVELS * np.log(damped)).astype(np.uint8)


def weight_levels(s: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.round(LEVELS * np.log(counts)).astype(np.int64)
    return np.minimum(tf + idf[counter_of(s)], 255).astype(np.uint8)


def gamma_quantiles(n: int) -> np.ndarray:
    """Quantile midpoints of Gamma(2, 1): the inverse of 1 - (1 + x) exp(-x) by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def samplers(k: int):
    def make():
        g = gamma_quantiles(1 << 16)
        return gamma_quantiles(1 << 12).astype(np.float32), np.log(g).astype(np.float32), odd_constants(k, 77)

    return worker_cache(("icws", k), make)


def consistent_samples(s: np.ndarray, levels: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """k improved consistent weighted samples of a weighted set, as bits of the least value.

    For each element and function: r, c ~ Gamma(2, 1) and b ~ U(0, 1) are drawn from the element's hash, t = floor(ln w / r + b),
    ln a = ln c - r (t - b) - r; the element with the least ln a is the sample. That value is a function of element and t alone,
    so equal values stand for equal samples.
    """
    rs, lncs, odd = samplers(k)
    best = np.full(k, np.inf, np.float32)
    lnw = levels.astype(np.float32) * np.float32(1 / LEVELS)
    for at in range(0, len(s), block):
        m = s[None, at : at + block] * odd[:, None]
        m ^= m >> U(32)
        m *= MIX1
        r = rs[(m >> U(52)).astype(np.int32)]
        b = ((m >> U(20)) & U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        m *= GOLD
        lnc = lncs[(m >> U(48)).astype(np.int32)]
        t = np.floor(lnw[at : at + block] / r + b)
        np.minimum(best, (lnc - r * (t - b) - r).min(1), out=best)
    return best.view(np.uint32)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        grid = samples.astype(np.uint64).reshape(bands, rows) * odd_constants(rows, 5)
        return mix(grid.sum(1) + odd_constants(bands, 6)).view(np.int64)


def text_hash(text: str) -> tuple[int, int]:
    """128 bits by which equal texts are told."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))


def sketches(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc, tie, t1, t2 (hash of the text), bands array<bigint>; texts without words have null bands."""
    levels = docs.sparkSession.sparkContext.broadcast(idf)  # COUNTERS bytes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch):
                seen = {}
                fresh = [*dict.fromkeys(texts)]
                for t, (s, n) in zip(fresh, unique_shingles(fresh)):
                    seen[t] = band_keys(consistent_samples(s, weight_levels(s, n, levels.value), bands * rows), bands, rows) if len(s) else None
                out, (t1, t2) = [seen[t] for t in texts], zip(*map(text_hash, texts))
                keys = [batch.column(c).slice(first, len(texts)) for c in ("doc", "tie")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc", "tie", "t1", "t2", "bands"]
                )

    return docs.select("doc", "tie", "text").mapInArrow(run, "doc bigint, tie bigint, t1 bigint, t2 bigint, bands array<bigint>")


def shingle_store(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc, shingles (32 bits each, ascending), weights (a grid level each) of the rows whose text has the hash t1, t2."""
    levels = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [*zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())]
            for first, texts in slices(batch):
                rows = [i for i, t in enumerate(texts) if text_hash(t) == keys[first + i]]
                a, b = [], []
                for s, n in unique_shingles([texts[i] for i in rows]):
                    a.append((s >> U(32)).astype("<u4").tobytes())
                    b.append(weight_levels(s, n, levels.value).tobytes())
                ids = batch.column("doc").take(pa.array([first + i for i in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc", "shingles", "weights"])

    return docs.select("doc", "text", "t1", "t2").mapInArrow(run, SHINGLE_SCHEMA)


_WEIGHT = np.exp(np.arange(256) / LEVELS)


def weighted_jaccard(a: bytes, aw: bytes, b: bytes, bw: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    v, w = _WEIGHT[np.frombuffer(aw, np.uint8)], _WEIGHT[np.frombuffer(bw, np.uint8)]
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    o = both[order]
    # Equal hashes in one text (of two shingles, by chance) are no agreement.
    i = np.flatnonzero((o[1:] == o[:-1]) & (order[:-1] < len(x)) & (order[1:] >= len(x)))
    least = np.minimum(v[order[i]], w[order[i + 1] - len(x)]).sum() if len(i) else 0.0
    return float(least / (v.sum() + w.sum() - least))


def verified(edges: DataFrame, store: DataFrame) -> DataFrame:
    """Adds sim, the weighted Jaccard similarity, to edges (doc, hub)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c) for c in ("shingles", "weights", "hs", "hw")]
            sims = [weighted_jaccard(*(c[i].as_py() for c in cols)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hub"), pa.array(sims, pa.float64())], names=["doc", "hub", "sim"])

    hubs = store.select(F.col("doc").alias("hub"), F.col("shingles").alias("hs"), F.col("weights").alias("hw"))
    return edges.join(store, "doc").join(hubs, "hub").select("doc", "hub", "shingles", "weights", "hs", "hw").mapInArrow(run, "doc bigint, hub bigint, sim double")


def classes_of(spark: SparkSession, edges: DataFrame, t: Tables, most: int = 40) -> DataFrame:
    """node, class (the least node of its connected class) for the nodes of edges (a, b), by large-star and small-star steps."""
    now, step = t.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc0"), 0
    before = None
    for step in range(1, most + 1):
        # Large star: every larger neighbour points to the least node around.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = t.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"large{step}")
        large = t.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"ls{step}")
        # Small star: every smaller neighbour and the node itself point to the least of them.
        low = t.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"small{step}")
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = t.keep(small, f"cc{step}")
        mark = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        t.drop(f"large{step}", f"ls{step}", f"small{step}", f"cc{step - 1}")
        now = small
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"links did not contract in {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("class")).groupBy("node").agg(F.min("class").alias("class"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, idf: float = IDF) -> DataFrame:
    """doc_id, class_id, n_links, tie: the near-duplicate class of each row.

    class_id is the lowest doc_id of the class; n_links counts the verified links of the row's text to other texts. Equal
    texts are of one class, also texts without words (null counts as empty), which are like no other text. Rows with equal
    ids and different texts are compared like any others, but share one id: they are told apart by tie, xxhash64 of the
    text. Null ids come first. Texts of any length count whole; only doc_id and text are read, whatever other columns there are.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    t = Tables(spark, "neardup")
    text = F.coalesce("text", F.lit(""))
    own = docs.select(order_key(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    n = own.count()
    counters = document_frequencies(own)
    levels = idf_levels(counters, n, idf)
    sketch = t.keep(sketches(own, levels, bands, rows), "sketch")
    # One member for each text: the lowest id. Ids may repeat, so members are named by a hash of the text.
    texts = t.keep(
        sketch.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.min_by("bands", "doc").alias("bands")).select("t1", "t2", "first", F.xxhash64("t1", "t2").alias("member"), "bands"), "texts"
    )
    buckets = texts.where(F.col("bands").isNotNull()).select("member", F.posexplode("bands").alias("band", "value")).select("band", F.xxhash64("band", "value").alias("key"), "member")
    parts, links = [range(a, min(a + STRIDE, bands)) for a in range(0, bands, STRIDE)], []
    for k, part in enumerate(parts):
        mine = buckets.where(F.col("band").between(part[0], part[-1]))
        shared = t.keep(mine.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"shared{k}")
        met = t.keep(mine.join(shared, "key"), f"met{k}")
        # Members by how many others they meet: the original of a group of copies meets the most, so it becomes the hub.
        t.keep(met.groupBy("member").agg(F.sum("n").alias("rank")), f"ranks{k}")
    ranks = [spark.read.schema("member bigint, rank bigint").parquet(t.path(f"ranks{k}")) for k in range(len(parts))]
    members = ranks[0].select("member")
    for r in ranks[1:]:
        members = members.unionByName(r.select("member"))
    wanted = texts.join(t.keep(members.distinct(), "members"), "member", "left_semi").select("member", F.col("first").alias("doc"), "t1", "t2")
    store = t.keep(_store(own, wanted, levels), "store")
    for k, rank in enumerate(ranks):
        met = spark.read.schema("key bigint, band int, member bigint, n bigint").parquet(t.path(f"met{k}"))
        links.append(_hub_links(t, k, met.join(rank, "member").select("key", "member", "rank"), store, similar))
    near = t.keep(_union(links).distinct(), "near")
    hubs = t.keep(classes_of(spark, near.select(F.col("doc").alias("a"), F.col("hub").alias("b")), t), "hubclasses")
    mixed = []
    for k in range(len(parts)):
        met = spark.read.schema("key bigint, band int, member bigint, n bigint").parquet(t.path(f"met{k}"))
        both = met.join(hubs.withColumnRenamed("node", "member"), "member", "left").select("key", "member", F.coalesce("class", "member").alias("class"))
        of = W.partitionBy("key")
        both = both.withColumns({"_a": F.min("class").over(of), "_b": F.max("class").over(of)}).where("_a < _b")
        mixed.append(t.keep(both.select("member", "class").distinct(), f"mixed{k}"))
    rest = _prefix_links(t, t.keep(_union(mixed).distinct(), "mixed"), store, frequency_levels(counters, n), similar)
    edges = t.keep(near.unionByName(rest).distinct(), "edges")
    # Classes of classes: the links of the prefix join, between the classes of the hubs.
    start, end = (hubs.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class")) for c in ("doc", "hub"))
    between = rest.join(start, "doc", "left").join(end, "hub", "left").select(F.coalesce("doc_class", "doc").alias("a"), F.coalesce("hub_class", "hub").alias("b"))
    joint = t.keep(classes_of(spark, between, Tables(spark, "neardup")), "joint").select(F.col("node").alias("class"), F.col("class").alias("_joint"))
    ends = edges.select(F.col("doc").alias("member")).unionByName(edges.select(F.col("hub").alias("member")))
    degree = ends.groupBy("member").agg(F.count(F.lit(1)).alias("n_links"))
    named = texts.select("t1", "t2", "first", "member").join(hubs.withColumnRenamed("node", "member"), "member", "left").join(degree, "member", "left")
    named = named.withColumn("class", F.coalesce("class", "member")).join(joint, "class", "left")
    named = named.select("t1", "t2", "first", F.coalesce("_joint", "class").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    named = t.keep(named, "named")
    least = named.groupBy("class").agg(F.min("first").alias("class_id"))
    final = t.keep(named.join(t.keep(least, "least"), "class").select("t1", "t2", "class_id", "n_links"), "final")
    t.drop("store")
    return sketch.join(final, ["t1", "t2"]).select(
        *[F.when(F.col(c) != F.lit(LONG_MIN), F.col(c)).alias(name) for c, name in (("doc", "doc_id"), ("class_id", "class_id"))], "n_links", "tie"
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _hub_links(t: Tables, part: int, groups: DataFrame, store: DataFrame, similar: float) -> DataFrame:
    """Verified links (doc, hub) of members with the hubs of their groups (key, member, rank)."""
    best = F.max(F.struct("rank", "member")).over(W.partitionBy("key"))["member"]
    pairs = groups.select("member", best.alias("hub")).where("member <> hub").select(F.greatest("member", "hub").alias("doc"), F.least("member", "hub").alias("hub")).distinct()
    return t.keep(verified(pairs, store).where(F.col("sim") >= similar).select("doc", "hub"), f"links{part}")


def frequency_levels(counters: np.ndarray, n: int) -> np.ndarray:
    """Document frequencies on a logarithmic grid, by which shingles are ordered from rare to frequent."""
    load = max(0.0, (counters.sum() - counters.max(initial=0)) / len(counters))
    return np.minimum(np.round(6 * np.log2(np.clip(counters - load, 1, max(1, n)))), 255).astype(np.uint8)


def prefix(s: np.ndarray, weights: np.ndarray, order: np.ndarray, similar: float):
    """(total weight, leading shingles, the weight from each on): those with at least `similar` of the weight from there on.

    Two texts' common weight lies at and after their first common shingle, and is at least `similar` of either's weight.
    """
    w = _WEIGHT[weights]
    by = np.lexsort((s, order[s >> np.uint32(32 - COUNTERS.bit_length() + 1)]))
    rest = np.cumsum(w[by][::-1])[::-1]
    n = int((rest >= similar * rest[0] - SLACK).sum())
    return float(rest[0]), s[by[:n]].astype(np.int64), rest[:n]


def _prefix_links(t: Tables, members: DataFrame, store: DataFrame, order: np.ndarray, similar: float) -> DataFrame:
    """Verified links (doc, hub) between members (member, class) of different classes: all pairs that are similar."""
    levels = members.sparkSession.sparkContext.broadcast(order)  # COUNTERS bytes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, classes = batch.column("doc").to_numpy(), batch.column("class").to_numpy()
            found = [prefix(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), np.uint8), levels.value, similar) for a, b in zip(batch.column("shingles"), batch.column("weights"))]
            n = [len(s) for _, s, _ in found]
            if found:
                cols = [np.concatenate([s for _, s, _ in found]), np.repeat(ids, n), np.repeat(classes, n), np.repeat([x for x, _, _ in found], n), np.concatenate([r for _, _, r in found])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["shingle", "member", "class", "total", "rest"])

    texts = store.join(members.withColumnRenamed("member", "doc"), "doc").select("doc", "class", "shingles", "weights")
    rows = t.keep(texts.mapInArrow(run, "shingle bigint, member bigint, class bigint, total double, rest double"), "prefixes")
    # Shingles of one class need no comparison; of the others, all but the largest class meet everyone.
    of = rows.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("n", "class")).alias("main"))
    rows = t.keep(rows.join(of.where("classes > 1").select("shingle", "main"), "shingle"), "shared_prefixes")
    a, b = rows.where("class <> main").drop("main"), rows.select("shingle", *[F.col(c).alias(f"o_{c}") for c in ("member", "class", "total", "rest")])
    # The lighter text of a pair shares a shingle within an even shorter part: the common weight is s / (1 + s) of both weights at least.
    light, heavy = F.least("total", "o_total"), F.greatest("total", "o_total")
    least = F.lit(similar / (1 + similar)) * (light + heavy) - F.lit(SLACK)
    alike = (F.col("class") != F.col("o_class")) & (light >= F.lit(similar) * heavy - F.lit(SLACK)) & (F.least("rest", "o_rest") >= least)
    pairs = a.join(b, "shingle").where(alike).select(F.greatest("member", "o_member").alias("doc"), F.least("member", "o_member").alias("hub")).distinct()
    good = t.keep(verified(t.keep(pairs, "prefix_pairs"), store).where(F.col("sim") >= similar).select("doc", "hub"), "prefix_links")
    t.drop("prefixes", "shared_prefixes")
    return good


def _store(docs: DataFrame, wanted: DataFrame, levels: np.ndarray) -> DataFrame:
    """The shingles of the wanted members, from one document of each (rows that only share its id are left out)."""
    rows = docs.withColumn("_h", F.xxhash64("text")).join(wanted, "doc").dropDuplicates(["doc", "member", "_h"])
    return shingle_store(rows.select(F.col("member").alias("doc"), "text", "t1", "t2"), levels)
