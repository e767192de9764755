"""Packing documents into token sequences by cutting-stock column generation.

Documents are tokenized once; what is kept of them is their length and the checksums of their pieces: whole sequences of
SEQ ids, and a rest. Rests are the items of a cutting-stock problem over length classes of `grain` tokens. A linear program
over patterns (how many items of each class share a sequence) is solved by column generation: the simplex method's dual
prices go to a knapsack dynamic program, which finds the pattern of most value. Patterns are rounded down, the bounded rest
is packed first-fit decreasing, and documents, ranked by id in their class, take the patterns' places in order.

The room that length classes leave is filled from a small hashed share of the documents, cut wherever the room ends; what
remains of them goes to whole sequences and, at the very end, to sequences of powers of two, which need no padding.

Only class counts (buckets x classes) reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.bpe import CHARS, encoder, vocabulary
from auditlake.llm.common import Tables, bucket_of, id_cuts, order_key, small_frame
from auditlake.llm.textkit import slices

SEQ, GRAIN, END, SPARE = 4096, 16, 2, 1.15
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def priced_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable counts of items of the given sizes that fit the room."""
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        value[w] = value[w - 1]
        k = int(np.searchsorted(sizes, w, "right"))
        if k:
            v = value[w - sizes[:k]] + prices[:k]
            i = int(v.argmax())
            if v[i] > value[w] + 1e-12:
                value[w], pick[w] = v[i], i
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return float(value[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of the linear program: fewest sequences that hold all items. sizes ascend; demand is positive.

    A program that is not solved after `most` pivots is an error.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)  # column p: items of each class
    inverse, amounts = np.diag(1.0 / (room // sizes)), demand / (room // sizes)
    for _ in range(most):
        prices = inverse.sum(0)  # each pattern costs one sequence
        value, counts = priced_pattern(prices, sizes, room)
        if value <= 1 + 1e-7:
            return patterns.astype(np.int64), amounts
        way = inverse @ counts
        ratio = np.where(way > 1e-9, amounts / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amounts = np.maximum(amounts - step * way, 0)
        amounts[out] = step
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        patterns[:, out] = counts
    raise RuntimeError(f"the linear program of {m} classes is not solved after {most} pivots")


def packed_patterns(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """[(items of each class in a sequence, number of such sequences)], holding each class's demand exactly."""
    left = {c: int(n) for c, n in demand.items() if n > 0}
    if not left:
        return []
    sizes = np.array(sorted(left))
    patterns, amounts = column_generation(sizes, np.array([left[c] for c in sizes], float), room)
    out = []
    for p in range(len(sizes)):
        counts = {int(c): int(k) for c, k in zip(sizes, patterns[:, p]) if k}
        times = min([int(amounts[p] + 1e-6), *(left[c] // k for c, k in counts.items())])
        if times > 0:
            out.append((counts, times))
            for c, k in counts.items():
                left[c] -= times * k
    # What rounding leaves is less than a sequence for each pattern.
    while any(left.values()):
        free, counts = room, {}
        for c in sorted(left, reverse=True):
            k = min(left[c], free // c)
            if k:
                counts[c] = k
                free -= k * c
        times = min(left[c] // k for c, k in counts.items())
        for c, k in counts.items():
            left[c] -= times * k
        out.append((counts, times))
    return out


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def measured(docs: DataFrame, path: str, end: int, seq: int) -> DataFrame:
    """doc, tie, n (ids with the end id), crcs: the checksum of each whole sequence and of the rest of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, chars=CHARS):
                enc = encoder(path)
                n, crcs = [], []
                for ids in enc.encode(texts):
                    data = _bytes(ids, end)
                    n.append(len(data) // 4)
                    crcs.append([zlib.crc32(data[a : a + 4 * seq]) for a in range(0, len(data), 4 * seq)])
                keys = [batch.column(c).slice(first, len(texts)) for c in ("doc", "tie")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc", "tie", "n", "crcs"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "doc bigint, tie bigint, n bigint, crcs array<bigint>")


def _bytes(ids: np.ndarray, end: int) -> memoryview:
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end
    return memoryview(out).cast("B")


def pack(docs: DataFrame, path: str | None = None, end: int = END, seq: int = SEQ, grain: int = GRAIN, spare: float = SPARE, rows_each: int = 4096) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id (and the end id) of each row lies in exactly one piece. Null texts are empty and have their end id alone. Rows
    with equal ids are documents of their own, ordered by a hash of the text; null ids come first. No rows give no pieces.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    t = Tables(spark, "pack")
    text = F.coalesce("text", F.lit(""))
    own = docs.select(order_key(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    lengths = t.keep(measured(own, path, end, seq), "lengths")
    cuts = id_cuts(lengths.select("doc"), F.col("doc"), rows_each, 1024)
    room = seq // grain
    draw = F.pmod(F.xxhash64(F.lit("fill"), "doc", "tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = lengths.withColumns({"bucket": bucket_of(F.col("doc"), cuts).cast("int"), "whole": F.floor(F.col("n") / seq), "rest": F.col("n") % seq, "draw": draw})
    rows = rows.withColumn("class", F.ceil(F.col("rest") / grain).cast("int"))

    def counts(of: DataFrame) -> dict:
        return {(r["bucket"], r["class"]): r for r in of.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("rest"), F.sum("whole").alias("whole"), F.sum("n").alias("ids")).collect()}

    def room_left(have: dict) -> tuple[list, int]:
        demand: dict[int, int] = {}
        for (_, c), r in have.items():
            if c:
                demand[c] = demand.get(c, 0) + r["n"]
        plan = packed_patterns(demand, room)
        return plan, sum(k for _, k in plan) * seq - sum(r["rest"] for r in have.values())

    have = counts(rows)
    plan, slack = room_left(have)
    total = sum(r["ids"] for r in have.values())
    share = min(1.0, spare * slack / total) if total else 0.0
    # The filling documents are a hashed share; it grows until they hold as many ids as there is room.
    while True:
        have = counts(rows.where(F.col("draw") >= share))
        plan, slack = room_left(have)
        if share >= 1.0 or total - sum(r["ids"] for r in have.values()) >= slack:
            break
        share = min(1.0, 1.3 * share + 1e-4)
    main, fill = rows.where(F.col("draw") >= share), rows.where(F.col("draw") < share)
    placed, base = _placed(spark, main, have, plan, t)
    whole = _whole(spark, main, have, base, seq)
    base += sum(r["whole"] for r in have.values())
    filled = _filled(spark, own, fill, placed, base, t, path, end, seq, cuts, share)
    doc_id = F.when(F.col("doc") != F.lit(-(2**63)), F.col("doc")).alias("doc_id")
    rest = placed.select("doc", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return whole.unionByName(rest).unionByName(filled).select(doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _offsets(have: dict, value) -> list[tuple[int, int, int]]:
    """(bucket, class, sum of value in the same class of lower buckets)."""
    seen: dict[int, int] = {}
    out = []
    for b, c in sorted(have):
        out.append((b, c, seen.get(c, 0)))
        seen[c] = seen.get(c, 0) + value(have[b, c])
    return out


def _placed(spark: SparkSession, main: DataFrame, have: dict, plan: list, t: Tables) -> tuple[DataFrame, int]:
    """Rests with sequence_id and offset; the number of sequences used."""
    slots, taken, base = [], {}, 0
    for counts, times in plan:
        at = 0
        for c, k in sorted(counts.items(), reverse=True):
            first = taken.get(c, 0)
            slots.append((c, first, first + times * k, k, base, at))
            taken[c] = first + times * k
            at += k
        base += times
    # Both tables are bounded: buckets x classes, and patterns x their classes.
    ranks = small_frame(spark, _offsets({k: v for k, v in have.items() if k[1]}, lambda r: r["n"]), "bucket int, class int, before bigint")
    places = small_frame(spark, slots, "class int, low bigint, high bigint, each bigint, base bigint, slot bigint")
    order = W.partitionBy("bucket", "class").orderBy("doc", "tie")
    ranked = (
        main.where("rest > 0").withColumn("_r", F.row_number().over(order) - 1).join(F.broadcast(ranks), ["bucket", "class"])
        .withColumn("rank", F.col("before") + F.col("_r")).drop("_r", "before")
    )
    at = ranked.alias("r").join(F.broadcast(places.alias("p")), (F.col("r.class") == F.col("p.class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = at.select("doc", "tie", "n", "rest", "crcs", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("sequence_id"), (F.col("slot") + (F.col("rank") - F.col("low")) % F.col("each")).alias("slot"))
    before = F.sum("rest").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    return t.keep(at.withColumn("offset", F.coalesce(before, F.lit(0))), "placed"), base


def _whole(spark: SparkSession, main: DataFrame, have: dict, base: int, seq: int) -> DataFrame:
    """Whole sequences of long documents, numbered from base by document and position."""
    per: dict[int, int] = {}
    for (b, _), r in have.items():
        per[b] = per.get(b, 0) + r["whole"]
    firsts = small_frame(spark, [(b, base + first) for b, _, first in _offsets({(b, 0): n for b, n in per.items()}, lambda n: n)], "bucket int, first bigint")
    before = F.sum("whole").over(W.partitionBy("bucket").orderBy("doc", "tie").rowsBetween(W.unboundedPreceding, -1))
    long = main.where("whole > 0").withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(firsts), "bucket")
    each = long.select("doc", "n", "whole", (F.col("first") + F.col("_before")).alias("first"), F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("pos", "crc"))
    return each.select(
        "doc", (F.col("pos").cast("bigint") * seq).alias("start"), F.lit(seq).cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("first") + F.col("pos")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )


def _filled(spark, own: DataFrame, fill: DataFrame, placed: DataFrame, base: int, t: Tables, path: str, end: int, seq: int, cuts: list[int], share: float) -> DataFrame:
    """Pieces of the filling documents: a stream of ids, cut where the room of sequences ends."""
    used = placed.groupBy("sequence_id").agg(F.sum("rest").alias("used")).where(F.col("used") < seq)
    most = placed.agg(F.max("sequence_id")).first()[0]
    width = max(1, -(-((most or 0) + 1) // 1024))
    rooms = t.keep(used.withColumn("part", F.floor(F.col("sequence_id") / width).cast("int")).withColumn("room", F.lit(seq) - F.col("used")), "rooms")
    sums = sorted((r[0], r[1]) for r in rooms.groupBy("part").agg(F.sum("room")).collect())
    slack = sum(n for _, n in sums)
    before = F.coalesce(F.sum("room").over(W.partitionBy("part").orderBy("sequence_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = small_frame(spark, [(p, f) for p, _, f in _offsets({(p, 0): n for p, n in sums}, lambda n: n)], "part int, first bigint")
    gaps = rooms.withColumn("_b", before).join(F.broadcast(firsts), "part").select((F.col("first") + F.col("_b")).alias("low"), (F.col("first") + F.col("_b") + F.col("room")).alias("high"), "sequence_id", F.col("used").alias("offset"))
    sums = sorted((r[0], r[1]) for r in fill.groupBy("bucket").agg(F.sum("n")).collect())
    ids = sum(n for _, n in sums)
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("doc", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = small_frame(spark, [(b, f) for b, _, f in _offsets({(b, 0): n for b, n in sums}, lambda n: n)], "bucket int, first bigint")
    # Repeated rows are numbered, so that each keeps its own stretch of the stream.
    copy = F.row_number().over(W.partitionBy("bucket", "doc", "tie").orderBy("n"))
    stream = fill.withColumn("_b", before).withColumn("copy", copy).join(F.broadcast(firsts), "bucket")
    stream = t.keep(stream.select("doc", "tie", "copy", "n", (F.col("first") + F.col("_b")).alias("low"), (F.col("first") + F.col("_b") + F.col("n")).alias("high")), "stream")
    over = max(0, ids - slack)
    at = F.lit(slack) + F.col("id") * seq
    more = spark.range(over // seq).select(at.alias("low"), (at + seq).alias("high"), (F.lit(base) + F.col("id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    tail, low = [], slack + over // seq * seq
    for i, size in enumerate(powers_of_two(over % seq)):
        tail.append((low, low + size, base + over // seq + i, 0))
        low += size
    gaps = gaps.unionByName(more).unionByName(small_frame(spark, tail, "low bigint, high bigint, sequence_id bigint, offset bigint"))
    # Overlaps of two sets of disjoint stretches: they meet in the block in which the later one begins.
    block = lambda df: df.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / seq), F.floor((F.col("high") - 1) / seq))))
    a, b = block(stream).alias("a"), block(gaps).alias("b")
    met = a.join(b, "block").where("a.low < b.high and b.low < a.high").where(F.col("block") == F.floor(F.greatest("a.low", "b.low") / seq))
    low, high = F.greatest("a.low", "b.low"), F.least("a.high", "b.high")
    cut = met.select("doc", "tie", "copy", "n", (low - F.col("a.low")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("b.offset") + low - F.col("b.low")).alias("offset"))
    whole = cut.groupBy("doc", "tie", "copy").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    draw = F.pmod(F.xxhash64(F.lit("fill"), "doc", "tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = own.where(draw < share).withColumn("copy", F.row_number().over(W.partitionBy("doc", "tie").orderBy("text")))
    return _checked(texts.join(whole, ["doc", "tie", "copy"]), path, end)


def _checked(rows: DataFrame, path: str, end: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs, sizes, pieces = (batch.column(c).to_pylist() for c in ("doc", "n", "pieces"))
            for first, texts in slices(batch, chars=CHARS):
                out = []
                for i, ids in enumerate(encoder(path).encode(texts), first):
                    data = _bytes(ids, end)
                    out += [(docs[i], p["start"], p["length"], zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])]), sizes[i], p["sequence_id"], p["offset"]) for p in pieces[i]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.select("doc", "text", "n", "pieces").mapInArrow(run, "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
