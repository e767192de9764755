"""Sharding, fill-in-middle and importance resampling against brute-force versions, on small tables and on odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import importance, infill, queries, sharding
from auditlake.llm.common import Tables, number_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def id_first(doc_id):
    return (doc_id is not None, doc_id or 0)


# 11


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    one = sharding.Permutation(n)
    there = one.positions(np.arange(n))
    assert sorted(there.tolist()) == list(range(n)) and (one.rows(there) == np.arange(n)).all()
    if n >= 1000:
        assert (there != sharding.Permutation(n, seed=12).positions(np.arange(n))).any()
        # A shuffle: neighbours part, and each sixteenth of the rows is spread evenly over the shards.
        assert np.mean(np.abs(np.diff(there)) < n / 100) < 0.05
        counts = np.bincount(there[: n // 16 * 4] % 16, minlength=16)
        assert counts.min() > 0 and counts.std() < 3 * math.sqrt(n / 64)


def test_permutation_of_very_many_rows():
    n = 10**17 + 7
    one = sharding.Permutation(n)
    some = np.array([0, 1, 2, n // 2, n - 1])
    there = one.positions(some)
    assert (one.rows(there) == some).all() and there.max() < n and len({*there.tolist()}) == 5
    with pytest.raises(ValueError):
        one.positions([n])
    with pytest.raises(ValueError):
        sharding.Permutation(1 << 63)


def placed_by_hand(rows, shards=16):
    """(doc_id, size, crc) in order -> Counter of result rows."""
    rows = sorted(rows, key=lambda r: (*id_first(r[0]), *r[1:]))
    at = sharding.Permutation(len(rows)).positions(np.arange(len(rows))).tolist()
    return Counter((*r, p % shards, p // shards) for r, p in zip(rows, at))


def test_sharding_query(spark, real, odd, none):
    def facts(df):
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        return [(i, len(t) + 1, zlib.crc32(t)) for i, t in texts]

    got = queries.op11_sharding(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == placed_by_hand(facts(real))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    for df in (odd, none, odd.where("doc_id = 1")):
        out = sharding.shuffle(sharding.sized(df), ties=["size", "text_crc32"]).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out) == placed_by_hand(facts(df))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_one_key_in_most_rows_is_dealt_to_many_tasks(spark, uncoalesced):
    df = spark.range(0, 3000, numPartitions=6).select(F.when(F.col("id") < 2700, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    t = Tables(spark, "test")
    got = number_rows(df, [F.col("doc_id")], t).select("number", "row.doc_id").orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(3000)) and [r["doc_id"] for r in got] == [7] * 2700 + list(range(2700, 3000))
    files = spark.read.parquet(t.path("ordered")).groupBy("_metadata.file_name").count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 2000


def test_shards_are_written_and_found_by_computing(spark, odd):
    clash = odd.withColumn("shard", F.lit("mine"))
    assert {"_shard", "slot", "row_number", "shard", "sketch"} <= {*sharding.shuffle(clash, 3).columns}
    out = Tables(spark, "test").path("shards")
    sharding.write_shards(sharding.shuffle(odd, 3), out)
    rows = spark.read.parquet(out).collect()
    order = sharding.Permutation(len(rows))
    assert len(rows) == odd.count()
    for r in rows:
        assert order.rows([r["slot"] * 3 + r["shard"]]).tolist() == [r["row_number"]]
    part = sharding.read_shard(spark, out, 1, 1, 2)
    assert sorted(r["slot"] for r in part.collect()) == [1, 2] and {r["shard"] for r in part.collect()} == {1}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "GreaterThanOrEqual(slot,1)" in plan


# 12


def infilled(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, real, odd, none):
    marked = spark.createDataFrame([(i, t) for i in range(40) for t in ("a <P> b", "x<S>", "<M>", "\n\n\0 é İ 𝄞 aB", "<P")], "doc_id bigint, text string")
    big = spark.createDataFrame([(i, "ab1 " * 300_000) for i in range(3)], "doc_id bigint, text string")
    for df in (real, odd, none, marked, big):
        got = infill.fill_in_middle(df).select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256").collect()
        assert len(got) == df.count()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for r in got:
            text = r["text"] or ""
            want = infilled(r["doc_id"], text)
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
            assert r["output_sha256"] == sha(want[-1]) and r["restored_sha256"] == sha(text) and infill.restore(r["output"], r["form"]) == text
    forms = Counter(r["form"] for r in queries.op12_fill_in_middle(spark, SF).collect())
    assert {*forms} == {"plain", "psm", "spm"} and sum(forms.values()) == real.count()
    with pytest.raises(ValueError):
        infill.restore("no mark", "psm")


# 13


def resampled(docs, targets, share=5, least=20):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own, aim = [grams(t) for _, t in docs], [b for t in targets for b in grams(t)[1]]
    s, t = Counter(b for _, g in own for b in g), Counter(aim)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for (doc_id, _), (n, g) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([doc_id, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], *id_first(r[0])))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[5] = i + 1
    return Counter(map(tuple, rows))


def test_importance_resampling(spark, real, odd, none):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    for df, aim, aims, share in ((real, target, texts, 5), (odd, target, texts, 50), (odd, target.where("false"), [], 100), (none, target, texts, 5)):
        got = Counter(tuple(r[c] for c in columns) for r in importance.resample(df, aim, share).collect())
        want = resampled([(r["doc_id"], r["text"]) for r in df.collect()], aims, share)
        # Rows that agree in score and id take any order.
        assert sum(r[-1] is not None for r in got.elements()) == sum(r[-1] is not None for r in want.elements())
        assert got == want or df is odd and Counter(r[:-1] for r in got.elements()) == Counter(r[:-1] for r in want.elements())
    drawn = [r for r in queries.op13_importance(spark, SF).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1)) and drawn
