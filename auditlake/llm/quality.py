"""Quality classification by naive Bayes support vectors.

A document's features are indicators of its n-grams: character n-grams (of bytes, case and punctuation kept) and n-grams of
its words, hashed to a fixed number of columns. Each column is scaled by the log ratio of its smoothed counts in the two
classes, rows are scaled to length 1, and a linear model is fitted to them by dual coordinate descent on the hinge loss. The
weights are interpolated with their mean magnitude, as the method proposes, and margins of held-back labelled rows turn a
margin into a probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import Tables
from auditlake.llm.textkit import U, mix, odd_constants, slices

COLUMNS, SAMPLE, GRAM, COST, EPOCHS, BLEND = 1 << 18, 6000, 4, 1.0, 8, 0.25
#: Distinct n-grams of all sampled documents together: 128 MB.
CELLS = 32 << 20
_ODD = odd_constants(64, 31)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str, columns: int = COLUMNS) -> np.ndarray:
    """The distinct columns of a text's n-grams, in no order: 4 bytes in a row; two words in a row; whether a word repeats the one before."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    wide, bits = b.astype(np.uint64), U(64 - columns.bit_length() + 1)
    n = max(1, len(b) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(GRAM, len(b))):
        h += wide[k : k + n] * _ODD[k]
    out = [(h * _ODD[9]) >> bits]
    word = np.flatnonzero(np.diff((~_SPACE[b]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = word[0::2], word[1::2]
    if len(starts):
        place = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b))) if starts[0] == 0 else np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(b)))])
        value = np.where(_SPACE[b], U(0), (wide + U(1)) * _ODD[10 + (place & 31)] * (place.astype(np.uint64) + U(7)))
        w = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
        pair = w[:-1] * _ODD[50] + w[1:] * _ODD[51]
        same = np.where(w[1:] == w[:-1], U(1), U(2)) * _ODD[52]
        out += [mix(pair) >> bits, mix(same) >> bits]
    idx = np.concatenate(out).astype(np.int64)
    return idx


def distinct(idx: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each value of idx once; scratch has a cell for each column."""
    at = np.arange(len(idx), dtype=scratch.dtype)
    scratch[idx] = at
    return idx[scratch[idx] == at]


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, columns: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) of a linear hinge-loss model, by dual coordinate descent."""
    w, alpha = np.zeros(columns + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), cost * weight[i])
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = a
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a margin + b))), by damped Newton steps on smoothed targets; a is positive."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        d, h = t - p, p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(d * margin).sum() - 1e-3 * a, d.sum() - 1e-3 * b])
        size = min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a + size * float(step[0]), b + size * float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def train(rows: list[np.ndarray], labels: np.ndarray, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(scaled column weights, squared ratios, bias and slope folded) -- see scores()."""
    y = np.where(labels > 0, 1.0, -1.0)
    fit = np.arange(len(rows)) % 5 != 4
    counts = np.ones((2, columns))
    for x, c, f in zip(rows, y, fit):
        if f:
            counts[int(c > 0), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / (np.linalg.norm(v) or 1.0))
    chosen = np.flatnonzero(fit)
    share = np.array([max(1, (y[chosen] == s).sum()) for s in (-1.0, 1.0)], float)
    weight = len(chosen) / (2 * share[(y > 0).astype(int)])
    w = descend([rows[i] for i in chosen], [values[i] for i in chosen], y[chosen], weight[chosen], columns)
    mean = np.abs(w[:-1][w[:-1] != 0]).mean() if (w[:-1] != 0).any() else 0.0
    full = BLEND * np.sign(w[:-1]) * mean + (1 - BLEND) * w[:-1]
    full = np.append(full, w[-1])
    held = [i for i in range(len(rows)) if not fit[i]] or [*range(len(rows))]
    margin = np.array([full[rows[i]] @ values[i] + full[-1] for i in held])
    a, b = calibrate(margin, y[held]) if len(held) else (1.0, 0.0)
    return full[:-1] * ratio, ratio**2, a * full[-1] + b, a


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a bounded sample of labelled documents, those with the lowest hashes of doc_id: what reaches the driver.

    At most `sample` documents, and no more than have `cells` distinct n-grams together; of rows with one id the text with the
    lowest hash counts.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(sample)
    )

    def run(batches):
        import pyarrow as pa

        scratch = np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for first, texts in slices(batch):
                data = [distinct(features(t), scratch).astype("<u4").tobytes() for t in texts]
                keys = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "draw", "quality", "tie")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "draw", "quality", "tie", "n", "data"])

    t = Tables(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "draw", F.col("quality").cast("int").alias("quality"), F.xxhash64("text").alias("tie"), "text")
    found = t.keep(rows.mapInArrow(run, "doc_id bigint, draw bigint, quality int, tie bigint, n bigint, data binary"), "sample")
    one = found.groupBy("draw", "doc_id").agg(F.min(F.struct("tie", "n")).alias("least")).orderBy("draw", "doc_id")
    total, last = 0, None
    for r in one.collect():  # numbers of at most `sample` documents
        total += r["least"]["n"]
        if total > cells and last is not None:
            break
        last = r["draw"], r["doc_id"]
    if last is None:
        return [], np.zeros(0, int)
    within = (F.col("draw") < last[0]) | (F.col("draw") == last[0]) & (F.col("doc_id") <= last[1])
    kept = found.where(within).join(one.select("doc_id", F.col("least.tie").alias("tie")), ["doc_id", "tie"], "left_semi").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["quality"], r["data"]) for r in kept.select("doc_id", "quality", "data").collect()), key=lambda r: r[0])
    t.drop("sample")
    return [np.frombuffer(data, "<u4").astype(np.int64) for _, _, data in rows], np.array([q for _, q, _ in rows])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model from labels (doc_id, quality) of docs; None if the labels there don't show both classes."""
    rows, y = labelled(docs, labels, sample)
    return train(rows, y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model, *keys: str) -> DataFrame:
    """The key columns and score, the probability of label 1, of each whole text (null: empty).

    Only text is read, whole. A text without n-grams gets the score of the bias; without a model every score is 0.5. Equal texts
    have equal scores, also in repeated rows; of other columns none is read but the keys; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a column, fixed
    schema = T.StructType([*[docs.schema[c] for c in keys], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        scratch = np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for first, texts in slices(batch):
                out = []
                for t in texts:
                    if shared.value is None:
                        out.append(0.5)
                        continue
                    weights, squares, bias, slope = shared.value
                    x = distinct(features(t), scratch)
                    size = float(np.sqrt(squares[x].sum())) or 1.0
                    z = slope * float(weights[x].sum()) / size + bias
                    out.append(float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, len(texts)) for c in keys], pa.array(out, pa.float64())], names=[*keys, "score"])

    return docs.select(*dict.fromkeys([*keys, "text"])).mapInArrow(run, schema)
