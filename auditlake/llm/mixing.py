"""Mixing sources to target weights by soft membership, with DataFrame functions alone.

A labelled table trains a multinomial naive Bayes classifier over hashed words, which gives each document a posterior over
domains. Each document's nonnegative rate x_d is then fitted by projected gradient descent to
    1/2 r' M r + ridge/2 sum_d w_d (x_d - 1)^2,   r = sum_d x_d w_d p_d - tau,
where w_d is the document's share of all tokens, p_d its posterior and tau the wanted tokens of each domain as a share of
all tokens: expected domain totals match the targets, and rates stay near 1 where they may. M, the inverse of the documents'
second moments sum_d w_d p_d p_d', weighs domains alike, however small, and lets the descent converge in few steps.

A step is one pass over the documents' posteriors and rates; only its sums (a number for each domain) reach the driver. The
rates are written every few steps, so plans stay short. Tokens are words between white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Tables, let, order_key

BINS, SAMPLE, RIDGE, STEPS, TOLERANCE = 1 << 14, 10_000, 1e-4, 1000, 1e-4
#: Steps between two written tables of rates.
STRIDE = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \t\r\n]+"), "")


def bin_of(word: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(bins)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], bins: int = BINS, sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Log priors, and log word-bin likelihoods for each domain, from at most `sample` labelled documents (by a hash of doc_id).

    labelled: doc_id, domain. The counts that reach the driver are bins x domains at most. Smoothing is by one half.
    """
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counts = rows.select("domain", F.explode(F.transform(words(F.col("text")), lambda w: bin_of(w, bins))).alias("bin"))
    found = counts.groupBy("bin").pivot("domain", domains).count().na.fill(0).collect()
    per = dict(labelled_counts(rows))
    total = sum(per.values())
    prior = [math.log((per.get(d, 0) + 0.5) / (total + 0.5 * len(domains))) for d in domains]
    table = [[0.5] * bins for _ in domains]
    for r in found:
        for i, d in enumerate(domains):
            table[i][r["bin"]] += r[d]
    logs = []
    for t in table:
        s = sum(t)
        logs.append([math.log(x / s) for x in t])
    return prior, logs


def labelled_counts(rows: DataFrame) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in rows.groupBy("domain").count().collect()]


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """doc, tie (the row's key), n_tokens, p array<double>: a posterior over the domains; a text without words gets the prior."""
    prior, logs = model
    k = len(prior)
    # Differences to the last domain: k - 1 sums over the words.
    tables = [_doubles([a - b for a, b in zip(logs[i], logs[-1])]) for i in range(k - 1)]

    def adding(table: Column):
        return lambda s, x: s + F.get(table, x)

    def score(b: Column) -> Column:
        sums = [F.aggregate(b, F.lit(prior[i] - prior[-1]), adding(tables[i])) for i in range(k - 1)]
        n = F.size(b)
        return F.named_struct(F.lit("n"), n.cast("bigint"), F.lit("s"), F.array(*sums, F.lit(0.0)))

    def soft(s: Column) -> Column:
        top = F.array_max(s)
        e = F.transform(s, lambda x: F.exp(x - top))
        return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(v, lambda x: x / z)))

    bins = len(logs[0])
    scored = docs.select(
        order_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("tie"),
        let(F.transform(words(F.col("text")), lambda w: bin_of(w, bins)), score).alias("r"),
    )
    return scored.select("doc", "tie", F.col("r.n").alias("n_tokens"), soft(F.col("r.s")).alias("p"))


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a small positive matrix, by elimination."""
    k = len(m)
    rows = [[*r, *(float(i == j) for j in range(k))] for i, r in enumerate(m)]
    for i in range(k):
        best = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(k):
            if j != i:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[k:] for r in rows]


def fit_rates(
    table: DataFrame, targets: list[float], ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE, stretch: float = 1.0, anchor: int | None = None, most: float | None = None
) -> tuple[DataFrame, dict]:
    """(table with rate, report) for a table of posteriors.

    targets: wanted shares of the domains in the mixture. Its size is the largest that needs no domain more often than it
    is there, or that uses the anchor domain once, whatever the others have; times stretch. Rates are at most `most`, where
    it is given: with 1, what is fitted is what a draw keeps. Without any token every rate is 1. A descent that has not come
    to rest (a step moves rates by less than `tolerance`, as a mean square) after `steps` steps is an error.
    """
    k, t = len(targets), Tables(table.sparkSession, "rates")
    p = lambda i: F.get("p", F.lit(i))
    total, *sums = table.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * p(i)) for i in range(k)], *[F.sum(F.col("n_tokens") * p(i) * p(j)) for i in range(k) for j in range(k)]).first()
    if not total:
        return table.withColumn("rate", F.lit(1.0)), {"have": [0.0] * k, "want": [0.0] * k, "got": [0.0] * k, "steps": 0}
    have, moments = sums[:k], [x / total for x in sums[k:]]
    size = stretch * min(have[i] / targets[i] for i in range(k) if targets[i] > 0 and anchor in (None, i))
    tau = [size * x / total for x in targets]
    # A little of the trace keeps the matrix invertible where domains can't be told apart.
    slack = 1e-6 * sum(moments[i * k + i] for i in range(k))
    metric = inverse([[moments[i * k + j] + slack * (i == j) for j in range(k)] for i in range(k)])
    state = table.select("doc", "tie", "n_tokens", "p", (F.col("n_tokens") / F.lit(float(total))).alias("w"), *[p(i).alias(f"p{i}") for i in range(k)], F.lit(1.0).alias("x"), F.lit(1.0).alias("before"))
    now = last = [x / total for x in have]
    step, age, written = 1.0 / (1.0 + ridge), 1.0, None
    for n in range(1, steps + 1):
        after = (1 + math.sqrt(1 + 4 * age * age)) / 2
        push = (age - 1) / after
        age = after
        # Sums are linear in the rates, so those of the extrapolated ones need no pass of their own.
        residual = [a + push * (a - b) - c for a, b, c in zip(now, last, tau)]
        pull = [sum(metric[i][j] * residual[j] for j in range(k)) for i in range(k)]
        ahead = state.withColumn("y", F.col("x") + F.lit(push) * (F.col("x") - F.col("before")))
        slope = sum((F.col(f"p{i}") * F.lit(pull[i]) for i in range(k)), F.lit(ridge) * (F.col("y") - 1))
        moved = F.greatest(F.lit(0.0), F.col("y") - F.lit(step) * slope)
        state = ahead.select("doc", "tie", "n_tokens", "p", "w", *[f"p{i}" for i in range(k)], (moved if most is None else F.least(moved, F.lit(float(most)))).alias("x"), F.col("x").alias("before"), "y")
        if n % STRIDE == 0:
            state = t.keep(state, f"step{n}")
            if written:
                t.drop(written)
            written = f"step{n}"
        x, y, w = F.col("x"), F.col("y"), F.col("w")
        got = state.agg(*[F.sum(w * x * F.col(f"p{i}")) for i in range(k)], F.sum(w * (x - y) * (x - y)), F.sum(w * (y - x) * (x - F.col("before")))).first()
        now, last = list(got[:k]), now
        if math.sqrt(got[k]) < tolerance:
            break
        if got[k + 1] > 0:  # the extrapolation went too far
            age = 1.0
    else:
        gaps = ", ".join(f"{abs(a - b) / b:.2g}" if b else "-" for a, b in zip(now, tau))
        raise RuntimeError(f"the rates did not come to rest in {steps} steps; relative gaps {gaps}")
    out = t.keep(state.select("doc", "tie", "n_tokens", "p", F.col("x").alias("rate")), "rates")
    if written:
        t.drop(written)
    return out, {"have": have, "want": [x * total for x in tau], "got": [x * total for x in now], "steps": n}


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: toxic, low (quality 0) or good; rows without labels go."""
    return labels.where(F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain")
    )


#: Wanted token shares of the domains.
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, stretch: float = 1.0, anchor: str | None = None, **fit) -> DataFrame:
    """doc, tie, n_tokens, p, rate for each row of docs.

    Null texts and texts without words have 0 tokens and the prior as posterior; rows with equal ids and texts get equal
    rates; long texts count whole; columns beside doc_id and text are not read; an empty table gives an empty result.
    """
    t = Tables(docs.sparkSession, "mix")
    names = list(targets)
    model = train(docs, labelled, names)
    table = t.keep(posteriors(docs, model), "posteriors")
    rates, _ = fit_rates(table, [targets[n] for n in names], stretch=stretch, anchor=None if anchor is None else names.index(anchor), **fit)
    return rates


def keeps(doc: Column, tie: Column, rate: Column) -> Column:
    """One deterministic draw for each row: kept with the probability of its rate, always from rate 1 on."""
    return F.pmod(F.xxhash64(F.lit("mix"), doc, tie), F.lit(1 << 30)) < rate * F.lit(float(1 << 30))
