"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and one for any character outside it). The
probability of a word is the sum, over all ways to cut it into pieces, of the products of their probabilities: a forward
pass over its characters. A text's score is the sum over its words, a word being a run of letters in lower case, however long,
headed by the vocabulary's word mark. Piece probabilities are trained by expectation maximisation (forward and backward passes)
on a bounded sample of labelled rows and smoothed by the pooled ones. Words recur, so a worker runs the forward pass once for
each new word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import small_frame, worker_cache
from auditlake.llm.textkit import GOLD, U, slices

ROUNDS, PER_LANGUAGE, CACHED, SMOOTH = 4, 400, 300_000, 0.05
#: Cells (words times the longest one's characters) of one forward pass, and characters up to which a word's score is remembered.
CELLS, SHORT, RESCALE = 1 << 17, 64, 8
LETTERS, MARK, BASE = regex.compile(r"\p{L}+"), "▁", U(0x100000001B3)


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(path: str) -> list[str]:
    """Lower-cased pieces of letters (with or without the word mark), in vocabulary order. No other piece lies in a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return [*dict.fromkeys(p for p in found if p.strip(MARK).isalpha())]


def _hash(points: np.ndarray) -> int:
    h = 0
    for c in points.tolist():
        h = (h * int(BASE) + c + 1) % 2**64
    return h


class Lexicon:
    """Finds pieces in many words at once: hashes of all stretches are looked up in a two-table hash index."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.keys = np.array([0] + [_hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)) for p in pieces], np.uint64)
        self.tables, left = [], np.arange(1, self.n + 1)
        for shift in (U(44), U(45)):
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            at = self._slot(self.keys[left], shift, len(self.tables))
            table[at] = left
            self.tables.append((table, shift))
            left = left[table[at] != left]
        self.powers = np.ones(self.longest + 1, np.uint64)
        self.powers[1:] = np.cumprod(np.full(self.longest, BASE))

    @staticmethod
    def _slot(h: np.ndarray, shift, seed: int) -> np.ndarray:
        return ((h + U(seed)) * GOLD ^ h >> U(29)) * (GOLD + U(2 * seed)) >> shift

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape, np.int32)
        for seed, (table, shift) in enumerate(self.tables):
            got = table[self._slot(h, shift, seed)]
            out = np.where(self.keys[got] == h, got, out)
        return out

    def lattice(self, words: list[str]):
        """(lengths, an iterator over end positions: the (start, piece of each live word; 0: none) there are).

        Words are longest first, so those that reach a position are a prefix; a single character that is no piece is piece n + 1.
        """
        marked = [MARK + w for w in words]
        size = np.array([len(w) for w in marked])
        points = np.zeros((int(size.max()), len(words)), np.uint64)
        flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(len(words)), size)
        points[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), rows] = flat
        live = len(words) - np.searchsorted(size[::-1], np.arange(1, len(points) + 1))

        def ends():
            prefix = [np.zeros(len(words), np.uint64)]  # of the last `longest` positions
            for j in range(1, len(points) + 1):
                prefix.append(prefix[-1] * BASE + points[j - 1] + U(1))
                if len(prefix) > self.longest + 1:
                    prefix.pop(0)
                n, here = int(live[j - 1]), []
                for d in range(len(prefix) - 1, 0, -1):
                    p = self.find(prefix[-1][:n] - prefix[-1 - d][:n] * self.powers[d])
                    if d == 1:
                        p[p == 0] = self.n + 1
                    if p.any():
                        here.append((j - d, p))
                yield here

        return size, ends()


def forward(ends, size: np.ndarray, prob: np.ndarray, reach: int, kept: list | None = None) -> np.ndarray:
    """Log probability of each word and language, over all segmentations. prob: (pieces + 2, languages), row 0 zero.

    Sums are scaled anew every RESCALE positions, for each word and language, so words of any length keep their digits. Pieces
    are at most `reach` long. kept gets the sums at each position and the logarithms of their scales.
    """
    n, k = len(size), prob.shape[1]
    out, scale, back = np.zeros((n, k)), np.zeros((n, k)), {0: np.ones((n, k))}
    if kept is not None:
        kept.append((back[0], scale.copy()))
    for j, here in enumerate(ends, 1):
        live = len(here[0][1])
        at = np.zeros((live, k))
        for i, p in here:
            at += back[i][:live] * prob[p]
        at = np.maximum(at, 1e-300)
        done = size[:live] == j
        out[:live][done] = (scale[:live] + np.log(at))[done]
        back.pop(j - reach, None)
        if j % RESCALE == 0:
            scale[:live] += np.log(at)
            back = {i: f[:live] / at for i, f in back.items()}
            at = np.ones_like(at)
        back[j] = at
        if kept is not None:
            kept.append((at, scale[:live].copy()))
    return out


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def batches(words: list[str]) -> list[list[str]]:
    """The words, longest first, in batches of at most CELLS cells (or one word)."""
    out, order = [], sorted(words, key=lambda w: (-len(w), w))
    at = 0
    while at < len(order):
        n = max(1, CELLS // (len(order[at]) + 1))
        out.append(order[at : at + n])
        at += n
    return out


def word_scores(lexicon: Lexicon, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    place = {w: i for i, w in enumerate(words)}
    out = np.zeros((len(words), prob.shape[1]), np.float32)
    for part in batches([*place]):
        size, ends = lexicon.lattice(part)
        out[[place[w] for w in part]] = forward(ends, size, prob, lexicon.longest)
    return out if len(place) == len(words) else out[[place[w] for w in words]]


def expect(size: np.ndarray, ends: list, weight: np.ndarray, prob: np.ndarray, reach: int, seen: np.ndarray) -> None:
    """Adds the expected uses of each piece in words of the given weights: a forward and a backward pass."""
    kept: list = []
    total = forward(ends, size, prob[:, None], reach, kept)[:, 0]
    n = len(size)
    scale, ahead = np.zeros(n), {}
    for j in range(len(ends), 0, -1):
        here = ends[j - 1]
        live = len(here[0][1])
        at = ahead.pop(j, np.zeros(n))
        at[:live][size[:live] == j] = 1
        if j % RESCALE == 0:
            top = np.where(at > 0, at, 1)
            scale += np.log(top)
            at = at / top
            ahead = {i: b / top for i, b in ahead.items()}
        for i, p in here:
            use = prob[p] * at[:live]
            if i not in ahead:
                ahead[i] = np.zeros(n)
            ahead[i][:live] += use
            f, log = kept[i]
            seen += np.bincount(p, weights=f[:live, 0] * use * np.exp(log[:live, 0] + scale[:live] - total[:live]) * weight[:live], minlength=len(seen))


def train(counts: dict[str, Counter], lexicon: Lexicon, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities (pieces + 2, languages)) from the word counts of each language."""
    names, rows, expected = sorted(counts), lexicon.n + 2, []
    for name in names:
        blocks = []
        for part in batches([*counts[name]]):
            size, ends = lexicon.lattice(part)
            blocks.append((size, [*ends], np.array([counts[name][w] for w in part], float)))
        prob = np.full(rows, 1.0 / (lexicon.n + 1))
        prob[0] = 0
        for _ in range(rounds):
            seen = np.zeros(rows)
            for size, ends, weight in blocks:
                expect(size, ends, weight, prob, lexicon.longest, seen)
            seen[0] = 0
            prob = (seen + 1e-3) / (seen + 1e-3)[1:].sum()
            prob[0] = 0
        expected.append(seen)
    table = np.stack(expected, 1)
    share = table / np.maximum(table.sum(0), 1)
    pooled = (share.mean(1) + 1e-7) / (share.mean(1) + 1e-7)[1:].sum()
    prob = (1 - SMOOTH) * share + SMOOTH * pooled[:, None]
    prob[0] = 0
    return names, prob


def learning_rows(docs: DataFrame) -> Column:
    """Documents that may be learned from: crc32 of doc_id as text, modulo 4, is not 2."""
    return ~held_out(4, 2)


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, Counter]:
    """Word counts of at most per_language labelled documents of each language: those with the lowest hashes of doc_id and text.

    Words are counted on the executors; what reaches the driver are the counts of the sampled documents' words.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text")
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return {}
    # Twice the wanted share, of which the lowest hashes stay; few rows are sorted so.
    shares = small_frame(docs.sparkSession, [(r["lang"], min(1.0, 2.0 * per_language / r["count"] + 32.0 / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.join(F.broadcast(shares), "lang").withColumn("draw", draw).where(F.col("draw") < F.col("share"))
    order = W.partitionBy("lang").orderBy("draw", "doc_id", F.sha2("text", 256))
    rows = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    for r in rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["word"]] += r["n"]
    return counts


def fit(docs: DataFrame, path: str | None = None, **bounds) -> tuple[str, list[str], np.ndarray]:
    """A model from the labelled rows of docs (doc_id, lang, text)."""
    where = path or vocabulary()
    counts = sample(docs, **bounds)
    lexicon = Lexicon(pieces_of(where))
    names, prob = train(counts, lexicon) if counts else ([], np.zeros((lexicon.n + 2, 0)))
    return where, names, prob


def identify(docs: DataFrame, model: tuple[str, list[str], np.ndarray], *keys: str) -> DataFrame:
    """The key columns, lang_pred and score (the posterior of lang_pred) for each row.

    Only text is read. A null or empty text, one without a letter, or a model without languages gives `und` and score 0. Equal
    texts, also in repeated rows, have equal results; ties go to the first language by name; texts and words of any length are
    scored whole; of other columns none is read but the keys; an empty table gives an empty result.
    """
    where, names, prob = model
    shared = docs.sparkSession.sparkContext.broadcast(prob)  # pieces x languages, fixed
    schema = T.StructType([*[docs.schema[c] for c in keys], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches_):
        import pyarrow as pa

        lexicon = worker_cache(("lexicon", where), lambda: Lexicon(pieces_of(where)))
        table, scores = {}, np.zeros((0, len(names)), np.float32)
        for batch in batches_:
            for first, texts in slices(batch, chars=2_000_000):
                words = [words_of(t) for t in texts]
                long = {w for ws in words for w in ws if len(w) > SHORT} if names else set()
                new = [*set().union(*words).difference(table, long)] if names else []
                if len(table) + len(new) > CACHED:
                    table, scores, new = {}, scores[:0], [*set().union(*words).difference(long)]
                if new:
                    table.update(zip(new, range(len(table), len(table) + len(new))))
                    scores = np.concatenate([scores, word_scores(lexicon, shared.value, new)])
                rare = dict(zip(long, word_scores(lexicon, shared.value, [*long]))) if long else {}
                best, sure = [], []
                for ws in words:
                    if not ws or not names:
                        best.append("und")
                        sure.append(0.0)
                        continue
                    at = [table[w] for w in ws if w not in rare] if rare else [*map(table.__getitem__, ws)]
                    s = scores[np.array(at, np.int64)].sum(0, dtype=np.float64)
                    if rare:
                        s = s + sum(rare[w].astype(np.float64) for w in ws if w in rare)
                    k = int(s.argmax())
                    best.append(names[k])
                    sure.append(1.0 / float(np.exp(s - s[k]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, len(texts)) for c in keys], pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*keys, "lang_pred", "score"]
                )

    text = ["text"] if "text" in docs.columns else []  # else the one key column is a struct of whole rows
    return docs.select(*dict.fromkeys([*keys, *text])).mapInArrow(run, schema)

