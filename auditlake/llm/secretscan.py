"""Secret scans by dictionary-primed zstandard novelty.

Plain patterns find assignments, access keys and long hexadecimal runs. Beside them, every token around a word that names
something sensitive (within AROUND characters, over line ends, and from a BEGIN marker to its END) is measured: a compressor
primed with a dictionary of identifiers compresses the code around the token with and without it, and the difference is the
token's marginal compressed size. Identifiers, paths and repeated names cost few bytes; random strings cost nearly all theirs
and are reported as `novel`.

The dictionary holds the words that stand in the most different surroundings all over the corpus (so that a secret in any number
of copies of one text is none of them), and the names of the language's standard library, which every worker has. zstandard spends
a byte on each letter of a word that it doesn't know, whatever the word; so a token costs the less of its marginal size and of its
size in a code of letter pairs, whose probabilities are those of the dictionary's words. The least cost of a secret, for tokens
of each range of lengths, is fitted on planted random strings and on identifiers that the dictionary lacks.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import sys
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import worker_cache
from auditlake.llm.textkit import slices

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns, letters of the names in either case; matches that fail the length are dropped after matching.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
#: Words around which novel tokens are searched.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth", "private", "bearer", "access", "akia", "-----begin")
WORDS = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
TOKEN, WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}"), re.compile(r"[A-Za-z]+")
#: Identifiers of configurations and code that are no secrets, whatever stands around them.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_secret client_id refresh_token "
    "access_token auth_token bearer authorization credential credentials username user_name user_id session_id request_id "
    "example placeholder changeme your_password_here your_api_key_here undefined null true false none default config settings "
    "environment process.env os.environ getenv import export return function const let var class def self this new static void "
    "string number integer boolean object array http https localhost application/json content-type abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx"
)
#: Characters of context on either side; bytes of the dictionary; words of the corpus in it, and surroundings (of 64) that each must have.
AROUND, DICTIONARY, TOP, SURROUNDINGS = 200, 64 << 10, 20_000, 8
#: First lengths of the ranges with a threshold each, planted strings for each, and the share of identifiers that may be taken for secrets.
RANGES, PLANTED, MISTAKEN = (8, 12, 16, 24), 600, 0.002
#: Words whose surroundings a task counts before it hands them on; tasks that look for the most frequent ones.
HELD, TAKERS = 200_000, 8
MARKER, BODY = re.compile("-----(BEGIN|END)", re.IGNORECASE | re.ASCII), re.compile(r"[ \t]*[A-Za-z0-9+/=]+[ \t\r]*(?:\n|\Z)")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of the code of letter pairs: letters, one for a word's edge.
EDGE, SEPARATOR_BITS, CASE_BITS, DIGIT_BITS = len(LETTERS), 3.0, 1.5, math.log2(10)


def corpus_words(docs: DataFrame, top: int = TOP, surroundings: int = SURROUNDINGS) -> list[str]:
    """The words of 3 to 24 letters in the most texts' places, most frequent first, of those in at least `surroundings` different surroundings.

    A word's surroundings are the words beside it, hashed to one of 64 bits; all texts of the corpus are counted.
    """

    def count(batches):
        import pyarrow as pa

        seen: dict[str, list[int]] = {}

        def flush():
            rows = [(w, n, b - 2**64 if b >> 63 else b) for w, (n, b) in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["word", "n", "bits"])

        for batch in batches:
            for _, texts in slices(batch, chars=4_000_000):
                for text in texts:
                    words = [w.lower() for w in WORD.findall(text)]
                    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                        if 3 <= len(w) <= 24:
                            bit = 1 << (zlib.crc32(f"{before} {after}".encode()) & 63)
                            had = seen.get(w)
                            if had is None:
                                seen[w] = [1, bit]
                            else:
                                had[0] += 1
                                had[1] |= bit
                    if len(seen) >= HELD:
                        yield flush()
        if seen:
            yield flush()

    found = docs.select("text").mapInArrow(count, "word string, n bigint, bits bigint").groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
    # Each task hands its own top to the driver, so few tasks do this: no more than TAKERS x top words are sent.
    found = found.where(F.bit_count("bits") >= surroundings).select("word", "n").repartition(TAKERS).orderBy(F.desc("n"), "word").limit(top)
    return [r["word"] for r in found.select("word").collect()]


def library_words() -> list[str]:
    """The words in the names of Python's standard library."""
    import builtins
    import http.client
    import keyword
    import logging
    import os
    import socket
    import threading

    names = [*sys.stdlib_module_names, *keyword.kwlist]
    for m in (builtins, os, socket, logging, threading, http.client, str, bytes, dict, Exception):
        names += dir(m)
    return sorted({w.lower() for n in names for w in split_words(n) if len(w) >= 3})


def split_words(name: str) -> list[str]:
    return re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)


class Novelty:
    """What tokens cost: a zstandard dictionary, the code of letter pairs and a threshold for each range of lengths."""

    def __init__(self, words: list[str]):
        known = [*dict.fromkeys([*words, *library_words()])]
        # Every fourth word stays out of the dictionary, for the thresholds.
        self.unknown = [w for w in known if zlib.crc32(w.encode()) % 4 == 0]
        self.words = [w for w in known if zlib.crc32(w.encode()) % 4]
        text = " ".join(reversed(self.words))  # what is nearest is cheapest
        self.dictionary = f"{text} {IDENTIFIERS}".encode()[-DICTIONARY:]
        self.pairs = pair_bits([*self.words, *WORD.findall(IDENTIFIERS.lower())])
        self.least = [0.0] * len(RANGES)
        self.least = [self.fitted(a, b) for a, b in zip(RANGES, [*RANGES[1:], 48])]

    def marginal(self, before: str, token: str, after: str) -> float:
        """Compressed bytes that the token adds to its surroundings, for each of its characters."""

        def make():
            import zstandard

            d = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        z = worker_cache(("zstd", zlib.crc32(self.dictionary)), make)
        around, data = f"{before}\n{after}\n".encode("utf-8", "replace"), token.encode()
        return (len(z.compress(around + data)) - len(z.compress(around))) / len(data)

    def spelled(self, token: str) -> float:
        """Bytes of a token in the code of letter pairs, for each of its characters."""
        bits, last, upper = 0.0, EDGE, False
        for i, c in enumerate(token):
            k = LETTERS.find(c.lower())
            if k >= 0:
                bits += self.pairs[last][k]
                if c.isupper() != upper:
                    bits += CASE_BITS if i else 0.0
                    upper = not upper
                last = k
            else:
                # A word ends here; digits in a row cost their digits alone.
                bits += self.pairs[last][EDGE] if last != EDGE else 0.0
                bits += DIGIT_BITS if c.isdigit() else SEPARATOR_BITS
                last = EDGE
        return (bits + (self.pairs[last][EDGE] if last != EDGE else 0.0)) / 8 / len(token)

    def threshold(self, token: str) -> float:
        return self.least[bisect.bisect(RANGES, len(token)) - 1]

    def is_novel(self, before: str, token: str, after: str) -> bool:
        least = self.threshold(token)
        return self.spelled(token) >= least and self.marginal(before, token, after) >= least

    def fitted(self, low: int, high: int) -> float:
        """The least cost that all but MISTAKEN of identifiers of these lengths stay below, and half-way to the tenth-lowest planted string where there is room."""
        draw = random.Random(low)
        words = self.unknown or ["identifier", "placeholder", "configuration"]
        names = []
        while len(names) < PLANTED:
            name = make_name(draw, words, high)
            if low <= len(name) < high:
                names.append(name)
        cost = lambda t: min(self.spelled(t), self.marginal("the value of ", t, " is"))
        calm = sorted(map(cost, names))[: max(1, round(PLANTED * (1 - MISTAKEN)))][-1]
        wild = sorted(cost(planted(draw, low, high)) for _ in range(PLANTED))[PLANTED // 100]
        return (calm + wild) / 2 if wild > calm else calm + 1e-6


def make_name(draw: random.Random, words: list[str], high: int) -> str:
    """An identifier of some of the words, in one of the usual spellings, with a number now and then."""
    chosen = [draw.choice(words)]
    while len("".join(chosen)) < high - 4 and draw.random() < 0.7:
        chosen.append(draw.choice(words))
    kind = draw.randrange(6)
    if kind == 0:
        name = chosen[0] + "".join(w.capitalize() for w in chosen[1:])
    elif kind == 1:
        name = "".join(w.capitalize() for w in chosen)
    elif kind == 5:
        name = "_".join(chosen).upper()
    else:
        name = "_-/"[kind - 2].join(chosen)
    return name + (str(draw.randrange(1, 100)) if draw.random() < 0.3 else "")


def planted(draw: random.Random, low: int, high: int) -> str:
    digits, upper = "0123456789", LETTERS.upper()
    kinds = (LETTERS + upper + digits, LETTERS + upper + digits + "+/", LETTERS + digits, upper + digits, LETTERS + upper)
    kinds = kinds if low < 16 else (*kinds, LETTERS, upper)
    chars = draw.choice(kinds)
    return "".join(draw.choice(chars) for _ in range(draw.randrange(low, high)))


def pair_bits(words: list[str]) -> list[list[float]]:
    """Bits of each letter (or a word's end) after each letter (or a word's start)."""
    counts = [[1.0] * (EDGE + 1) for _ in range(EDGE + 1)]
    for w in words:
        at = [EDGE, *(LETTERS.find(c) for c in w if c in LETTERS), EDGE]
        for a, b in zip(at, at[1:]):
            counts[a][b] += 1
    return [[-math.log2(n / sum(row)) for n in row] for row in counts]


def fit(docs: DataFrame) -> Novelty:
    """The novelty measure of a corpus. Null and empty texts add nothing; an empty table leaves the standard library's names."""
    return Novelty(corpus_words(docs))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def key_bodies(text: str) -> list[tuple[int, int]]:
    """What each BEGIN marker opens: up to its END marker, or to the last line of key characters where there is none."""
    marks, out, reached = [*MARKER.finditer(text)], [], 0
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1].upper() == "BEGIN":
            if after is not None and after[1].upper() == "END":
                out.append((m.start(), after.start()))
                continue
            end = text.find("\n", m.end()) + 1 or len(text)
            if end > reached:  # else these lines have been read from the marker before
                while end < len(text) and (line := BODY.match(text, end)):
                    end = line.end()
                reached = end
            out.append((m.start(), max(end, reached)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, known: list[tuple[int, int, int]], model: Novelty, around: int = AROUND) -> list[tuple[int, int, int]]:
    """Incompressible tokens that touch sensitive surroundings, outside the known spans: one pass over both, in order."""
    near = [(m.start() - around, m.end() + around) for m in WORDS.finditer(text)]
    if not near:
        return []
    near = merged(near + (key_bodies(text) if "-----" in text else []))
    taken = merged([(s, e) for s, e, _ in known])
    out, i, j = [], 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(near) and near[i][1] <= a:
            i += 1
        if i == len(near):
            break
        if near[i][0] >= b:
            continue
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if j < len(taken) and taken[j][0] < b:
            continue
        if model.is_novel(text[max(0, a - around) : a], m[0], text[b : b + around]):
            out.append((a, b, 3))
    return out


def scan(text: str, model: Novelty) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, model), key=lambda s: (s[0], s[2]))


def find_secrets(docs: DataFrame, model: Novelty | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of each whole text, in code points, end exclusive.

    The model is fitted on docs where none is given. Null and empty texts have no spans; each row is scanned by itself in time that
    grows with its length, so equal texts have equal spans and repeated rows a result each; only doc_id and text are read; an empty
    table gives an empty result. The secret's characters themselves are never part of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # DICTIONARY bytes, TOP words and a fixed table

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts in slices(batch, chars=4_000_000):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan(t, shared.value)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of find_secrets()' rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("novel"))
