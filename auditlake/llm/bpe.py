"""Exact, cached encoding with a public BPE vocabulary.

The vocabulary's pre-tokenizer never joins characters across a space, so a text's ids are the ids of its
space-separated chunks in order; chunks recur, so each is encoded by the library once and then looked up.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

from auditlake.llm.common import worker_cache

#: Characters to encode in one call: the more, the fewer chunks are met again by another one.
CHARS = 4_000_000
#: Cached chunks a worker holds at most, and the longest chunk that is cached.
CACHED, LONGEST = 800_000, 64
#: A sign beside a point or comma: they would be one piece of text to the pre-tokenizer.
SIGNS = re.compile(r"(?:[^\w\s]|[_\x1c-\x1f])[.,]|[.,](?:[^\w\s]|[_\x1c-\x1f])")
SIMPLE = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}]*)")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PLAIN, DOUBLED = frozenset(" .,"), ("..", ".,", ",.", ",,")
ASCII_PLAIN = "".join(c for c in map(chr, range(128)) if c in PLAIN or c.isalnum()).encode()


def lone_signs(text: str) -> bool:
    """No point or comma has another sign beside it."""
    if text.encode().translate(None, ASCII_PLAIN) if text.isascii() else any(c not in PLAIN and not c.isalnum() for c in set(text)):
        return not SIGNS.search(text)
    return not any(d in text for d in DOUBLED)


def plain_case(text: str) -> bool:
    """Python lower-cases the text as the library does, sign by sign after composing."""
    return text.isascii() or unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text


def spaced(text: str) -> str:
    """The text with line ends as spaces; where that changes no id, also in lower case and with points and commas set apart."""
    text = text.replace("\n", " ")
    if "<|" in text or not plain_case(text) or not lone_signs(text):
        return text
    return f"{text.lower()} ".replace(". ", " . ").replace(", ", " , ")[:-1]


class Encoder:
    """Ids of whole texts. A chunk of letters and then other signs is looked up by its lower-cased letters and its signs, which the
    pre-tokenizer separates; new letter runs are encoded many at a time and told apart by the vocabulary's end-of-word mark."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.chunks, self.words = Tokenizer.from_file(path), {}, {}
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 65_536 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an unsigned little-endian array.

        The texts are split and their chunks numbered by Arrow, so Python meets each different chunk of a call once; the ids are then
        gathered by those numbers.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array([spaced(t) for t in texts], pa.large_string()), " ")
        numbered = split.values.dictionary_encode()
        chunks = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.chunks) > CACHED:
            self.chunks, self.words = {}, {}
        get = self.chunks.get
        found = [*map(get, chunks)]
        gaps = [k for k, x in enumerate(found) if x is None]
        long = self._learn([chunks[k] for k in gaps])
        for k in gaps:
            found[k] = get(chunks[k])
        for c in long:
            del self.chunks[c]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        table, first = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        which = numbered.indices.to_numpy()
        count = size[which]
        begin = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count, out=begin[1:])
        ids = table[np.repeat(first[which] - begin[:-1], count) + np.arange(begin[-1])]
        at = begin[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _together(self, some: list[str], into: dict[str, bytes]) -> bool:
        """Encodes letter runs in one text; False if its words can't be told apart again."""
        ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
        ends = (np.flatnonzero(self.closes[ids]) + 1) * self.kind.itemsize
        if len(ends) != len(some):
            return False
        data, a = ids.tobytes(), 0
        for w, b in zip(some, ends.tolist()):
            into[w] = data[a:b]
            a = b
        return True

    def _learn(self, new: list[str]) -> list[str]:
        runs, parts, rest, words = [], [], [], {}
        for c in new:
            if c.isalpha() and c.islower() and plain_case(c):
                runs.append(c)
            elif (m := SIMPLE.fullmatch(c)) and plain_case(c):
                parts.append((c, m[1].lower(), m[2]))
            else:
                rest.append(c)
        fresh = [*{low for _, low, _ in parts}.difference(self.chunks)]
        for texts, into in ((runs, self.chunks), (fresh, words)):
            for at in range(0, len(texts), 2000):
                some = texts[at : at + 2000]
                if not self._together(some, into):
                    self._apart(some, into)
        self._apart([*{s for _, _, s in parts}.difference(self.words)], self.words)
        self._apart(rest, self.chunks)
        for c, low, signs in parts:
            self.chunks[c] = (words[low] if low in words else self.chunks[low]) + self.words[signs]
        return [c for c in new if len(c) > LONGEST]

    def _apart(self, texts: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            for c, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                into[c] = np.array(e.ids, self.kind).tobytes()


def encoder(path: str) -> Encoder:
    return worker_cache(("bpe", path), lambda: Encoder(path))
