"""Fill-in-middle transformation in an Arrow-batched pandas UDF.

A text is cut into units, a run of ASCII letters or any other character each. The end offsets of all units are kept in a compact
array (four bytes a unit); two cuts drawn by a hash of the id are two lookups in it, and slices of the text between them are
prefix, middle and suffix. Written with sentinels, the middle comes last: psm (prefix, suffix, middle) or spm (suffix, prefix,
middle). Nothing is lost: restore() gives the text back from output and form.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The units and the sentinels.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in hundredths: texts transformed, and spm among those.
RATE, SPM, SEED = 90, 20, 1
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """0 and the end offset of each unit."""
    ends = array("I", [0])
    ends.extend(m.end() for m in regex.compile(UNIT).finditer(text))
    return ends


def draws(doc_id: str | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 from the decimal id; a null id has the empty one."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def transform_text(doc_id: str | None, text: str, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends, (h1, h2, h3, h4) = unit_ends(text), draws(doc_id, seed)
    n = len(ends) - 1
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    one, rest = output[len(first) :].split(second)
    two, middle = rest.split(MIDDLE)
    return (one + middle + two) if form == "psm" else (two + middle + one)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, outputs: bool = True) -> DataFrame:
    """All columns of docs in a struct `row`, with n, form, prefix_chars, middle_chars, output, output_sha256 and restored_sha256.

    Without `outputs` the transformed texts are digested and left out (null). Null texts are empty, and empty texts plain with n 0.
    Texts that hold a sentinel are plain. Rows with equal ids have equal draws; a null id is drawn like an empty one. Texts of any length are
    cut whole. Other columns may have any name. An empty table gives an empty result.
    """

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        for ids, texts in parts:
            rows = []
            for doc_id, text in zip(ids, texts):
                *facts, output = transform_text(doc_id, text, rate, spm, seed)
                rows.append((*facts, output if outputs else None, sha(output), sha(restore(output, facts[1]))))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    given = docs.select(F.struct("*").alias("row"))
    found = run(F.col("row.doc_id").cast("bigint").cast("string"), F.coalesce("row.text", F.lit("")))
    return given.select("row", found.alias("found")).select("row", "found.*")


#: DuckDB SQL with the result of op12 over the view documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR hs[3] % 100 >= {RATE} THEN 'plain' WHEN hs[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM s),
p AS (SELECT *, array_to_string(units[:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
