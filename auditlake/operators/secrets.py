"""Secret findings: selection of files, candidates, overlap resolution, caps and the test-key exception."""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions.core import evidence, findings
from auditlake.functions.curves import ed25519_public, uncompressed_point
from auditlake.functions.lazy import lazy_udf
from auditlake.functions.secrets import PEM_LABELS, secret_candidates
from auditlake.operators.findings import capped, running_budget
from auditlake.operators.lineage import cut, repo_key, with_content

DOCTOR = "security/secrets"
FILE_BYTES, TOTAL_BYTES, PER_FILE, TOTAL = 1_000_000, 100_000_000, 100, 1_000
TITLES = {
    "private-key": "A private key is in shared content", "provider-token": "A provider's token is in shared content", "aws-credentials": "AWS credentials are in shared content",
    "credential-url": "A URL with a password is in shared content", "sensitive-assignment": "A secret is assigned in shared content",
}


def shareable(files: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Regular files that version control shares; without its list, all but local environment files."""
    regular = files.where("kind = 'file'")
    return regular.where(~P.is_local_environment(F.col("path"))) if listed is None else regular.join(listed.select(*repo_key(files), "path"), [*repo_key(files), "path"], "left_semi")


def changed_files(files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventoried regular files among the changed paths; limitations (value) for deleted, missing and linked ones)."""
    j = changes.select("path", "status").distinct().join(files, "path", "left")
    why = F.when(F.col("status") == "deleted", "deleted file content was not scanned.").when(F.col("kind").isNull(), "changed file was not found in the inventory.").when(F.col("kind") != "file", "changed symlink was not followed.")
    return j.where((F.col("status") != "deleted") & (F.col("kind") == "file")).select("path", "kind", "size").distinct(), j.withColumn("w", why).where("w is not null").select(F.concat("path", F.lit(": "), "w").alias("value")).distinct()


def matches(contents: DataFrame) -> DataFrame:
    """path and the spans that remain, one row each; texts with a NUL are binary and skipped."""
    text = contents.where(~F.contains("content", F.lit("\0")))
    k = repo_key(contents)
    return text.select(*k, "path", F.explode(secret_candidates("content")).alias("s")).select(*k, "path", "s.*")


def audit(files: DataFrame, contents, certificates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings within the caps; coverage limitations (value)). Sizes beyond the budgets are left out and said so.

    contents: a relation or a function that reads what is chosen; certificates: with content, or files to be read."""
    k = repo_key(files)
    sized = running_budget(files, FILE_BYTES, TOTAL_BYTES)
    text = with_content(sized.where("within"), contents)
    # Candidates and private keys are found in one reading.
    read = cut(text.where(~F.contains("content", F.lit("\0"))).select(*k, "path", secret_candidates("content").alias("s"), F.when(F.contains("content", F.lit("PRIVATE KEY")), F.col("content")).alias("content")))
    found = read.select(*k, "path", F.explode("s").alias("s")).select(*k, "path", "s.*")
    notes = sized.where("oversize").select(*k, F.concat("path", F.lit(f": file exceeds the {FILE_BYTES}-byte limit.")).alias("value"))
    notes = notes.unionByName(sized.where("not oversize and not within").groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(*k, F.lit(f"Secret scanning stopped at the {TOTAL_BYTES}-byte total limit.").alias("value")))
    if certificates is not None:
        held = certificates if "content" in certificates.columns else with_content(certificates, contents)
        local = cut(test_keys(read.where("content is not null"), held)).select(*k, F.col("key_path").alias("path"), F.col("key_start").alias("start"), F.lit("private-key").alias("family"))
        hit = found.join(local, local.columns, "left_semi")
        notes = notes.unionByName(hit.select(*k, F.concat("path", F.lit(": private key matched an inventoried localhost-only test certificate; no finding was emitted.")).alias("value")).distinct())
        found = found.join(local, local.columns, "left_anti")
    order = [F.col("line"), F.col("col"), F.col("detector_id")]
    kept = capped(found, ["path"], order, PER_FILE, TOTAL)
    over = found.groupBy(*k, "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_FILE).select(*k, F.concat("path", F.lit(f": findings stopped at the {PER_FILE}-finding limit.")).alias("value"))
    return secret_findings(kept), notes.unionByName(over)


def secret_findings(found: DataFrame) -> DataFrame:
    title = F.lit(None).cast("string")
    for family, text in TITLES.items():
        title = F.when(F.col("family") == family, text).otherwise(title)
    return findings(
        found, rule=F.concat(F.lit(f"{DOCTOR}/"), "family"), doctor=F.lit(DOCTOR), severity=F.col("severity"), confidence=F.col("confidence"), category="security", title=title,
        message=F.lit("Shared content holds a value with the shape of a credential. The value was withheld."),
        evidence=F.array(evidence("file", F.concat(F.lit("Detector "), "detector_id", F.lit(" matched; the value was withheld.")), F.col("path"))),
        identity=F.concat("detector_id", F.lit(":"), F.lower(F.coalesce("assignment_name", F.lit("")))), path=F.col("path"), line=F.col("line"), col=F.col("col"),
        impact=F.lit("Whoever sees the repository may use the credential."), remediation=F.lit("Remove the value, rotate it outside of this tool, and audit again."),
    )


# Localhost test keys: private keys whose public half an inventoried, localhost-only certificate carries.


def _der(data: bytes, at: int = 0):
    """(tag, content start, end) of the DER value at an offset."""
    tag, size, head = data[at], data[at + 1], 2
    if size & 0x80:
        n = size & 0x7F
        size, head = int.from_bytes(data[at + 2 : at + 2 + n], "big"), 2 + n
    if at + head + size > len(data):
        raise ValueError("truncated")
    return tag, at + head, at + head + size


def _children(data: bytes, start: int, end: int):
    while start < end:
        tag, a, b = _der(data, start)
        yield tag, start, a, b
        start = b


def _length(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([128 + len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b


def _value(tag: int, content: bytes) -> bytes:
    return bytes([tag]) + _length(len(content)) + content


# Identifiers of a certificate's names and of key algorithms.
COMMON_NAME, ALTERNATIVE_NAMES = bytes.fromhex("550403"), bytes.fromhex("551d11")
RSA, EC, ED25519 = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b6570")


def _spki(algorithm: bytes, parameters: bytes, key: bytes) -> bytes:
    return _value(0x30, _value(0x30, _value(6, algorithm) + parameters) + _value(3, b"\0" + key))


def _values(content: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the DER values that follow one another."""
    return [(tag, content[x:y]) for tag, _, x, y in _children(content, 0, len(content))]


def _fields(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the values in a DER sequence."""
    return _values(_values(data)[0][1])


def _public(data: bytes, algorithm: bytes | None = None, curve: bytes | None = None) -> bytes | None:
    """The public key, as a certificate holds it, of a private key: wrapped with its algorithm, or bare."""
    if algorithm == ED25519:
        return _spki(ED25519, b"", ed25519_public(_values(data)[0][1]))
    parts = _fields(data)
    tags = [tag for tag, _ in parts]
    if algorithm is None and tags[:3] == [2, 0x30, 4]:
        kind = _values(parts[1][1])
        return _public(parts[2][1], kind[0][1], kind[1][1] if len(kind) > 1 else None)
    if algorithm in (None, RSA) and tags[:9] == [2] * 9:
        return _spki(RSA, _value(5, b""), _value(0x30, _value(2, parts[1][1]) + _value(2, parts[2][1])))
    if algorithm in (None, EC) and tags[:2] == [2, 4]:
        named = [_values(content)[0][1] for tag, content in parts if tag == 0xA0]
        curve = (named or [curve or b""])[0]
        return _spki(EC, _value(6, curve), uncompressed_point(curve, int.from_bytes(parts[1][1], "big")))
    return None


def _body(pem: str) -> bytes:
    return base64.b64decode(re.sub(r"-----[^-]+-----|\s", "", pem), validate=True)


def key_digest(pem: str) -> str | None:
    """sha256 of the public key of an unencrypted RSA, Ed25519 or named-curve private key; null for anything else."""
    try:
        found = _public(_body(pem))
    except (ValueError, IndexError):
        return None
    return found and hashlib.sha256(found).hexdigest()


def _local(tag: int, name: bytes) -> bool:
    """A DNS name localhost, or a loopback address."""
    return name.lower() == b"localhost" if tag == 0x82 else tag == 0x87 and (name[:1] == b"\x7f" and len(name) == 4 or name == b"\0" * 15 + b"\1")


def local_certificate_digest(pem: str) -> str | None:
    """sha256 of the certificate's public key, if its common names are localhost alone and its alternative names, of which there are
    some, are local; without that extension a common name is needed. Else null."""
    try:
        signed = _values(_fields(_body(pem))[0][1])
        signed = signed[1:] if signed[0][0] == 0xA0 else signed
        subject, key = signed[4][1], signed[5]
        pairs = [_values(pair) for _, part in _values(subject) for _, pair in _values(part)]
        common = [value.decode("utf-16-be" if tag == 30 else "utf-8").lower() for (_, kind), (tag, value) in pairs if kind == COMMON_NAME]
        extensions = [_values(e) for tag, held in signed[6:] if tag == 0xA3 for _, e in _fields(held)]
        others = [_fields(e[-1][1]) for e in extensions if e[0][1] == ALTERNATIVE_NAMES]
        fit = all(names and all(_local(*n) for n in names) for names in others) if others else bool(common)
        return hashlib.sha256(_value(*key)).hexdigest() if fit and all(n == "localhost" for n in common) else None
    except (ValueError, IndexError):
        return None


_KEY = re.compile("-----BEGIN (" + "|".join(PEM_LABELS) + r")-----.*?-----END \1-----", re.S)
_CERTIFICATE = re.compile(r"-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----", re.S)


@lazy_udf("array<struct<start:int,pem:string>>")
def key_blocks(content: pd.Series) -> pd.Series:
    return content.map(lambda t: [{"start": m.start(), "pem": m[0]} for m in _KEY.finditer(t or "")])


@lazy_udf("array<string>")
def certificate_blocks(content: pd.Series) -> pd.Series:
    return content.map(lambda t: _CERTIFICATE.findall(t or ""))


@lazy_udf("string")
def key_digests(pem: pd.Series) -> pd.Series:
    return pem.map(key_digest)


@lazy_udf("string")
def local_certificate_digests(pem: pd.Series) -> pd.Series:
    return pem.map(local_certificate_digest)


def test_keys(contents: DataFrame, certificates: DataFrame) -> DataFrame:
    """key_path, key_start of private keys that a localhost-only certificate (of the same repository) matches.

    certificates: path, content of candidates. Each different key and certificate is read once, however often it stands.
    """
    k = repo_key(contents)
    keys = contents.where(F.contains("content", F.lit("PRIVATE KEY"))).select(*k, F.col("path").alias("key_path"), F.explode(key_blocks("content")).alias("b"))
    keys = keys.select(*k, "key_path", F.col("b.start").alias("key_start"), F.col("b.pem").alias("pem"))
    held = certificates.where(P.is_certificate_candidate(F.col("path"))).select(*k, F.explode(certificate_blocks("content")).alias("certificate"))
    digests = keys.select("pem").distinct().select("pem", key_digests("pem").alias("digest"))
    local = held.select("certificate").distinct().select("certificate", local_certificate_digests("certificate").alias("digest")).where("digest is not null")
    local = held.join(local, "certificate").select(*k, "digest").distinct()
    return keys.join(digests, "pem").join(local, [*k, "digest"], "left_semi").select(*k, "key_path", "key_start")
