"""Severities, fingerprints and the shape of a finding, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.paths import let, normalized

SEVERITIES = ("info", "low", "medium", "high", "critical")
STATUS_PRIORITY = {"failed": 7, "partial": 6, "unsupported": 5, "skipped": 4, "not-selected": 3, "completed": 2, "not-applicable": 1}


def ranked(value: Column, order: dict[str, int] | tuple[str, ...], other: int = -1) -> Column:
    """The place of a text in a fixed order."""
    items = order.items() if isinstance(order, dict) else [(v, i) for i, v in enumerate(order)]
    out = None
    for text, rank in items:
        out = F.when(value == text, F.lit(rank)) if out is None else out.when(value == text, F.lit(rank))
    return out.otherwise(F.lit(other))


def severity_rank(severity: Column) -> Column:
    return ranked(severity, SEVERITIES)


def json_text(value: Column) -> Column:
    """A text as a JSON string; null as null."""
    quoted = lambda q: F.substring(q, F.lit(2), F.length(q) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(let(F.to_json(F.array(value)), quoted))


def json_list(*values: Column) -> Column:
    """A JSON array of texts (or of parts that are JSON already, given as (part,))."""
    parts = [v[0] if isinstance(v, tuple) else json_text(v) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def fingerprint(doctor: Column, rule: Column, identity: Column, path: Column | None = None, line: Column | None = None, col: Column | None = None) -> Column:
    """sha256 of the JSON array [doctor, rule, location or null, identity]; a location is [normalised path, line, column]."""
    number = lambda c: F.lit("null") if c is None else F.coalesce(c.cast("string"), F.lit("null"))
    place = F.lit("null")
    if path is not None:
        place = F.when(path.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), json_text(normalized(F.replace(path, F.lit("\\"), F.lit("/")))), F.lit(","), number(line), F.lit(","), number(col), F.lit("]")))
    return F.sha2(json_list(doctor, rule, (place,), identity), 256)


def evidence(type_: str, detail: Column, path: Column | None = None, schema: Column | None = None, table: Column | None = None, policy: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(F.lit(type_).alias("type"), text(path).alias("path"), text(schema).alias("schema"), text(table).alias("table"), text(policy).alias("policy"), detail.alias("detail"))


def findings(
    rows: DataFrame, *, rule: Column, doctor: Column, severity: Column, confidence: Column, category: str, title: Column, message: Column, evidence: Column,
    identity: Column, path: Column | None = None, line: Column | None = None, col: Column | None = None, impact: Column | None = None,
    constraints: Column | None = None, remediation: Column | None = None, located: bool = True, verification: tuple[str, str] | None = None,
) -> DataFrame:
    """A row of the findings schema for each row of rows, under their repo_id if they have one. located: whether the location is part of the fingerprint."""
    none = F.lit(None)
    expected = F.concat(F.lit("This fingerprint is absent and coverage of "), doctor, F.lit(" is completed.")) if verification is None else F.lit(verification[1])
    verified = F.struct(F.lit("auditlake audit . --format json" if verification is None else verification[0]).alias("command"), expected.alias("expected"))
    place = (path, line, col) if located else (None, None, None)
    return rows.select(
        *[c for c in rows.columns if c == "repo_id"], rule.alias("rule_id"), doctor.alias("doctor_id"), severity.alias("severity"), confidence.alias("confidence"), F.lit(category).alias("category"),
        title.alias("title"), message.alias("message"), (none if path is None else path).cast("string").alias("path"),
        (none if line is None else line).cast("int").alias("line"), (none if col is None else col).cast("int").alias("col"), evidence.alias("evidence"),
        (none if impact is None else impact).cast("string").alias("impact"), (F.array().cast("array<string>") if constraints is None else constraints).alias("remediation_constraints"),
        (none if remediation is None else remediation).cast("string").alias("remediation"),
        verified.alias("verification"),
        fingerprint(doctor, rule, identity, *place).alias("fingerprint"),
    )


def finding_order() -> list[Column]:
    """Severity descending, then module, path, rule and fingerprint by code units."""
    return [severity_rank(F.col("severity")).desc(), F.col("doctor_id").asc(), normalized(F.coalesce("path", F.lit(""))).asc(), F.col("rule_id").asc(), F.col("fingerprint").asc()]
