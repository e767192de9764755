"""Reports written by executors: a JSON document whose one long list the driver never holds.

Tasks write the list's items to part files beside the target, in the order of the frame's partitions; the commit joins head, parts and tail
into the target in one pass of bounded copies and puts it in place at once. A failed attempt leaves the earlier document.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from auditlake.operators import findings as fo
from auditlake.plans import reports
from auditlake.plans.engine import Result

FORMAT = "json-document"


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    items: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.head, self.tail = options["path"], options["head"], options["tail"]
        self.folder = f"{self.path}.{options['attempt']}.parts"
        # Made here, on the driver, and not by tasks: those that outlive an abort can't bring it back.
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator) -> Part:
        context = TaskContext.get()
        number = context.partitionId()
        # A name of its own for each attempt: a task that is run twice overwrites nothing.
        file, items = f"{self.folder}/{number:06}-{context.taskAttemptId()}", 0
        with open(file, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write((",\n" if items else "") + row[0])
                items += 1
        return Part(number, file, items)

    def commit(self, messages: list) -> None:
        made = f"{self.folder}/whole"
        with open(made, "wb") as out:
            out.write(self.head.encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.items), key=lambda m: m.number):
                out.write(b"\n" if first else b",\n")
                first = False
                with open(part.file, "rb") as piece:
                    shutil.copyfileobj(piece, out, 1 << 20)
            out.write(self.tail.encode())
        os.replace(made, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class JsonDocument(DataSource):
    """df.write.format("json-document") of one column of JSON texts; options path (on a mount that all share), head, tail, attempt."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def write_list(items: DataFrame, path: str, head: str, tail: str) -> None:
    """items: one column of JSON texts, in the order of the frame."""
    items.sparkSession.dataSource.register(JsonDocument)
    items.write.format(FORMAT).mode("append").options(path=path, head=head, tail=tail, attempt=uuid.uuid4().hex[:12]).save()


def uri(path: Column) -> Column:
    """A path with each segment percent-encoded."""
    encoded = F.url_encode(path)
    for found, instead in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(found), F.lit(instead))
    return encoded


def sarif_results(found: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """item: a SARIF result for each finding, in finding order."""
    if comparison is not None:
        found = fo.baseline_state(found, comparison)
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.when(F.col("col") > 0, F.col("col")).alias("startColumn")))
    place = F.struct(F.struct(F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    state = F.when(F.col("baseline_state").isin("new", "unchanged"), F.col("baseline_state")) if comparison is not None else F.lit(None).cast("string")
    item = F.struct(
        F.col("rule_id").alias("ruleId"), reports.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(F.col("fingerprint").alias("auditlake/v1")).alias("partialFingerprints"),
        F.when(F.coalesce("path", F.lit("")) != "", F.array(place)).alias("locations"), state.alias("baselineState"),
    )
    return found.orderBy(*fo.finding_order()).select(F.to_json(item).alias("item"))


def write_sarif(result: Result, path: str) -> None:
    """The SARIF report: the driver gathers a row for each rule, executors write the results."""
    head, tail = json.dumps(reports.sarif_frame(result.findings), indent=2).split(f'"{reports.RESULTS}"')
    write_list(sarif_results(result.findings, result.comparison), path, head.rstrip() + " [", "]" + tail + "\n")


def json_findings(found: DataFrame) -> DataFrame:
    """item: a finding as the JSON report has it, in finding order."""
    at = F.when(F.col("path").isNotNull() | F.col("line").isNotNull(), F.struct("path", "line", F.col("col").alias("column")))
    camel = {"rule_id": "ruleId", "doctor_id": "doctorId", "remediation_constraints": "remediationConstraints"}
    rest = [F.col(c).alias(camel.get(c, c)) for c in found.columns if c not in ("path", "line", "col")]
    return found.orderBy(*fo.finding_order()).select(F.to_json(F.struct(*rest, at.alias("location"))).alias("item"))


def write_json(result: Result, path: str) -> None:
    """The JSON report, its findings written by executors and last in the document."""
    head = json.dumps(reports.as_dict(result, with_findings=False), indent=2, ensure_ascii=False).rstrip()
    write_list(json_findings(result.findings), path, head.removesuffix("}").rstrip() + ',\n  "findings": [', "]\n}\n")
