"""Reports: JSON, SARIF 2.1.0 and text, of results that are bounded already."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake import __version__
from auditlake.operators import findings as fo
from auditlake.plans.engine import Result

ITEMS = 20


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("high", "critical"), "error").when(severity == "medium", "warning").otherwise("note")


def first_of_rule(found: DataFrame) -> DataFrame:
    """The first finding of each rule, in finding order: what defines the rule."""
    w = W.partitionBy("rule_id").orderBy(*fo.finding_order())
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy("rule_id")


def _plain(row) -> dict:
    out = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
    for k in ("evidence",):
        if k in out:
            out[k] = [{a: b for a, b in e.items() if b is not None} for e in out[k]]
    return out


def as_dict(result: Result, with_findings: bool = True) -> dict:
    """The normalised report; without its findings it is of bounded size."""
    s = result.snapshot
    camel = lambda d: {"".join(w if i == 0 else w.capitalize() for i, w in enumerate(k.split("_"))): v for k, v in d.items()}
    rows = lambda df: [camel(_plain(r)) for r in df.collect()]
    found = []
    for f in rows(fo.ordered(result.findings)) if with_findings else []:
        place = {k: f.pop(v) for k, v in (("path", "path"), ("line", "line"), ("column", "col")) if v in f}
        found.append(f | ({"location": place} if place else {}))
    counts = fo.summary(result.findings).first().asDict()
    out = {
        "schemaVersion": "1", "tool": {"name": "auditlake", "version": __version__}, "repository": {"root": s.request.root},
        "auditScope": {"mode": "changed" if s.request.changed else "full", "base": s.base, "changes": rows(s["changes"].orderBy("path")) if s.request.changed else [],
                       "reasons": rows(s["reasons"].orderBy("project_id", "reason", "source")) if s.request.changed else [], "affectedProjectIds": [r[0] for r in s["affected"].orderBy("project_id").collect()] if s.request.changed else [],
                       "limitations": [r[0] for r in s["scope_notes"].orderBy("value").collect()] if s.request.changed else []},
        "projects": rows(s["projects"].orderBy("root")), "plannedChecks": rows(s["plans"].orderBy("project_id", "position")), "domainCoverage": rows(result.domains.orderBy("position")),
        "doctorRuns": [camel(r.asDict()) for r in result.runs.orderBy("doctor_id").collect()], **({"findings": found} if with_findings else {}),
        "summary": {"counts": {k: counts[k] for k in fo.SEVERITIES}, "total": counts["total"], "highest": counts["highest"]}, "coverage": rows(fo.bounded_coverage(result.coverage).drop("total", "emitted", "omitted")),
    }
    if s.request.changed:
        top, n = _impact(s["impact"])
        out["sourceImpact"] = {"impacts": rows(top), **camel(n.first().asDict())}
    if result.comparison is not None:
        states = result.comparison.collect()
        out["comparison"] = {k: sorted(r["fingerprint"] for r in states if r["state"] == k) for k in ("new", "unchanged", "resolved")}
    return out


def _impact(impact: DataFrame):
    from auditlake.operators.closures import reported

    return reported(impact)


def to_json(result: Result) -> str:
    return json.dumps(as_dict(result), indent=2, ensure_ascii=False) + "\n"


#: Where the results of a SARIF report go.
RESULTS = "<results>"


def sarif_frame(found: DataFrame) -> dict:
    """A SARIF report without results: its rules are as many as have findings."""
    rules = [{"id": r["rule_id"], "name": r["title"], "shortDescription": {"text": r["title"]}, "help": {"text": r["remediation"] or ""}, "properties": {"category": r["category"]}} for r in first_of_rule(found).collect()]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "auditlake", "semanticVersion": __version__, "rules": rules}}, "results": RESULTS}]}


def to_sarif(result: Result) -> str:
    found = fo.ordered(result.findings).withColumn("level", sarif_level(F.col("severity")))
    if result.comparison is not None:
        found = fo.baseline_state(found, result.comparison)

    def one(r) -> dict:
        out = {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "partialFingerprints": {"auditlake/v1": r["fingerprint"]}}
        if r["path"]:
            at = {"artifactLocation": {"uri": "/".join(quote(p, safe="") for p in r["path"].split("/"))}}
            if r["line"]:
                at["region"] = {"startLine": r["line"], **({"startColumn": r["col"]} if r["col"] else {})}
            out["locations"] = [{"physicalLocation": at}]
        state = r.asDict().get("baseline_state")
        return out | ({"baselineState": state} if state in ("new", "unchanged") else {})

    report = sarif_frame(result.findings)
    report["runs"][0]["results"] = [one(r) for r in found.collect()]
    return json.dumps(report, indent=2) + "\n"


def to_text(result: Result, color: bool = False) -> str:
    paint = {"critical": "31;1", "high": "31", "medium": "33", "low": "36", "info": "2"}
    label = lambda s: f"\x1b[{paint[s]}m{s.upper()}\x1b[0m" if color else s.upper()
    d = as_dict(result)
    base = d["auditScope"]["base"]
    lines = [f"auditlake {__version__}: {d['repository']['root']} ({d['auditScope']['mode']})", *([f"base {json.dumps(base, sort_keys=True)}"] if base else []), ""]

    def items(title: str, rows: list[str]) -> None:
        if rows:
            lines.extend([title, *[f"  {r}" for r in rows[:ITEMS]]])
            if len(rows) > ITEMS:
                lines.append(f"  ... {len(rows) - ITEMS} more omitted")

    items("Projects", [f"{p['id']} ({', '.join(p['ecosystems'])})" for p in d["projects"]])
    items("Affected", d["auditScope"]["affectedProjectIds"])
    items("Impact", [" -> ".join(i["dependencyPath"]) for i in d.get("sourceImpact", {}).get("impacts", [])])
    items("Domains", [f"{c['domain']}: {c['status']}" for c in d["domainCoverage"]])
    items("Changes", [f"{c['status']} {c['path']}" for c in d["auditScope"]["changes"]])
    items("Reasons", [f"{r['projectId']}: {r['reason']} ({r['source']})" for r in d["auditScope"]["reasons"]])
    items("Modules", [f"{r['doctorId']}: {r['status']}, {r['findingCount']} findings" + (f" ({r['skipReason'] or r['error']})" if r["skipReason"] or r["error"] else "") for r in d["doctorRuns"]])
    for f in d["findings"]:
        at = f.get("location", {})
        where = f" {at['path']}" + (f":{at['line']}" if "line" in at else "") if at else ""
        lines += ["", f"{label(f['severity'])} {f['ruleId']}{where}", f"  {f['title']}", f"  {f['message']}", f"  fingerprint {f['fingerprint']}"]
    kept, groups, counts = fo.bounded_limitations(result.coverage.select(F.explode("limitations").alias("value")))
    for g in groups.orderBy("reason").collect():
        more = [f"    {g['omitted_path_count']} more paths omitted"] if g["omitted_path_count"] else []
        lines += ["", f"Limitation of {g['total']} paths: {g['reason']}", *[f"    {path}" for path in g["sample_paths"]], *more]
    grouped = {f"{g['reason']} " for g in groups.collect()}
    loose = [r["value"] for r in kept.orderBy("value").collect() if not any(r["value"].startswith(g) for g in grouped)]
    lines += [""] if loose else []
    items("Limitations", loose)
    if omitted := counts.first()["omitted"]:
        lines.append(f"  {omitted} of all limitations omitted")
    lines += ["", f"{d['summary']['total']} findings, highest {d['summary']['highest'] or 'none'}"]
    return "\n".join(lines) + "\n"
