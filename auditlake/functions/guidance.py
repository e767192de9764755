"""What findings on row-level security say beyond their message: impact, what a remedy must keep, advice, and SQL to start from.

Suggested SQL is text only. It names the table and policy of its row, quoted, and leaves the predicate to be filled in.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.rls import quote_identifier


class Guidance(NamedTuple):
    impact: str
    keep: str
    advice: str


RULES = {
    "reachable-truncate": Guidance("One statement of an application role empties the table; policies are not asked.", "No application role holds TRUNCATE; what maintenance needs stays with a role of its own.", "Revoke TRUNCATE from application roles."),
    "rls-disabled-exposed": Guidance("Rows go to application roles unfiltered, as far as their grants reach.", "Application access to rows passes through enabled row-level security and the smallest grants.", "Enable row-level security and add a policy for each role and command that needs one."),
    "rls-disabled": Guidance("Nothing will filter rows once a role of the application gets access.", "Row-level security is on before a role of the application is granted anything.", "Enable row-level security before the table is granted to an application role."),
    "rls-enabled-no-policies": Guidance("All but the owner are denied; workflows of other roles may fail.", "Denial stays the default; a policy is added for a confirmed workflow alone and no wider than it.", "Add policies for the roles and commands that need the table."),
    "force-rls-disabled": Guidance("Sessions of the owner see and change every row.", "The owner's workflows pass through policies, or their exception is reviewed and written down.", "Force row-level security once the owner's maintenance is known to work with it."),
    "public-unconditional-read": Guidance("Whoever holds a public role reads every row of the table.", "Public reads stay bound to a reviewed predicate on content, owner or tenant.", "Restrict the policy by owner, tenant or an explicit predicate on public content."),
    "public-unconditional-write": Guidance("Whoever holds a public role writes rows of any owner or tenant.", "Writes of the application prove the owner or tenant of the rows, before and after.", "Require authenticated ownership in USING and WITH CHECK."),
    "write-policy-missing-check": Guidance("New and changed rows may leave the boundary that selects existing ones.", "Every path that inserts or updates rows checks the row that results.", "Add WITH CHECK, so that resulting rows obey the boundary of owner and tenant."),
    "write-policy-unconditional-check": Guidance("The policy takes any resulting row.", "Checks of writes refuse rows beyond the boundary of owner or tenant.", "Replace the check by a condition on owner or tenant."),
    "public-permissive-policy": Guidance("The policy widens whatever other permissive policies allow.", "The union of all permissive policies stays within least privilege for public roles.", "See whether the policy should be restrictive, or for authenticated roles alone."),
    "multiple-permissive-policies": Guidance("Together the policies allow rows that none seems to allow alone.", "The union of the predicates keeps to what the role may do with this command.", "Read the policies together and confirm that what any one allows is meant."),
    "broad-default-table-privilege": Guidance("Tables yet to be created are open from their first moment.", "Defaults of this owner and schema grant nothing unmeant on future tables.", "Revoke the default and grant each role the privileges it needs, table by table."),
    "rls-bypass-role": Guidance("An application session can become a role that no policy binds.", "No membership leads from application roles to SUPERUSER or BYPASSRLS.", "Remove the membership path; keep administration to credentials of its own."),
}

WRITES = {
    "INSERT": "Require authenticated ownership of inserted rows in WITH CHECK.", "DELETE": "Require authenticated ownership of deleted rows in USING.",
}

_ADAPT, _OWNER = "-- A start to be adapted to the schema and access model before it is run.", "((select auth.uid()) = <owner_column>)"


def write_advice(command: Column) -> Column:
    out = F.lit(RULES["public-unconditional-write"].advice)
    for name, text in WRITES.items():
        out = F.when(command == name, F.lit(text)).otherwise(out)
    return out


def qualified(schema: Column, table: Column) -> Column:
    return F.concat(quote_identifier(schema), F.lit("."), quote_identifier(table))


def suggested_sql(rule: str, schema: Column, table: Column, policy: Column | None = None, command: Column | None = None) -> Column | None:
    """array<string>: lines of SQL for a finding of a rule, or None for rules that have none."""
    at = qualified(schema, table)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    if rule in ("rls-disabled", "rls-disabled-exposed"):
        return F.array(say("alter table ", at, " enable row level security;"), F.lit("-- Add policies for the access model before client roles are granted the table."))
    if rule == "force-rls-disabled":
        return F.array(say("alter table ", at, " force row level security;"))
    if rule == "rls-enabled-no-policies":
        name = quote_identifier(F.concat(F.lit("read own "), table))
        return F.array(F.lit(_ADAPT), say("create policy ", name), say("  on ", at), F.lit("  for select"), F.lit("  to authenticated"), F.lit(f"  using {_OWNER};"))
    if policy is None or rule not in ("public-unconditional-read", "public-unconditional-write", "write-policy-missing-check"):
        return None
    head = [F.lit(_ADAPT), say("alter policy ", quote_identifier(policy)), say("  on ", at)]
    if rule == "public-unconditional-read":
        return F.array(*head, F.lit("  using (<public_read_predicate>);"))
    if rule == "write-policy-missing-check":
        return F.array(*head, F.lit(f"  with check {_OWNER};"))
    using, check = f"  using {_OWNER}", f"  with check {_OWNER}"
    last = F.when(command == "DELETE", F.array(F.lit(using + ";"))).when(command == "INSERT", F.array(F.lit(check + ";"))).otherwise(F.array(F.lit(using), F.lit(check + ";")))
    return F.concat(F.array(*head, F.lit("  to authenticated")), last)


def remediation(advice: Column, sql: Column | None) -> Column:
    return advice if sql is None else F.concat(advice, F.lit("\n\nSuggested SQL:\n"), F.array_join(sql, "\n"))


def quoted_argument(value: str) -> str:
    """A word as a shell takes it."""
    import re

    return value if re.fullmatch(r"[A-Za-z0-9_./:@%+=,-]+", value) else "'" + value.replace("'", "'\"'\"'") + "'"


def live_verification(schemas: tuple[str, ...]) -> tuple[str, str]:
    """(command, what is expected) of an audit of the same schemas."""
    words = ["auditlake", "audit", ".", *[w for s in schemas for w in ("--database-schema", s)], "--with-database", "--json"]
    return " ".join(map(quoted_argument, words)), f"This fingerprint is absent and live database coverage is completed for the same schemas: {', '.join(schemas)}."


def live_constraint(schemas: tuple[str, ...]) -> str:
    return f"Verification needs access to the same audited schemas, authorised apart from this report: {', '.join(schemas)}. The command holds no credentials."
