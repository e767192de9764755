"""Row-level-security predicates and normalisers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
APPLICATION_ROLES = ("anon", "anonymous", "authenticated", "public")
PUBLIC_LIKE = ("public", "anon", "anonymous")
COMMANDS = ("SELECT", "INSERT", "UPDATE", "DELETE")
ROW_PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE")
RELATION_PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER")


def unconditional(expression: Column) -> Column:
    """A predicate that lets every row pass: none at all, or true in one of its plain spellings."""
    return expression.isNull() | F.lower(F.trim(F.regexp_replace(expression, "[()]", ""))).isin("", "true", "1 = 1", "1=1")


def effective_check(command: Column, using: Column, check: Column) -> Column:
    return F.coalesce(check, F.when(command.isin("UPDATE", "ALL"), using))


def unconditional_write(command: Column, using: Column, check: Column) -> Column:
    checked = unconditional(effective_check(command, using, check))
    return (
        F.when(command == "INSERT", checked)
        .when(command.isin("UPDATE", "ALL"), unconditional(using) | checked)
        .when(command == "DELETE", unconditional(using))
        .otherwise(F.lit(False))
    )


def missing_check(command: Column, using: Column, check: Column) -> Column:
    return check.isNull() & ~command.isin("SELECT", "DELETE") & unconditional(effective_check(command, using, check))


def is_application_role(role: Column) -> Column:
    return F.lower(role).isin(*APPLICATION_ROLES)


def any_role(roles: Column, names: tuple[str, ...]) -> Column:
    return F.exists(roles, lambda r: F.lower(r).isin(*names))


def policy_roles(text: Column) -> Column:
    """Roles from the catalog's text form {a,"b"}."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"^\{|\}$", ""), ","), lambda r: F.regexp_replace(F.trim(r), '^"|"$', "")), lambda r: r != "")


def policy_command(command: Column) -> Column:
    up = F.upper(command)
    return F.when(up.isin(*COMMANDS), up).otherwise(F.lit("ALL"))


def permissive(value: Column) -> Column:
    return F.upper(value.cast("string")).isin("PERMISSIVE", "TRUE")


def grantee(oid: Column, name: Column) -> Column:
    """PUBLIC for oid 0; an error for a name that is missing."""
    return F.when(oid == 0, "PUBLIC").when(name.isNull(), F.raise_error(F.lit("a grantee has no name")).cast("string")).otherwise(name)


def relation_privilege(value: Column) -> Column:
    up = F.upper(value)
    return F.when(up.isin(*RELATION_PRIVILEGES), up).otherwise(F.raise_error(F.lit("unknown table privilege")).cast("string"))


def default_severity(privilege: Column) -> Column:
    return F.when(privilege.isin("INSERT", "UPDATE", "DELETE", "TRUNCATE"), "high").when(privilege == "SELECT", "medium").otherwise("low")


def quote_identifier(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def known_policy(p: Column) -> Column:
    """No part of a replayed policy is unknown."""
    return p["command"].isNotNull() & p["permissive"].isNotNull() & p["roles"].isNotNull() & p["using_known"] & p["check_known"]
