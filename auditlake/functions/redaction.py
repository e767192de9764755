"""Redaction of command output and of database errors."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

WITHHELD = "[redacted]"
SENSITIVE_KEY = re.compile(r"(?i)(key|token|secret|password|passwd|credential|auth|database_url|db_url)")


def sensitive_values(env: Mapping[str, str]) -> list[str]:
    """Values of environment variables whose name looks secret, longest first."""
    return sorted({v for k, v in env.items() if v and len(v) >= 4 and SENSITIVE_KEY.search(k)}, key=lambda v: (-len(v), v))


def redacted(text: Column, env: Mapping[str, str] | None = None) -> Column:
    """Without the environment's secret values, URL user info, bearer tokens and sk- keys."""
    out = text
    for value in sensitive_values(env or {}):
        out = F.replace(out, F.lit(value), F.lit(WITHHELD))
    out = F.regexp_replace(out, r"([A-Za-z][A-Za-z0-9+.-]*://)[^/\s@]+@", f"$1{re.escape(WITHHELD)}@".replace("\\", ""))
    out = F.regexp_replace(out, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", f"$1 {WITHHELD}")
    return F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{8,}", WITHHELD)


def connection_string(value: str | None, env: Mapping[str, str]) -> str | None:
    """The given one, else DATABASE_URL, else SUPABASE_DB_URL; blanks don't count."""
    return next((v for v in (value, env.get("DATABASE_URL"), env.get("SUPABASE_DB_URL")) if v and v.strip()), None)


def credentials(connection: str) -> list[str]:
    """User and password of a connection string as written, decoded and encoded anew, longest first."""
    found: set[str] = set()
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)@", connection)
    if m:
        for part in m[1].split(":", 1):
            found |= {part, unquote(part), quote(unquote(part), safe="")}
    return sorted((f for f in found if f), key=lambda f: (-len(f), f))


def database_error(message: str, connection: str) -> str:
    """A database's message without credentials, in time linear in its length."""
    out = re.sub(r"(\bpostgres(?:ql)?://)([^/?#\s]*)@", lambda m: f"{m[1]}{WITHHELD}@", message)
    for secret in credentials(connection):
        out = re.sub(rf"(?i)\b(user(?:name)?|password)\b([ =:\"']{{1,4}}){re.escape(secret)}", lambda m: f"{m[1]}{m[2]}{WITHHELD}", out)
        if len(secret) >= 3:
            out = out.replace(secret, WITHHELD)
    out = re.sub(r"(?i)(authentication failed for )(user )?[\"']?[^\s\"')]+[\"']?", lambda m: f"{m[1]}{m[2] or ''}{WITHHELD}", out)
    return re.sub(r"\((user|username|password)[=:] ?[^)\s]+\)", lambda m: f"({m[1]}={WITHHELD})", out)


def host(connection: str) -> str | None:
    return urlsplit(connection).hostname
