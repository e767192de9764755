"""A plain fold of table operations, one after the other: what the engine's replay is held against."""

from __future__ import annotations


class Table:
    """A table's state under replay; None stands for unknown."""

    def __init__(self, key: tuple[str, str], at: dict, created: bool):
        off, seen = (False, at) if created else (None, None)
        self.state = {"schema": key[0], "name": key[1], "declared": created, "dropped": False, "rls_enabled": off, "force_rls": off, "policies_complete": created,
                      "grants_complete": created, "last_evidence": at, "rls_evidence": seen, "force_rls_evidence": seen}
        self.policies: dict[str, dict] = {}
        self.grants: dict[tuple[str, str], dict] = {}

    def apply(self, op: dict, at: dict) -> None:
        self.state |= {"last_evidence": at, "dropped": False}
        getattr(self, op["kind"].replace("-", "_"))(op, at)

    def drop_table(self, op, at):
        self.state["dropped"] = True
        self.policies.clear()
        self.grants.clear()

    def set_rls(self, op, at):
        self.state |= {"rls_enabled": op["enabled"], "rls_evidence": at}

    def set_force_rls(self, op, at):
        self.state |= {"force_rls": op["enabled"], "force_rls_evidence": at}

    def create_policy(self, op, at):
        parts = ("command", "permissive", "using_known", "using_expression", "check_known", "check_expression")
        self.policies[op["policy"]] = {"name": op["policy"], "roles": list(op["roles"]), **{k: op[k] for k in parts}, **dict.fromkeys(("evidence", "roles_evidence", "using_evidence", "check_evidence"), at)}

    def alter_policy(self, op, at):
        p = self.policies.setdefault(op["policy"], {"name": op["policy"], "command": None, "permissive": None, "roles": None, "using_known": False, "using_expression": None,
                                                    "check_known": False, "check_expression": None, "roles_evidence": None, "using_evidence": None, "check_evidence": None})
        p["evidence"] = at
        if op["roles"] is not None:
            p |= {"roles": list(op["roles"]), "roles_evidence": at}
        for part in ("using", "check"):
            if op[f"{part}_known"]:
                p |= {f"{part}_known": True, f"{part}_expression": op[f"{part}_expression"], f"{part}_evidence": at}

    def drop_policy(self, op, at):
        self.policies.pop(op["policy"], None)

    def grant(self, op, at):
        for role in op["roles"]:
            for p in op["privileges"]:
                self.grants[p, role] = {"role": role, "privilege": p, "evidence": at}

    def revoke(self, op, at):
        for role in op["roles"]:
            for p in op["privileges"]:
                self.grants.pop((p, role), None)

    def row(self) -> dict:
        return self.state | {"policies": [self.policies[k] for k in sorted(self.policies)], "grants": [self.grants[k] for k in sorted(self.grants)]}


def replayed(ops) -> list[dict]:
    """Final table rows of (op, evidence) pairs in order. CREATE TABLE always starts a table anew; whatever follows a DROP revives it."""
    tables: dict[tuple[str, str], Table] = {}
    for op, at in ops:
        if op["kind"] in ("ignored", "unsupported-relevant"):
            continue
        key = op["schema"], op["name"]
        if op["kind"] == "create-table":
            tables[key] = Table(key, at, True)
        else:
            if key not in tables:
                tables[key] = Table(key, at, False)
            tables[key].apply(op, at)
    return [tables[k].row() for k in sorted(tables)]
