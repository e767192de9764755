"""Replay of table operations as a stream, with the results of the batch replay and operations in any order of arrival.

A table's state is a set of registers, each with the sequence number of the operation that wrote it: its flags, a map of its policies
(their parts are registers of their own) and a map of its grants. The operation of the highest number decides on a register, and what
began a life (CREATE TABLE, DROP TABLE, CREATE or DROP POLICY) voids whatever was written before it, also if it arrives later. So
nothing has to be held back, and an operation touches its own policy or grants alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from auditlake.operators.sqlrls import OPERATION_FIELDS, TABLE
from auditlake.schemas import TABLE_STATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = ("base", "evidence", "roles", "using", "check")


def sequenced(ops: DataFrame) -> DataFrame:
    """The rows that replay_stream takes, of the batch's operations: fields of the operation, its place, and seq, their order in a stream."""
    relevant = ops.where(~F.col("op.kind").isin("ignored", "unsupported-relevant"))
    seq = F.shiftleft(F.col("position").cast("bigint"), 32) + F.col("ordinal")
    return relevant.select("stream_id", *[F.col(f"op.{c}").alias(c) for c in OPERATION_FIELDS if c != "reason"], "path", F.col("line").cast("int").alias("line"), seq.alias("seq"))


def newer(register: list | None, seq: int, *value) -> list:
    """The register after a write of this number."""
    return [seq, *value] if register is None or seq > register[0] else register


def apply_to_table(flags: dict, op: dict) -> None:
    """The table's own registers: born and cleared (numbers), made, last, rls, force."""
    kind, seq, at = op["kind"], op["seq"], [op["path"], op["line"]]
    if seq < flags.get("born", -1):
        return
    if kind == "create-table":
        flags |= {"born": seq, "made": at}
        for name in ("rls", "force", "last"):
            if flags.get(name) and flags[name][0] < seq:
                del flags[name]
    if kind in ("create-table", "drop-table"):
        flags["cleared"] = max(flags.get("cleared", -1), seq)
    flags["last"] = newer(flags.get("last"), seq, kind, at)
    if kind in ("set-rls", "set-force-rls"):
        name = "rls" if kind == "set-rls" else "force"
        flags[name] = newer(flags.get(name), seq, op["enabled"], at)


def apply_to_policy(policy: dict, op: dict) -> None:
    """A policy's registers: reset (a number), base, evidence, roles, using, check."""
    kind, seq, at = op["kind"], op["seq"], [op["path"], op["line"]]
    if seq < policy.get("reset", -1):
        return
    if kind != "alter-policy":
        void(policy, seq - 1)
        policy["reset"] = seq
    if kind == "drop-policy":
        return
    if kind == "create-policy":
        policy["base"] = newer(policy.get("base"), seq, op["command"], op["permissive"])
    policy["evidence"] = newer(policy.get("evidence"), seq, at)
    if op["roles"] is not None:
        policy["roles"] = newer(policy.get("roles"), seq, op["roles"], at)
    for part in ("using", "check"):
        if op[f"{part}_known"]:
            policy[part] = newer(policy.get(part), seq, op[f"{part}_expression"], at)


def void(policy: dict, upto: int) -> None:
    """Takes back what operations up to this number wrote."""
    for part in _PARTS:
        if part in policy and policy[part][0] <= upto:
            del policy[part]
    if policy.get("reset", -1) <= upto:
        policy.pop("reset", None)


def _place(at: list | None) -> dict | None:
    return None if at is None else {"path": at[0], "line": at[1]}


def row(key: tuple, flags: dict, policies: dict[str, dict], grants: dict[tuple[str, str], list]) -> dict:
    """The table's state as the batch has it; policies and grants of before it was cleared are left out."""
    declared, made, last = "born" in flags, _place(flags.get("made")), flags["last"]
    flag = lambda name: flags[name][1] if name in flags else False if declared else None
    seen = lambda name: _place(flags[name][2]) if name in flags else made
    out = {**dict(zip(TABLE, key)), "declared": declared, "dropped": last[1] == "drop-table", "rls_enabled": flag("rls"), "force_rls": flag("force"), "policies_complete": declared, "grants_complete": declared}
    listed = []
    for name in sorted(policies):
        p = policies[name]
        if "evidence" not in p:
            continue
        base, at = p.get("base", [0, None, None]), lambda part: _place(p[part][-1]) if part in p else None  # noqa: B023
        listed.append({
            "name": name, "command": base[1], "permissive": base[2], "roles": p["roles"][1] if "roles" in p else None, "using_known": "using" in p, "using_expression": p["using"][1] if "using" in p else None,
            "check_known": "check" in p, "check_expression": p["check"][1] if "check" in p else None, "evidence": at("evidence"), "roles_evidence": at("roles"), "using_evidence": at("using"), "check_evidence": at("check"),
        })
    held = [{"role": role, "privilege": privilege, "evidence": _place(g[2])} for (privilege, role), g in sorted(grants.items()) if g[1] == "grant"]
    return out | {"policies": listed, "grants": held, "last_evidence": _place(last[2]), "rls_evidence": seen("rls"), "force_rls_evidence": seen("force")}


class TableReplay(StatefulProcessor):
    """State of one table: a value of its flags, a map of policies by name, a map of grants by privilege and role."""

    def init(self, handle) -> None:
        self.flags = handle.getValueState("flags", "state string")
        self.policies = handle.getMapState("policies", "name string", "state string")
        self.grants = handle.getMapState("grants", "privilege string, role string", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flags = json.loads(self.flags.get()[0]) if self.flags.exists() else {}
        cleared = flags.get("cleared", -1)
        for batch in rows:
            for op in batch.to_dict("records"):
                op = {k: _plain(v) for k, v in op.items()}
                apply_to_table(flags, op)
                if op["kind"].endswith("policy"):
                    name = (op["policy"],)
                    state = json.loads(self.policies.getValue(name)[0]) if self.policies.containsKey(name) else {}
                    apply_to_policy(state, op)
                    self.policies.updateValue(name, (json.dumps(state),))
                elif op["kind"] in ("grant", "revoke"):
                    for held in ((p, r) for p in op["privileges"] for r in op["roles"]):
                        state = json.loads(self.grants.getValue(held)[0]) if self.grants.containsKey(held) else None
                        self.grants.updateValue(held, (json.dumps(newer(state, op["seq"], op["kind"], [op["path"], op["line"]])),))
        self.flags.update((json.dumps(flags),))
        yield pd.DataFrame([row(key, flags, *self._kept(flags.get("cleared", -1), cleared))])

    def _kept(self, cleared: int, before: int) -> tuple[dict, dict]:
        """Policies and grants of after the table was cleared; where that has moved, the others leave the state."""
        policies = {k[0]: json.loads(v[0]) for k, v in self.policies.iterator()}
        grants = {(k[0], k[1]): json.loads(v[0]) for k, v in self.grants.iterator()}
        for name, p in [*policies.items()]:
            was = json.dumps(p)
            void(p, cleared)
            if cleared != before and json.dumps(p) != was:
                self.policies.updateValue((name,), (json.dumps(p),))
        for held, g in [*grants.items()]:
            if g[0] <= cleared:
                del grants[held]
                self.grants.removeKey(held)
        return policies, grants

    def close(self) -> None:
        pass


def _plain(value):
    """A cell of a pandas row as plain Python: lists for arrays, None for missing values."""
    if isinstance(value, str) or value is None:
        return value
    if hasattr(value, "__len__"):
        return list(value)
    if value != value or value is pd.NaT:
        return None
    return value.item() if hasattr(value, "item") else value


def replay_stream(ops: DataFrame) -> DataFrame:
    """Of a streaming frame of sequenced() rows: the state of each table after each trigger that touched it, as sqlrls.replay has it.

    Operations may arrive in any order, and again. The session's state store must keep maps (spark.sql.streaming.stateStore.providerClass: PROVIDER).
    """
    return ops.groupBy(*TABLE).transformWithStateInPandas(TableReplay(), TABLE_STATE, "Update", "None")
