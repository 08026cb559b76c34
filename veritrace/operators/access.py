"""Who may see what: policies as filters on rows, roles, and a guard before statements that people write."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    """attribute, one of == != in contains gte lte gt lt, and a value; "${user.x}" stands for the user's x."""

    attribute: str
    operator: str
    value: Any

    def resolved(self, user: dict[str, Any]) -> Any:
        m = re.fullmatch(r"\$\{user\.(\w+)\}", self.value) if isinstance(self.value, str) else None
        return user.get(m[1]) if m else self.value

    def column(self, value: Any, kind: str | None) -> Column:
        """Whether a row meets it; a null attribute never does."""
        c = F.col(self.attribute)
        if self.operator == "contains" and kind and kind.startswith("array"):
            test = F.array_contains(c, value)
        else:
            test = {
                "==": lambda: c == value, "!=": lambda: c != value, "in": lambda: c.isin(*value), "contains": lambda: c.contains(value),
                "gte": lambda: c >= value, "lte": lambda: c <= value, "gt": lambda: c > value, "lt": lambda: c < value,
            }[self.operator]()
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Policy:
    name: str
    resource: str
    action: str = "read"
    effect: str = "allow"
    conditions: tuple[Condition, ...] = field(default=())

    def column(self, user: dict[str, Any], kinds: dict[str, str]) -> Column:
        """All conditions; those whose value the user lacks are left out. An attribute that rows lack is never met."""
        parts = []
        for c in self.conditions:
            value = c.resolved(user)
            if value is not None:
                parts.append(c.column(value, kinds[c.attribute]) if c.attribute in kinds else F.lit(False))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def _for(policies: list[Policy], resource: str, action: str, effect: str) -> list[Policy]:
    return [p for p in policies if p.resource == resource and p.action == action and p.effect == effect]


def may(rows: DataFrame, policies: list[Policy], resource: str, action: str, user: dict[str, Any]) -> Column:
    """Whether the user may: not where a policy denies; all else is allowed, as nothing has to be allowed by name."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    denied = [p.column(user, kinds) for p in _for(policies, resource, action, "deny")]
    return ~reduce(lambda a, b: a | b, denied, F.lit(False))


def visible(rows: DataFrame, policies: list[Policy], resource: str, user: dict[str, Any], action: str = "read") -> DataFrame:
    """The rows that the user gets to see: those that no policy denies and that meet every allowing policy's conditions."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    wanted = [p.column(user, kinds) for p in _for(policies, resource, action, "allow")]
    return rows.where(may(rows, policies, resource, action, user) & reduce(lambda a, b: a & b, wanted, F.lit(True)))


_THINGS = ("company", "tender", "project", "person")
_READ = {f"{x}:read" for x in _THINGS}
#: What each role may do.
ROLES = {
    "admin": {f"{x}:{y}" for x in (*_THINGS, "user") for y in ("read", "write", "delete")} | {"admin:etl", "admin:schema", "admin:audit", "admin:bulk_import", "admin:export", "search", "lineage", "export"},
    "analyst": _READ | {"search", "lineage", "export", "user:read"},
    "data_engineer": _READ | {f"{x}:write" for x in _THINGS} | {"admin:etl", "admin:bulk_import", "search", "lineage"},
    "viewer": _READ | {"search"},
}


def permitted(roles: list[str], permission: str) -> bool:
    return any(permission in ROLES.get(r, ()) for r in roles)


#: Statements that change anything, or reach beyond the tables.
_FORBIDDEN = (
    (r"\b(drop|alter|create|truncate|insert|update|delete|merge|replace)\b", "it changes data or schemas"), (r"\b(grant|revoke|set|reset|add\s+(jar|file)|cache|uncache|refresh|use|load|export|import)\b", "it changes the session"),
    (r"\b(parquet|csv|json|text|orc|avro|delta|binaryfile)\s*\.\s*`", "it reads a file by its path"), (r"\b(reflect|java_method|try_reflect)\s*\(", "it calls into the machine"),
)
_COSTLY = ((r"\bcross\s+join\b", "a cross join"), (r"\bselect\s+\*(?!.*\blimit\b)", "all columns without a limit"), (r"\border\s+by\b(?!.*\blimit\b)", "a full sort without a limit"))


def guard(statement: str) -> tuple[list[str], list[str]]:
    """(why it is refused, what may be slow) of a SQL statement: only a single reading one passes. Strings and comments do not count."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", statement)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.S).strip().rstrip(";").strip()
    low = bare.lower()
    refused = [] if re.match(r"(select|with|explain|describe|show)\b", low) else ["it is no query"]
    refused += ["it is more than one statement"] if ";" in bare else []
    refused += [why for pattern, why in _FORBIDDEN if re.search(pattern, low)]
    return refused, [why for pattern, why in _COSTLY if re.search(pattern, low, re.S)]
