"""Output contracts as markdown: made from a schema, and held against one."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_ROW = re.compile(r"\|\s*(\d+)\s*\|\s*`([^`]+)`\s*\|\s*`([^`]+)`\s*\|\s*(\w+)\s*\|")


def contract_table(schema: T.StructType) -> str:
    """A markdown table of number, name, type and nullability of each field, in order."""
    rows = [f"| {i} | `{f.name}` | `{f.dataType.simpleString()}` | {'yes' if f.nullable else 'no'} |" for i, f in enumerate(schema, 1)]
    return "\n".join(["| # | Column | Type | Nullable |", "|--:|---|---|---|", *rows, ""])


def contract_drift(schema: T.StructType, contract: str) -> dict[str, list]:
    """missing, extra, retyped (name, type in the contract, type now) and moved columns of a schema against a contract's table.

    All are empty where both agree. Other text of the contract is skipped; a contract without a table raises ValueError."""
    told = [(name, kind) for _, name, kind, _ in _ROW.findall(contract)]
    if not told:
        raise ValueError("the contract has no table of columns")
    own = [(f.name, f.dataType.simpleString()) for f in schema]
    types, now = dict(told), dict(own)
    both = [c for c, _ in told if c in now]
    return {
        "missing": [c for c, _ in told if c not in now],
        "extra": [c for c, _ in own if c not in types],
        "retyped": [(c, types[c], now[c]) for c in both if types[c] != now[c]],
        "moved": [c for c, d in zip(both, [c for c, _ in own if c in types], strict=True) if c != d],
    }
