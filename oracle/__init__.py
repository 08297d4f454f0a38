"""ANSI SQL answers for the registered queries, assembled from named common table expressions."""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    """Register one named sub-query; later steps may refer to earlier ones by name."""
    assert name not in STEPS, name
    STEPS[name] = sql.strip()


def _needed(sql: str, found: dict[str, bool]) -> None:
    for word in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql)):
        if word in STEPS and word not in found:
            found[word] = True
            _needed(STEPS[word], found)


def compose(final: str) -> str:
    found: dict[str, bool] = {}
    _needed(final, found)
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in STEPS.items() if name in found)
    return f"WITH {ctes}\n{final.strip()}" if ctes else final.strip()
