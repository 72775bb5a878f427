"""Where families register a query and, when SQL can state it, its SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, str] = {}

# Results are rounded for comparison. Many values are short decimals that would
# sit exactly on a rounding boundary, where the two engines may differ in the
# last bit; the shift moves the boundary off them on both sides.
ROUND_SHIFT = 0.0137


def view(name: str, body: str) -> None:
    """Define a named subquery usable in SQL texts and in later views."""
    _VIEWS[name] = body.strip()


def with_views(text: str) -> str:
    """Prefix a SQL text with the named subqueries it uses, in order."""
    order: list[str] = []
    open_views: set[str] = set()

    def visit(sql: str) -> None:
        for word in re.findall(r"(?i:from|join)\s+([a-z_][a-z_0-9]*)", sql):
            if word in _VIEWS and word not in order and word not in open_views:
                open_views.add(word)
                visit(_VIEWS[word])
                open_views.discard(word)
                order.append(word)

    visit(text)
    if not order:
        return text.strip()
    head = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order)
    return f"WITH RECURSIVE {head}\n{text.strip()}"


def _shift_rounding(sql: str) -> str:
    """Add the output offset of ``common.r`` to every ``round(x, digits)``."""
    out, i = "", 0
    for m in re.finditer(r"(?<![A-Za-z_])round\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inside = sql[m.end():j - 1]
        value, digits = inside.rsplit(",", 1)
        value = _shift_rounding(value)
        if int(digits) > 0:
            value = f"({value}) + {ROUND_SHIFT:.4f}e-{int(digits)}::DOUBLE"
        out += sql[i:m.start()] + f"round({value}, {int(digits)})"
        i = j
    return out + sql[i:]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: _shift_rounding(with_views(text)) for name, text in ORACLES.items()}
