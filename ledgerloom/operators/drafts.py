"""Edits from words: a writer proposes operations, which are checked before they are applied, and a history of edits."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from ..functions.expressions import ExpressionError
from ..plans.schema import Schema, schema_summary
from .edit import EditError, Op, apply, check_ops
from .recipes import Recipe
from .validate import Report

#: Words of a request that choose some of the rows.
CHOOSING = ("if", "unless", "where", "whose", "except", "without", "before", "after", "above", "below", "older", "newer", "cheaper", "dearer", "more than", "less than", "at least", "at most", "fewer than")
_CHOOSING = re.compile(rf"\b({'|'.join(CHOOSING)})\b", re.I)


class Writer(Protocol):
    """Whatever turns a request into operations, a language model's client among them: dictionaries with op and args."""

    def propose(self, request: str, schema: str, fault: str | None) -> list[dict]: ...


def check_filter(request: str, ops: list[Op]) -> None:
    """A request that chooses rows must not become operations on all rows."""
    word = _CHOOSING.search(request)
    open_ = [o.op for o in ops if o.op in ("set_values", "update_pool", "delete_rows") and not (o.args.get("where") or "").strip()]
    if word and open_ and all(o.op != "add_rows" for o in ops):
        raise EditError(f"the request says {word[0]!r}, but {', '.join(open_)} would take all rows")


def _operations(proposed: list[dict]) -> list[Op]:
    out = []
    for p in proposed:
        if not isinstance(p, dict) or not isinstance(p.get("op"), str):
            raise EditError(f"{p!r} is no operation")
        args = dict(p.get("args") or {})
        if isinstance(r := args.get("recipe"), dict):
            args["recipe"] = Recipe(r.get("kind", ""), r.get("args") or {}, r.get("null_ratio", 0.0))
        out.append(Op(p["op"], args))
    if not out:
        raise EditError("no operation was proposed")
    return out


def draft(writer: Writer, request: str, schema: Schema, table: str) -> list[Op]:
    """Checked operations for a request. A proposal with a fault goes back to the writer once, with the fault; a second
    one raises EditError."""
    fault = None
    for last in (False, True):
        try:
            ops = _operations(writer.propose(request, schema_summary(schema), fault))
            check_ops(schema, table, ops)
            check_filter(request, ops)
            return ops
        except (EditError, ExpressionError) as e:
            if last:
                raise EditError(str(e)) from e
            fault = str(e)
    raise AssertionError


@dataclass
class History:
    """Edits in order over the tables they began with. Each is kept as what was done, so the state after any of them can
    be made again; nothing of the tables is stored."""

    schema: Schema
    start: dict[str, DataFrame]
    plans: dict[str, dict[str, Recipe]] | None = None
    edits: list[tuple[str, list[Op], int]] = field(default_factory=list)
    settle: Callable[[DataFrame], DataFrame] | None = None

    def do(self, table: str, ops: list[Op], seed: int = 0) -> Report:
        """Apply an edit to the state so far; one whose result breaks the schema isn't kept."""
        self.edits.append((table, list(ops), seed))
        try:
            _, report = self._state(len(self.edits))
        except Exception:
            self.edits.pop()
            raise
        if not report.ok:
            self.edits.pop()
        return report

    def undo(self) -> None:
        self.edits.pop()

    def state(self, n: int | None = None) -> dict[str, DataFrame]:
        """The tables after the first n edits (all, if n isn't given)."""
        return self._state(len(self.edits) if n is None else n)[0]

    def _state(self, n: int) -> tuple[dict[str, DataFrame], Report]:
        tables, report = dict(self.start), Report()
        for table, ops, seed in self.edits[:n]:
            tables, report = apply(self.schema, tables, table, ops, seed=seed, plans=self.plans)
            if self.settle is not None:
                tables = {name: self.settle(df) for name, df in tables.items()}
        return tables, report
