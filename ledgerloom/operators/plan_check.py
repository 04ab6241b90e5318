"""Faults of a generation plan against its schema, and the merge of proposed changes into a plan.

A plan is checked before rows are made: every column has a recipe that its type can hold, ranges fit, references exist,
and columns don't wait for each other. Proposals that would bring in a fault are left out, each with a note.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from ..functions.expressions import ExpressionError, compile_expression, parse_parent_ref
from ..plans.schema import INTEGERS, NUMERIC, TEMPORAL, TEXTUAL, Column, Schema, Table
from .consistency import AGGREGATES
from .recipes import LEXICON, Recipe, TablePlan

DISTRIBUTIONS = ("uniform", "skewed_low", "skewed_high", "normal")
_NUMBERS = {"int_range", "derived", "constant", "aggregate"}
_TEXTS = {"pattern", "pool", "enum", "constant", "derived"}


def kinds_for(c: Column) -> set[str]:
    """Kinds of recipe whose values a column of this type can hold. References take whatever type their parent has."""
    if c.type in INTEGERS:
        return _NUMBERS | {"sequence", "fk"}
    if c.type in NUMERIC:
        return _NUMBERS | {"decimal_range", "fk"}
    if c.type == "BOOLEAN":
        return {"boolean", "constant", "derived"}
    if c.type in TEMPORAL:
        return {"date", "constant", "derived", *(("datetime",) if c.type == "DATETIME" else ())}
    if c.type == "ENUM":
        return {"enum", "constant", "derived"}
    return _TEXTS | {"fk"} if c.type in ("VARCHAR", "CHAR", "UUID") else _TEXTS if c.type == "TEXT" else {"pattern", "pool", "constant"}


def _parent(schema: Schema, t: Table, column: str) -> Table | None:
    fk = next((fk for fk in t.foreign_keys if len(fk.columns) == 1 and fk.columns[0].lower() == column.lower()), None)
    return schema.table(fk.parent) if fk else None


def _known(t: Table, name: str, types: tuple[str, ...]) -> bool:
    return t.has(name) and t.column(name).type in types


def _range(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    lo, hi = a.get("lo"), a.get("hi")
    if lo is None or hi is None:
        yield "a range needs lo and hi"
    elif lo > hi:
        yield f"the range {lo} to {hi} is empty"
    elif c.type == "DECIMAL" and max(abs(lo), abs(hi)) >= 10 ** (c.precision - c.scale):
        yield f"the range exceeds DECIMAL({c.precision}, {c.scale})"
    elif c.type in INTEGERS and max(abs(lo), abs(hi)) >= {"SMALLINT": 2**15, "INTEGER": 2**31}.get(c.type, 2**63):
        yield f"the range exceeds {c.type}"
    if a.get("distribution", "uniform") not in DISTRIBUTIONS:
        yield f"unknown distribution {a['distribution']!r}"


def _choices(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    values = a.get("values") or []
    if not values and not a.get("brief"):  # a pool with a brief is filled later
        yield "no values"
    if c.type == "ENUM" and (bad := [v for v in values if v not in c.values]):
        yield f"values {bad} aren't in the ENUM {list(c.values)}"
    if c.type in ("VARCHAR", "CHAR") and c.length and any(len(str(v)) > c.length for v in values):
        yield f"a value is longer than {c.length} characters"
    weights = a.get("weights")
    if weights and (len(weights) != len(values) or min(weights) < 0 or sum(weights) <= 0):
        yield "weights don't match the values"


def constant_fault(c: Column, value) -> str | None:
    """Why a constant can't be stored in the column, or None."""
    if value is None:
        return None if c.nullable else "NULL in a NOT NULL column"
    text = str(value).strip()
    try:
        if c.type in INTEGERS:
            int(text)
        elif c.type in NUMERIC:
            float(text)
        elif c.type == "DATE":
            dt.date.fromisoformat(text[:10])
        elif c.type == "DATETIME":
            dt.datetime.fromisoformat(text)
        elif c.type == "BOOLEAN" and text.lower() not in ("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"):
            return f"{value!r} is no boolean"
    except ValueError:
        return f"{value!r} is no {c.type}"
    if c.type == "ENUM" and text not in c.values:
        return f"{value!r} isn't in the ENUM"
    if c.max_length and len(str(value)) > c.max_length:
        return f"{value!r} is longer than {c.max_length} characters"
    return None


def _constant(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    if fault := constant_fault(c, a.get("value")):
        yield fault


def _reference(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    target = str(a.get("parent", ""))
    if not schema.has(target) or not schema.table(target).has(str(a.get("column", ""))):
        yield f"there is no {target}.{a.get('column')}"
    fk = next((fk for fk in t.foreign_keys if c.name in fk.columns), None)
    if fk is None:
        yield "the column is no foreign key"
    elif fk.parent.lower() != target.lower():
        yield f"the schema refers to {fk.parent}, not {target}"


def _window(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    if a.get("start") is None or a.get("end") is None:
        yield "a window needs start and end"
    elif a["start"] > a["end"]:
        yield f"the window {a['start']} to {a['end']} is empty"
    if a.get("max") is not None and a["max"] < a.get("min", 0):
        yield f"at most {a['max']} days is less than at least {a.get('min', 0)}"
    if after := a.get("after"):
        if ref := parse_parent_ref(after):
            parent = _parent(schema, t, ref[0])
            if parent is None:
                yield f"after {after!r}: {ref[0]} is no foreign key"
            elif not _known(parent, ref[1], TEMPORAL):
                yield f"after {after!r}: {parent.name} has no date {ref[1]}"
        elif not _known(t, after, TEMPORAL):
            yield f"after {after!r}: there is no such date"


def _derived(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    try:
        compiled = compile_expression(a.get("expression", ""))
    except ExpressionError as e:
        yield str(e)
        return
    yield from (f"the expression names unknown column {n}" for n in compiled.column_refs if not t.has(n))
    for fk, name in compiled.parent_refs:
        parent = _parent(schema, t, fk)
        if parent is None:
            yield f"parent({fk}) is no foreign key"
        elif not parent.has(name):
            yield f"{parent.name} has no column {name}"


def _aggregate(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    if not schema.has(str(a.get("child", ""))):
        yield f"there is no child table {a.get('child')}"
        return
    child = schema.table(a["child"])
    if (parent := _parent(schema, child, str(a.get("fk", "")))) is None or parent.name != t.name:
        yield f"{child.name}.{a.get('fk')} doesn't refer to {t.name}"
    if a.get("agg") not in AGGREGATES:
        yield f"unknown aggregate {a.get('agg')!r}"
    elif a["agg"] != "count" and not _known(child, str(a.get("column", "")), NUMERIC):
        yield f"{child.name} has no numeric column {a.get('column')}"


def _template(schema: Schema, t: Table, c: Column, a: dict) -> Iterable[str]:
    for piece in re.findall(r"\{([^}]*)\}", a.get("template", "")):
        if m := re.fullmatch(r"col:(\w+)(?:\|(\w+))?", piece):
            if not t.has(m[1]):
                yield f"the template names unknown column {m[1]}"
            if m[2] not in (None, "lower", "upper", "initial", "slug"):
                yield f"unknown change {m[2]!r} in the template"
        elif m := re.fullmatch(r"faker:(\w+)", piece):
            if m[1] not in LEXICON:
                yield f"unknown word list {m[1]!r}"
        elif piece != "seq":
            yield f"unknown part {{{piece}}} in the template"


_CHECKS: dict[str, Callable] = {
    "int_range": _range, "decimal_range": _range, "enum": _choices, "pool": _choices, "constant": _constant, "fk": _reference,
    "date": _window, "datetime": _window, "derived": _derived, "aggregate": _aggregate, "pattern": _template,
}


def column_faults(schema: Schema, t: Table, c: Column, r: Recipe) -> list[str]:
    if r.kind not in kinds_for(c):
        return [f"recipe {r.kind} doesn't suit {c.type}"]
    out = list(_CHECKS[r.kind](schema, t, c, r.args)) if r.kind in _CHECKS else []
    if r.null_ratio > 0 and not c.nullable:
        out.append("nulls in a NOT NULL column")
    if not 0 <= r.null_ratio <= 1:
        out.append(f"a share of {r.null_ratio} nulls")
    if r.kind == "boolean" and not 0 <= r.args.get("ratio", 0.5) <= 1:
        out.append(f"a share of {r.args['ratio']} true values")
    return out


def plan_faults(plans: dict[str, TablePlan], schema: Schema) -> list[str]:
    """All faults of a plan, as texts that begin with table or table.column; none means that rows can be made."""
    from .generate import column_order  # which knows what columns wait for
    from .unique import ExpansionError

    out = []
    given = {k.lower(): p for k, p in plans.items()}
    out += [f"{p.table}: unknown table" for k, p in given.items() if not schema.has(k)]
    for t in schema.tables:
        p = given.get(t.name.lower())
        if p is None:
            out.append(f"{t.name}: missing from the plan")
            continue
        if p.rows < 0:
            out.append(f"{t.name}: {p.rows} rows")
        out += [f"{t.name}.{n}: unknown column" for n in p.columns if not t.has(n)]
        have = {n.lower(): r for n, r in p.columns.items()}
        before = len(out)
        for c in t.columns:
            r = have.get(c.name.lower())
            out += [f"{t.name}.{c.name}: no recipe"] if r is None else [f"{t.name}.{c.name}: {x}" for x in column_faults(schema, t, c, r)]
        if len(out) == before:
            try:
                column_order(t, {c.name: have[c.name.lower()] for c in t.columns})
            except ExpansionError as e:
                out.append(f"{t.name}: {str(e).split(': ', 1)[-1]}")
    return out


@dataclass(frozen=True)
class Override:
    """A proposed recipe for a column: kind and what it says; what it leaves out is kept where the kind stays. Without a
    kind, only the share of nulls changes."""

    table: str
    column: str
    kind: str | None = None
    args: dict | None = None
    null_ratio: float | None = None


#: A proposal may ask for so many times the rows of the plan.
MOST_TIMES = 5


def merge(plans: dict[str, TablePlan], overrides: Iterable[Override], schema: Schema, rows: dict[str, int] | None = None, most_rows: int | None = None) -> tuple[dict[str, TablePlan], list[str]]:
    """A new plan with the proposals that bring in no fault, and a note for each that was left out or cut."""
    out, notes, used, asked = dict(plans), [], 0, list(overrides)
    names = {n.lower(): n for n in out}
    for table, n in (rows or {}).items():
        name = names.get(table.lower())
        if name is None:
            notes.append(f"rows of unknown table {table} left out")
            continue
        bound = min(x for x in (out[name].rows * MOST_TIMES, most_rows) if x is not None)
        if not 0 < n <= bound:
            notes.append(f"rows of {name}: {n} cut to {max(1, min(n, bound))}")
        out[name] = replace(out[name], rows=max(1, min(n, bound)))
    for o in asked:
        fault = _applied(out, names, o, schema)
        if fault:
            notes.append(f"{o.table}.{o.column} ({o.kind or 'nulls'}) left out: {fault}")
        else:
            used += 1
    notes.append(f"{used} of {len(asked)} proposals used")
    return out, notes


def _applied(out: dict[str, TablePlan], names: dict[str, str], o: Override, schema: Schema) -> str | None:
    name = names.get(o.table.lower())
    if name is None or not schema.has(name):
        return "unknown table"
    t = schema.table(name)
    if not t.has(o.column):
        return "unknown column"
    c = t.column(o.column)
    now = out[name].columns[c.name]
    if o.kind and now.kind in ("sequence", "fk"):
        return "keys stay as they are"
    args, alike = o.args or {}, {"date", "datetime"}
    if o.kind and (o.kind == now.kind or {o.kind, now.kind} <= alike):
        args = {**now.args, **args}
    elif o.kind and now.args.get("unique"):
        args = {**args, "unique": True}
    trial = Recipe(o.kind or now.kind, args if o.kind else now.args, now.null_ratio if o.null_ratio is None else o.null_ratio)
    try:
        faults = column_faults(schema, t, c, trial)
    except (TypeError, ValueError, KeyError, AttributeError) as e:
        return f"invalid parameters: {e}"
    if faults:
        return "; ".join(faults)
    tried = replace(out[name], columns={**out[name].columns, c.name: trial})
    if cycle := [f for f in plan_faults({**out, name: tried}, schema) if f.startswith(f"{t.name}:")]:
        return cycle[0]
    out[name] = tried
    return None
