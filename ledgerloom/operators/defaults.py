"""Recipes for the columns of a schema where nothing else is said: keys and constraints first, then one table of rules.

A rule is a pattern of column names, the types that it is for, and what it makes; the first that fits is taken.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from ..functions.expressions import TODAY
from ..plans.schema import INTEGERS, NUMERIC, TEMPORAL, TEXTUAL, Column, Schema, Table
from .recipes import LEXICON, Recipe
from .validate import check_bounds

#: Share of nulls in nullable columns: of references, of times at which something ends, of free text, of all others.
NULLS_REFERENCE, NULLS_END, NULLS_TEXT, NULLS_ELSE = 0.1, 0.25, 0.2, 0.05
BEGINS = re.compile(r"begin|start|open|creat|join|hire|order|issued|loan|since|birth|born", re.I)
ENDS = re.compile(r"end|clos|due|return|deliver|paid|leav|left|terminat|expir|death|died", re.I)
AMOUNT = re.compile(r"(sub|line|item|row)_?(total|amount)|subtotal", re.I)
TOTAL = re.compile(r"(^|_)(grand_?)?total(_amount)?$|order_total", re.I)
COUNT, PRICE = re.compile(r"quantity|qty|units|pieces", re.I), re.compile(r"price|rate|fee", re.I)
#: A window of five years, and the most days between a beginning and its end.
FIRST_DAY, LONGEST = dt.date(TODAY.year - 5, 1, 1), 120


def _between(lo: float, hi: float, distribution: str = "uniform") -> Callable[[Column], Recipe]:
    def make(c: Column) -> Recipe:
        whole = c.type in INTEGERS
        top = hi if c.type != "DECIMAL" else min(hi, 10 ** (c.precision - c.scale) - 1)
        return Recipe("int_range" if whole else "decimal_range", {"lo": int(min(lo, top)) if whole else min(lo, top), "hi": int(top) if whole else top, "distribution": distribution})

    return make


def _words(name: str) -> Callable[[Column], Recipe]:
    return lambda c: Recipe("pool", {"values": LEXICON[name]})


def _pattern(template: str) -> Callable[[Column], Recipe]:
    return lambda c: Recipe("pattern", {"template": template})


RULES: tuple[tuple[str, tuple[str, ...], Callable[[Column], Recipe]], ...] = (
    (r"quantity|qty|units|pieces|stock|copies|seats", NUMERIC, _between(1, 25, "skewed_low")),
    (r"year", INTEGERS, _between(1980, TODAY.year)),
    (r"(^|_)age($|_)", INTEGERS, _between(16, 99, "normal")),
    (r"percent|share|ratio|discount", NUMERIC, _between(0, 100)),
    (r"rating|score|stars|grade", NUMERIC, _between(0, 5, "skewed_high")),
    (r"salary|income|budget|revenue", NUMERIC, _between(20_000, 250_000, "skewed_low")),
    (r"price|rate|fee|fine|cost", NUMERIC, _between(1, 250, "skewed_low")),
    (r"amount|total|balance|value", NUMERIC, _between(1, 5_000, "skewed_low")),
    (r"hours|minutes|days|pages|length|weight|size", NUMERIC, _between(1, 480)),
    (r"", NUMERIC, _between(0, 999)),
    (r"first_?name|given|middle", TEXTUAL, _words("first_name")),
    (r"last_?name|surname|family", TEXTUAL, _words("last_name")),
    (r"city|town|place|location|state", TEXTUAL, _words("city")),
    (r"mail", TEXTUAL, _pattern("{faker:word}.{seq}@mail.example")),
    (r"phone|mobile|fax", TEXTUAL, _pattern("+%# %## ######")),
    (r"zip|postal|postcode", TEXTUAL, _pattern("%####")),
    (r"isbn|ean|barcode|serial", TEXTUAL, _pattern("%###########")),
    (r"licen[cs]e|plate|sku|code", TEXTUAL, _pattern("??%###")),
    (r"street|address", TEXTUAL, _pattern("{faker:last_name} Lane %#")),
    (r"url|site|link", TEXTUAL, _pattern("https://{faker:word}.example/{seq}")),
    (r"", TEXTUAL, _pattern("{faker:word} {faker:word}")),
)


def nulls(t: Table, c: Column) -> float:
    if not c.nullable or c.name in t.primary_key:
        return 0.0
    if any(c.name in fk.columns for fk in t.foreign_keys):
        return NULLS_REFERENCE
    if c.type in TEMPORAL and ENDS.search(c.name):
        return NULLS_END
    return NULLS_TEXT if c.type == "TEXT" else NULLS_ELSE


def _computed(schema: Schema, t: Table, c: Column) -> Recipe | None:
    """An amount of a row with a count and a parent with a price; a total of children with such amounts."""
    if AMOUNT.search(c.name) and (count := next((x.name for x in t.columns if COUNT.search(x.name) and x.type in NUMERIC), None)):
        for fk in t.foreign_keys:
            price = next((x.name for x in schema.table(fk.parent).columns if PRICE.search(x.name) and x.type in NUMERIC), None)
            if price and len(fk.columns) == 1:
                return Recipe("derived", {"expression": f"{count} * parent({fk.columns[0]}).{price}"})
    if TOTAL.search(c.name):
        for child, fk in schema.references_to(t.name):
            part = next((x.name for x in child.columns if AMOUNT.search(x.name) and x.type in NUMERIC), None)
            if part and child.name != t.name and len(fk.columns) == 1:
                return Recipe("aggregate", {"child": child.name, "fk": fk.columns[0], "column": part, "agg": "sum", "default": 0})
    return None


def _temporal(t: Table, c: Column) -> Recipe:
    kind, window = "date" if c.type == "DATE" else "datetime", {"start": FIRST_DAY, "end": TODAY}
    before = [x.name for x in t.columns[: t.names.index(c.name)] if x.type in TEMPORAL and BEGINS.search(x.name)]
    if ENDS.search(c.name) and before:
        return Recipe(kind, {"start": FIRST_DAY, "end": TODAY + dt.timedelta(days=LONGEST), "after": before[-1], "min": 1, "max": LONGEST})
    if re.search("birth|born", c.name, re.I):
        window = {"start": dt.date(TODAY.year - 80, 1, 1), "end": dt.date(TODAY.year - 18, 12, 31)}
    return Recipe(kind, window)


def default_recipe(schema: Schema, t: Table, c: Column) -> Recipe:
    """The recipe of one column. Unique columns have it too: what they draw twice is repaired (unique.py)."""
    share = nulls(t, c)
    for fk in t.foreign_keys:
        if c.name in fk.columns:
            return Recipe("fk", {"parent": fk.parent, "column": fk.parent_columns[fk.columns.index(c.name)], "distribution": "zipf"}, share)
    if t.primary_key == (c.name,) and c.type in INTEGERS:
        return Recipe("sequence", {"start": 1})
    if c.type == "ENUM":
        return Recipe("enum", {"values": list(c.values), "weights": [1 / (i + 1) for i in range(len(c.values))]}, share)
    if c.type == "BOOLEAN":
        return Recipe("boolean", {"ratio": 0.7 if re.search("active|enabled|available", c.name, re.I) else 0.5}, share)
    if made := _computed(schema, t, c):
        return made
    if c.type in TEMPORAL:
        made = _temporal(t, c)
        return Recipe(made.kind, made.args, share)
    lo, hi, allowed = next((b for k in t.checks for b in [check_bounds(k, c.name)] if any(x is not None for x in b)), (None, None, None))
    if allowed and c.type in TEXTUAL:
        return Recipe("enum", {"values": allowed}, share)
    if c.type in NUMERIC and (lo is not None or hi is not None):
        lo = hi - 100 if lo is None else lo
        made = _between(lo, lo + 100 if hi is None else hi)(c)
    elif c.type in TEXTUAL and re.search("mail", c.name, re.I) and t.has("first_name") and t.has("last_name"):
        made = Recipe("pattern", {"template": "{col:first_name|slug}.{col:last_name|slug}@mail.example"})
    else:
        made = next(make(c) for words, types, make in RULES if c.type in types and re.search(words, c.name, re.I))
    return Recipe(made.kind, made.args, share)
