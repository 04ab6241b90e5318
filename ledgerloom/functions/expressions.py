"""The expression language of derived columns and filters, compiled to Spark columns.

Expressions are written like Python's: arithmetic, comparisons (chained too), and/or/not, ``a if c else b``,
``x is None``, ``parent(fk).col`` and a few functions. A null operand of arithmetic voids the whole expression, unless
and/or/if never reaches it; and/or/not go by truth, so ``not None`` is true; comparisons with null are null.
Every node compiles to (value, void): void says whether the expression is voided there.
"""

from __future__ import annotations

import ast
import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TODAY = dt.date(2026, 8, 25)


class ExpressionError(ValueError):
    """The expression is outside the language or names something unknown."""


@dataclass(frozen=True)
class Compiled:
    source: str
    tree: ast.expr
    column_refs: tuple[str, ...]
    parent_refs: tuple[tuple[str, str], ...]
    uses_random: bool

    @property
    def dependencies(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.column_refs, *(fk for fk, _ in self.parent_refs))))


FUNCTIONS = {"coalesce": (1, 99), "min": (1, 99), "max": (1, 99), "abs": (1, 1), "round": (1, 2), "days_between": (2, 2), "randint": (2, 2), "random": (0, 0)}


def _parent_of(node: ast.AST) -> tuple[str, str] | None:
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id == "parent":
        args = node.value.args
        if len(args) == 1 and not node.value.keywords:
            if isinstance(args[0], ast.Name):
                return args[0].id, node.attr
            if isinstance(args[0], ast.Constant) and isinstance(args[0].value, str):
                return args[0].value, node.attr
        raise ExpressionError("parent() takes the name of one foreign key column")
    return None


def compile_expression(source: str) -> Compiled:
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(f"can't parse {source!r}: {e}") from e
    columns: list[str] = []
    parents: list[tuple[str, str]] = []
    random = False

    def walk(n: ast.AST) -> None:
        nonlocal random
        if ref := _parent_of(n):
            parents.append(ref)
        elif isinstance(n, ast.Name):
            if n.id != "TODAY":
                columns.append(n.id)
        elif isinstance(n, ast.Constant):
            if n.value is not None and not isinstance(n.value, (bool, int, float, str)):
                raise ExpressionError(f"constant {n.value!r} isn't allowed")
        elif isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)):
            walk(n.left), walk(n.right)
        elif isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.Not)):
            walk(n.operand)
        elif isinstance(n, ast.BoolOp):
            [walk(x) for x in n.values]
        elif isinstance(n, ast.IfExp):
            walk(n.test), walk(n.body), walk(n.orelse)
        elif isinstance(n, ast.Compare):
            if any(isinstance(o, (ast.In, ast.NotIn)) for o in n.ops):
                raise ExpressionError("'in' isn't supported")
            for o, x in zip(n.ops, n.comparators, strict=True):
                if isinstance(o, (ast.Is, ast.IsNot)) and not (isinstance(x, ast.Constant) and x.value is None):
                    raise ExpressionError("'is' only compares with None")
            walk(n.left)
            [walk(x) for x in n.comparators]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            low, high = FUNCTIONS[n.func.id]
            if not low <= len(n.args) <= high:
                raise ExpressionError(f"{n.func.id}() takes {low} to {high} arguments")
            random = random or n.func.id in ("randint", "random")
            [walk(x) for x in n.args]
        else:
            raise ExpressionError(f"{ast.unparse(n)!r} isn't allowed")

    walk(tree)
    return Compiled(source, tree, tuple(dict.fromkeys(columns)), tuple(dict.fromkeys(parents)), random)


def parse_parent_ref(text: str) -> tuple[str, str] | None:
    """(fk column, parent column) of ``parent(fk).col`` or ``fk.col``."""
    m = re.fullmatch(r"\s*(?:parent\(\s*['\"]?(\w+)['\"]?\s*\)|(\w+))\.(\w+)\s*", text)
    return (m[1] or m[2], m[3]) if m else None


def parent_column(fk: str, column: str) -> str:
    return f"__{fk.lower()}__{column.lower()}"


def attach_parents(df: DataFrame, refs, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join the parent columns that expressions need; parents: fk column -> (parent table, its key column)."""
    by_fk: dict[str, list[str]] = {}
    for fk, column in refs:
        by_fk.setdefault(fk.lower(), []).append(column)
    for fk, columns in by_fk.items():
        table, key = {k.lower(): v for k, v in parents.items()}.get(fk) or (None, None)
        if table is None:
            raise ExpressionError(f"{fk} isn't a foreign key")
        for c in columns:
            if c.lower() not in map(str.lower, table.columns):
                raise ExpressionError(f"the parent of {fk} has no column {c}")
        side = table.select(F.col(key).alias(f"__{fk}"), *[F.col(c).alias(parent_column(fk, c)) for c in dict.fromkeys(columns)]).dropDuplicates([f"__{fk}"])  # a row stays one where a parent key is repeated
        df = df.join(side, F.col(fk) == F.col(f"__{fk}"), "left").drop(f"__{fk}")
    return df


@dataclass
class _Node:
    value: Column
    void: Column
    kind: str  # number, text, date, bool, null
    exact: bool = False


@dataclass
class Compiler:
    """Turns a compiled expression into a column over a table with the parents' columns attached."""

    types: dict[str, T.DataType]
    uniform: Column | None = None
    today: dt.date = TODAY
    draws: int = field(default=0)

    def column(self, compiled: Compiled) -> Column:
        node = self._node(compiled.tree)
        return F.when(~node.void, node.value)

    def condition(self, compiled: Compiled) -> Column:
        """True where the expression is true; void and null are false."""
        node = self._node(compiled.tree)
        return F.coalesce(~node.void & self._truth(node), F.lit(False))

    def _kind(self, t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        return "bool" if isinstance(t, T.BooleanType) else "text"

    def _ref(self, name: str) -> _Node:
        t = self.types.get(name.lower())
        if t is None:
            raise ExpressionError(f"unknown column {name}")
        return _Node(F.col(name), F.lit(False), self._kind(t))

    def _truth(self, n: _Node) -> Column:
        if n.kind == "bool":
            t = n.value
        elif n.kind == "number":
            t = n.value != 0
        elif n.kind == "text":
            t = n.value != ""
        elif n.kind == "null":
            t = F.lit(False)
        else:
            t = n.value.isNotNull()
        return F.coalesce(t, F.lit(False))

    def _number(self, n: _Node) -> Column:
        if n.kind in ("text", "date"):
            raise ExpressionError("arithmetic needs numbers")
        return n.value.cast("double")

    def _node(self, n: ast.AST) -> _Node:
        no = F.lit(False)
        if ref := _parent_of(n):
            return self._ref(parent_column(*ref))
        if isinstance(n, ast.Name):
            return _Node(F.lit(self.today), no, "date") if n.id == "TODAY" else self._ref(n.id)
        if isinstance(n, ast.Constant):
            kind = "null" if n.value is None else "bool" if isinstance(n.value, bool) else "text" if isinstance(n.value, str) else "number"
            return _Node(F.lit(n.value), no, kind)
        if isinstance(n, ast.BinOp):
            a, b = self._node(n.left), self._node(n.right)
            x, y = self._number(a), self._number(b)
            divides = isinstance(n.op, (ast.Div, ast.FloorDiv, ast.Mod))
            quotient = F.try_divide(x, y)
            value = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: quotient, ast.FloorDiv: lambda: F.floor(quotient).cast("double"), ast.Mod: lambda: x - F.floor(quotient) * y}[type(n.op)]()
            void = a.void | b.void | x.isNull() | y.isNull()
            return _Node(value, void | F.coalesce(y == 0, F.lit(False)) if divides else void, "number")
        if isinstance(n, ast.UnaryOp):
            a = self._node(n.operand)
            if isinstance(n.op, ast.Not):
                return _Node(~self._truth(a), a.void, "bool")
            x = self._number(a)
            return _Node(-x, a.void | x.isNull(), "number")
        if isinstance(n, ast.BoolOp):
            nodes = [self._node(x) for x in n.values]
            stop = isinstance(n.op, ast.Or)
            kinds = {x.kind for x in nodes} - {"null"}
            kind = kinds.pop() if len(kinds) == 1 else "bool"
            # operands of one kind give the one that decides; without any that holds, "or" is false: 0, "" or no date
            as_value = {"number": lambda x: x.value.cast("double"), "bool": self._truth}.get(kind, lambda x: x.value)
            none_holds = {"number": F.lit(0.0), "bool": F.lit(False), "text": F.lit("")}.get(kind, F.lit(None))
            value, void = as_value(nodes[-1]), nodes[-1].void
            if stop:
                value = F.when(self._truth(nodes[-1]), value).otherwise(none_holds)
            for a in reversed(nodes[:-1]):  # what stops here hides what follows
                t = self._truth(a) if stop else ~self._truth(a)
                value = F.when(t, as_value(a)).otherwise(value)
                void = F.when(a.void, True).when(t, False).otherwise(void)
            return _Node(value, void, kind)
        if isinstance(n, ast.IfExp):
            c, a, b = self._node(n.test), self._node(n.body), self._node(n.orelse)
            kind = b.kind if a.kind == "null" else a.kind
            t = self._truth(c)
            as_kind = {"number": "double"}.get(kind)
            x, y = (v.value.cast(as_kind) if as_kind else v.value for v in (a, b))
            return _Node(F.when(t, x).otherwise(y), c.void | F.when(t, a.void).otherwise(b.void), kind)
        if isinstance(n, ast.Compare):
            return self._compare(n)
        return self._call(n)

    def _compare(self, n: ast.Compare) -> _Node:
        left, value, void = self._node(n.left), None, None
        for op, right_node in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.Is, ast.IsNot)):
                one, extra, right = (left.value.isNull() if isinstance(op, ast.Is) else left.value.isNotNull()), left.void, left
            else:
                right = self._node(right_node)
                one, extra = self._ordered(op, left, right), left.void | right.void
            value, void = (one, extra) if value is None else (value & one, void | extra)
            left = right
        return _Node(value, void, "bool")

    def _ordered(self, op: ast.cmpop, a: _Node, b: _Node) -> Column:
        x, y = a.value, b.value
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if "date" in (a.kind, b.kind):  # by day; ISO text counts as a date
            if {a.kind, b.kind} <= {"date", "text"}:
                x, y = (F.try_to_date(v.value) if v.kind == "text" else v.value.cast("date") for v in (a, b))
        elif a.kind == b.kind == "number" or {a.kind, b.kind} == {"number", "bool"}:
            x, y = x.cast("double"), y.cast("double")
        if a.kind != b.kind and not {a.kind, b.kind} <= {"date", "text"} and not {a.kind, b.kind} <= {"number", "bool"}:
            known = x.isNotNull() & y.isNotNull()
            if isinstance(op, ast.Eq):
                return F.when(known, False)
            return F.when(known, True) if isinstance(op, ast.NotEq) else F.lit(None).cast("boolean")
        return {ast.Eq: lambda: x == y, ast.NotEq: lambda: x != y, ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}[type(op)]()

    def _call(self, n: ast.Call) -> _Node:
        name = n.func.id
        args = [self._node(x) for x in n.args]
        void = F.lit(False)
        for a in args:
            void = void | a.void
        if name == "coalesce":
            kinds = [a.kind for a in args if a.kind != "null"] or ["null"]
            values = [a.value.cast("double") if kinds[0] == "number" else a.value for a in args]
            return _Node(F.coalesce(*values), void, kinds[0])
        if name in ("min", "max"):
            kind = args[0].kind
            values = [a.value.cast("double") if kind == "number" else a.value for a in args]
            some_null = F.lit(False)
            for v in values:
                some_null = some_null | v.isNull()
            best = values[0] if len(values) == 1 else (F.least if name == "min" else F.greatest)(*values)
            return _Node(F.when(~some_null, best), void, kind)
        if name == "days_between":
            return _Node(F.datediff(args[1].value.cast("date"), args[0].value.cast("date")).cast("double"), void, "number")
        if name in ("random", "randint"):
            if self.uniform is None:
                raise ExpressionError("no random numbers here")
            self.draws += 1
            u = (self.uniform + F.lit(self.draws * 0.6180339887498949)) % 1
            if name == "random":
                return _Node(u, void, "number")
            lo, hi = (self._number(a) for a in args)
            return _Node(F.when(hi < lo, lo).otherwise(lo + F.floor(u * (hi - lo + 1))), void, "number")
        x = self._number(args[0])
        if name == "abs":
            return _Node(F.abs(x), void, "number")
        try:
            digits = ast.literal_eval(n.args[1]) if len(n.args) > 1 else 0
        except ValueError as e:
            raise ExpressionError("the digits of round are a whole number") from e
        if not isinstance(digits, int):
            raise ExpressionError("the digits of round are a whole number")
        return _Node(F.bround(x, digits), void, "number")


def derive(df: DataFrame, source: str, parents: dict[str, tuple[DataFrame, str]] | None = None, uniform: Column | None = None, condition: bool = False, as_name: str = "derived") -> DataFrame:
    """df with the expression's value (or, for a condition, its truth) in one more column."""
    compiled = compile_expression(source)
    wide = attach_parents(df, compiled.parent_refs, parents or {})
    c = Compiler({f.name.lower(): f.dataType for f in wide.schema.fields}, uniform)
    wide = wide.withColumn(as_name, c.condition(compiled) if condition else c.column(compiled))
    return wide.select(*[x for x in df.columns if x != as_name], as_name)
