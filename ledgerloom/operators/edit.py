"""Edits over a data set: set, regenerate, insert, delete with cascades, pool updates. The input tables never change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Compiler, attach_parents, compile_expression
from ..plans.schema import ForeignKey, Schema, Table, table_order
from .consistency import child_aggregate, recompute_derived
from .generate import Recipe, column_order, conform, uniform, value
from .unique import cut, suffix_unique
from .validate import Report, validate


class EditError(ValueError):
    """The edit plan doesn't fit the schema."""


@dataclass(frozen=True)
class Op:
    """op: set_values, regenerate_column, add_rows, delete_rows or update_pool; args as each needs."""

    op: str
    args: dict = field(default_factory=dict)


def _parents(schema: Schema, tables: dict[str, DataFrame], t: Table) -> dict:
    return {fk.columns[0]: (tables[fk.parent], fk.parent_columns[0]) for fk in t.foreign_keys if len(fk.columns) == 1}


def with_condition(df: DataFrame, where: str | None, schema: Schema, tables: dict[str, DataFrame], t: Table, as_name: str = "__hit") -> DataFrame:
    """df with a column that says which rows a filter matches; a blank filter matches all, null matches none."""
    if not where or not where.strip():
        return df.withColumn(as_name, F.lit(True))
    compiled = compile_expression(where)
    for c in compiled.column_refs:
        if not t.has(c):
            raise EditError(f"{t.name} has no column {c}")
    wide = attach_parents(df, compiled.parent_refs, _parents(schema, tables, t))
    hit = Compiler({f.name.lower(): f.dataType for f in wide.schema.fields}).condition(compiled)
    return wide.withColumn(as_name, hit).select(*df.columns, as_name)


def check_ops(schema: Schema, table: str, ops: list[Op]) -> None:
    """All operations are checked before any is applied."""
    if not schema.has(table):
        raise EditError(f"no table {table}")
    t = schema.table(table)
    for o in ops:
        a = o.args
        if o.op not in ("set_values", "regenerate_column", "add_rows", "delete_rows", "update_pool"):
            raise EditError(f"unknown operation {o.op}")
        if o.op in ("set_values", "regenerate_column", "update_pool"):
            if not t.has(a.get("column", "")):
                raise EditError(f"{t.name} has no column {a.get('column')}")
            c = t.column(a["column"])
            if c.name in t.primary_key:
                raise EditError(f"{c.name} is a primary key")
            if o.op == "regenerate_column" and any(c.name in fk.columns for fk in t.foreign_keys):
                raise EditError(f"{c.name} is a foreign key")
            if o.op == "set_values" and "recipe" not in a:
                if a.get("value") is None and not c.nullable:
                    raise EditError(f"{c.name} can't be null")
                if c.values and a.get("value") is not None and a["value"] not in c.values:
                    raise EditError(f"{a['value']!r} isn't a value of {c.name}")
        if o.op == "update_pool" and not a.get("values"):
            raise EditError("an empty pool")
        if o.op == "add_rows" and not 1 <= a.get("count", 0) <= 5000:
            raise EditError("count must be 1 to 5000")
        if a.get("where"):
            compile_expression(a["where"])


def set_values(df: DataFrame, hit: Col, column: str, new: Col) -> DataFrame:
    return df.withColumn(column, F.when(hit, new.cast(df.schema[column].dataType)).otherwise(F.col(column)))


def update_pool(df: DataFrame, hit: Col, column: str, values: list[str], u: Col) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
    return set_values(df, hit, column, pick)


def add_rows(df: DataFrame, t: Table, count: int, plan: dict[str, Recipe], seed: int, tables: dict[str, DataFrame]) -> DataFrame:
    """df and new rows: the key continues from its largest, foreign keys sample existing parents."""
    from .generate import sample_parent

    key = t.primary_key[0]
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    new = df.sparkSession.range(1, count + 1).withColumnRenamed("id", "__row")
    for fk in t.foreign_keys:
        new = sample_parent(new, tables[fk.parent], list(fk.columns), list(fk.parent_columns), uniform(seed, t.name, fk.columns[0], F.col("__row"), 31))
    for c in t.columns:
        if any(c.name in fk.columns for fk in t.foreign_keys):
            continue
        r = plan.get(c.name, Recipe("constant", {"value": None}))
        made = F.lit(top) + F.col("__row") if c.name == key else value(r, seed, t.name, c, F.col("__row"), 31) if r.kind not in ("derived", "aggregate") else F.lit(None)
        new = new.withColumn(c.name, conform(made, c))
    return df.unionByName(new.select(*[F.col(n).cast(df.schema[n].dataType).alias(n) for n in df.columns]))


def delete_rows(schema: Schema, tables: dict[str, DataFrame], table: str, hits: DataFrame, cascade: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables after the delete, removed rows by table). Children with a nullable key lose it, others go with their
    parent, to a fixpoint where tables refer to each other; without cascade such children are an error."""
    def matched(child: Table, fk: ForeignKey, gone: DataFrame, how: str) -> DataFrame:
        on = F.lit(True)
        for i, c in enumerate(fk.columns):
            on &= F.col(c) == F.col(f"__p{i}")
        return out[child.name].join(gone, on, how)

    out, removed = dict(tables), {table: hits}
    key = list(schema.table(table).primary_key) or tables[table].columns
    out[table] = out[table].join(hits.select(*key).distinct(), key, "left_anti").select(*tables[table].columns)
    waiting = [(table, hits)]
    rounds = 0
    while waiting:
        (name, rows), rounds = waiting.pop(0), rounds + 1
        if rounds > 100:
            raise EditError("the cascade doesn't end")
        for child, fk in schema.references_to(name):
            gone = rows.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent_columns)]).distinct()
            columns = tables[child.name].columns
            if child.nullable_key(fk):
                marked = matched(child, fk, gone.withColumn("__gone", F.lit(True)), "left")
                out[child.name] = marked.withColumns({c: F.when(F.col("__gone").isNull(), F.col(c)) for c in fk.columns}).select(*columns)
                continue
            # rows go by their foreign key: their own key may be repeated
            lost = matched(child, fk, gone, "left_semi").persist()  # read by the rounds that follow
            if lost.isEmpty():
                continue
            if not cascade:
                raise EditError(f"rows of {child.name} refer to rows that go")
            out[child.name] = matched(child, fk, gone, "left_anti").select(*columns)
            removed[child.name] = lost if child.name not in removed else removed[child.name].unionByName(lost)
            waiting.append((child.name, lost))
    return out, removed


def _derived_columns(t: Table, plan: dict[str, Recipe], of_aggregates: bool) -> dict[str, str]:
    """Expressions of the derived columns of a plan in order; or only of those that need an aggregate of their row."""
    made = {n for n, r in plan.items() if r.kind == "aggregate"}
    todo: dict[str, str] = {}
    for c in column_order(t, {n: plan.get(n, Recipe("constant", {"value": None})) for n in t.names}):
        if c.name in plan and plan[c.name].kind == "derived":
            compiled = compile_expression(plan[c.name].args["expression"])
            needs = {t.column(x).name for x in compiled.dependencies if t.has(x)} & (made | (set(todo) if of_aggregates else set()))
            if not compiled.uses_random and (needs or not of_aggregates):
                todo[c.name] = compiled.source
    return todo


def refresh(schema: Schema, tables: dict[str, DataFrame], plans: dict[str, dict[str, Recipe]]) -> dict[str, DataFrame]:
    """tables with the derived columns and the aggregates of children of their plans computed again.

    Derived columns come first, parents before children, then aggregates, children before parents, then derived columns
    that need an aggregate of their row. Expressions that draw random numbers keep their values.
    """
    out = dict(tables)
    names = [n for n in table_order(schema).tables if n in plans]

    def derived(name: str, of_aggregates: bool) -> None:
        t, todo = schema.table(name), _derived_columns(schema.table(name), plans[name], of_aggregates)
        if todo:
            out[name] = recompute_derived(out[name], todo, _parents(schema, out, t))

    for name in names:
        derived(name, False)
    for name in reversed(names):
        t = schema.table(name)
        for c in t.columns:
            r = plans[name].get(c.name)
            if r is not None and r.kind == "aggregate":
                a = r.args
                wide = child_aggregate(out[name], t.primary_key[0], out[a["child"]], a["fk"], a["column"], a["agg"], a.get("default", 0), "__agg")
                out[name] = wide.withColumn(c.name, conform(F.col("__agg"), c)).select(*out[name].columns)
    for name in names:
        derived(name, True)
    return out


class Touched:
    """Rows that an edit changes, old and new versions, by table: their keys and foreign keys; None is a whole table.

    The keys are checkpointed, so that plans don't grow with the number of tables they pass.
    """

    def __init__(self, schema: Schema):
        self.schema, self.rows = schema, {}

    def add(self, name: str, rows: DataFrame | None) -> None:
        t = self.schema.table(name)
        if rows is None or not t.primary_key or self.rows.get(name, rows) is None:
            self.rows[name] = None
            return
        referred = [p for _, fk in self.schema.references_to(name) for p in fk.parent_columns]
        kept = list(dict.fromkeys([*t.primary_key, *(c for fk in t.foreign_keys for c in fk.columns), *referred]))
        rows = rows.select(*kept)
        if name in self.rows:
            rows = rows.union(self.rows[name].select(*kept))
        self.rows[name] = cut(rows.distinct())

    def keys(self, name: str, columns: list[str], names: list[str]) -> DataFrame | None:
        """Distinct values of columns of the touched rows of a table; None if the whole table is touched."""
        rows = self.rows[name]
        return None if rows is None else rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).distinct()


def refresh_touched(schema: Schema, tables: dict[str, DataFrame], plans: dict[str, dict[str, Recipe]], touched: Touched) -> dict[str, DataFrame]:
    """As refresh, for tables that held their plans' relations before the edit: only touched rows, children whose
    expressions look at a touched parent, and parents of touched children are computed again.

    Rows to compute come by a semi join on their keys, the others stay as they are, as do tables without such rows.
    Tables without a primary key are computed whole. Rows with a null key stay.
    """
    out = dict(tables)
    names = [n for n in table_order(schema).tables if n in plans]

    def renew(name: str, keys: list[DataFrame | None], compute) -> None:
        if not keys:
            return
        key = list(schema.table(name).primary_key)
        if not key or any(k is None for k in keys):
            out[name] = compute(out[name], None)
            touched.add(name, None)
            return
        wanted = keys[0]
        for k in keys[1:]:
            wanted = wanted.union(k)
        wanted = cut(wanted.distinct())
        columns = out[name].columns
        done = compute(out[name].join(wanted, key, "left_semi"), wanted).select(*columns)
        touched.add(name, done)
        out[name] = done.unionByName(out[name].join(wanted, key, "left_anti").select(*columns))

    def derived(name: str, of_aggregates: bool) -> None:
        t, todo = schema.table(name), _derived_columns(schema.table(name), plans[name], of_aggregates)
        if not todo:
            return
        key, keys = list(t.primary_key), []
        if name in touched.rows:
            keys.append(touched.keys(name, key, key))
        looks_at = {t.column(via).name for e in todo.values() for via, _ in compile_expression(e).parent_refs}
        for fk in t.foreign_keys:
            if len(fk.columns) == 1 and fk.columns[0] in looks_at and fk.parent in touched.rows:
                changed = touched.keys(fk.parent, list(fk.parent_columns), list(fk.columns))
                keys.append(None if changed is None else out[name].join(changed, list(fk.columns), "left_semi").select(*key))
        renew(name, keys, lambda rows, _: recompute_derived(rows, todo, _parents(schema, out, t)))

    for name in names:
        derived(name, False)
    for name in reversed(names):
        t = schema.table(name)
        for c in t.columns:
            r = plans[name].get(c.name)
            if r is None or r.kind != "aggregate":
                continue
            a, key = r.args, t.primary_key[0]
            keys = [touched.keys(x, [y], [key]) for x, y in ((a["child"], a["fk"]), (name, key)) if x in touched.rows]

            def total(rows: DataFrame, wanted: DataFrame | None, a=a, key=key, c=c) -> DataFrame:
                children = out[a["child"]]
                if wanted is not None:
                    children = children.join(wanted.withColumnRenamed(key, a["fk"]), a["fk"], "left_semi")
                wide = child_aggregate(rows, key, children, a["fk"], a["column"], a["agg"], a.get("default", 0), "__agg")
                return wide.withColumn(c.name, conform(F.col("__agg"), c)).select(*rows.columns)

            renew(name, keys, total)
    for name in names:
        derived(name, True)
    return out


def apply(schema: Schema, tables: dict[str, DataFrame], table: str, ops: list[Op], plan: dict[str, Recipe] | None = None, seed: int = 0, plans: dict[str, dict[str, Recipe]] | None = None, delta: bool = False) -> tuple[dict[str, DataFrame], Report]:
    """New tables and their validation. With the plans of the tables, their derived columns and aggregates follow the
    edit (refresh), new rows and those of other tables included; without, they keep their values. With delta, only what
    the edit touches is computed again (refresh_touched): for tables that held their plans' relations before."""
    check_ops(schema, table, ops)
    t = schema.table(table)
    out = dict(tables)
    touched = Touched(schema)
    follow = bool(plans) and delta
    for k, o in enumerate(ops):
        a, own = o.args, seed * 1000 + k
        df = out[t.name]
        row = F.col(t.primary_key[0]) if t.primary_key else F.xxhash64(*df.columns)
        if o.op == "add_rows":
            out[t.name] = add_rows(df, t, a["count"], {**((plans or {}).get(t.name, {})), **(plan or {}), **a.get("recipes", {})}, own, out)
            if follow:
                touched.add(t.name, out[t.name].join(df, t.primary_key[0], "left_anti") if len(t.primary_key) == 1 else None)
            continue
        hit = with_condition(df, a.get("where"), schema, out, t)
        if o.op == "delete_rows":
            before = out
            out, removed = delete_rows(schema, out, t.name, hit.where("__hit").drop("__hit"), a.get("cascade", True))
            for name in out if follow else ():
                if name in removed:
                    touched.add(name, removed[name])
                elif out[name] is not before[name]:  # lost a foreign key
                    touched.add(name, None)
            continue
        c = t.column(a["column"])
        if o.op == "update_pool":
            done = update_pool(hit, F.col("__hit"), c.name, a["values"], uniform(own, t.name, c.name, row))
        else:
            recipe = a.get("recipe")
            new = value(recipe, own, t.name, c, row) if recipe is not None else F.lit(a.get("value"))
            done = set_values(hit, F.col("__hit"), c.name, conform(new, c))
        unique = any(u == (c.name,) for u in t.keys)
        if follow:  # suffixes may meet any row
            touched.add(t.name, None if unique else hit.where("__hit").drop("__hit").unionByName(done.where("__hit").drop("__hit")))
        done = done.drop("__hit")
        if unique:
            done = suffix_unique(done, c.name, t.primary_key[0], c.max_length)
        out[t.name] = done
    if plans:
        out = refresh_touched(schema, out, plans, touched) if delta else refresh(schema, out, plans)
    return out, validate(schema, out)
