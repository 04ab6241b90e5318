"""Relations that tables must satisfy: derived columns, child aggregates, events in order; and their recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import attach_parents, compile_expression, derive, parent_column, parse_parent_ref

TOLERANCE = 0.011
AGGREGATES = ("sum", "count", "min", "max", "avg")


def same(a: Column, b: Column, kind: T.DataType) -> Column:
    """Numbers within the tolerance, dates by day, null equal to null."""
    if isinstance(kind, T.NumericType):
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a.cast("double") - b.cast("double")) <= TOLERANCE)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(a).eqNullSafe(F.to_date(b))
    return a.eqNullSafe(b)


def child_aggregate(parent: DataFrame, key: str, child: DataFrame, fk: str, column: str | None, agg: str, default=0, as_name: str = "recomputed") -> DataFrame:
    """parent with the aggregate of its children's values; null keys and values are skipped, count counts rows.

    Parents without children have the default. Children are summed before they meet their parents.
    """
    value = F.lit(1) if agg == "count" else F.col(column).cast("double")
    function = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[agg]
    grouped = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__key")).agg(function(value).alias(as_name))
    out = parent.drop(as_name).join(grouped, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(as_name, F.coalesce(F.col(as_name), F.lit(default).cast("long" if agg == "count" else "double")))


def derived_mismatches(df: DataFrame, column: str, expression: str, parents: dict | None = None) -> DataFrame:
    """Rows whose stored value isn't the expression's."""
    out = derive(df, expression, parents, as_name="__derived")
    return out.where(~same(F.col(column), F.col("__derived"), df.schema[column].dataType)).withColumnRenamed("__derived", "recomputed")


def aggregate_mismatches(parent: DataFrame, key: str, column: str, child: DataFrame, fk: str, child_column: str | None, agg: str, default=0) -> DataFrame:
    out = child_aggregate(parent, key, child, fk, child_column, agg, default)
    return out.where(~same(F.col(column), F.col("recomputed"), T.DoubleType()))


def order_violations(df: DataFrame, column: str, after: Column, min_days: int = 0, window_end: Column | None = None) -> DataFrame:
    """Rows where column is before ``after`` plus a gap; values clamped to the end of their window are accepted."""
    late = F.col(column).cast("timestamp") < after.cast("timestamp") + F.expr(f"INTERVAL {min_days} DAYS")
    if window_end is not None:
        late = late & (F.col(column).cast("timestamp") < window_end.cast("timestamp"))
    return df.where(late)


def check(schema, plans: dict, tables: dict[str, DataFrame]) -> DataFrame | None:
    """(table, column, rule, violations) of all relations that the recipes of a plan set up: derived columns, aggregates
    of children, and dates after another column or a parent's; zero ones too. Tables that aren't given are left out.
    Expressions that draw random numbers can't be checked."""
    given, out = {k.lower(): v for k, v in tables.items()}, None
    for t in schema.tables:
        df, p = given.get(t.name.lower()), plans.get(t.name)
        if df is None or p is None:
            continue
        parents = {fk.columns[0]: (given[fk.parent.lower()], fk.parent_columns[0]) for fk in t.foreign_keys if len(fk.columns) == 1 and fk.parent.lower() in given}
        for c in t.columns:
            r = p.columns[c.name]
            a, rule, bad = r.args, r.kind, None
            if r.kind == "derived" and not compile_expression(a["expression"]).uses_random:
                bad = derived_mismatches(df, c.name, a["expression"], parents)
            elif r.kind == "aggregate" and a["child"].lower() in given:
                bad = aggregate_mismatches(df, t.primary_key[0], c.name, given[a["child"].lower()], a["fk"], a.get("column"), a["agg"], a.get("default", 0))
            elif r.kind in ("date", "datetime") and a.get("after"):
                ref, rule = parse_parent_ref(a["after"]), "after"
                both = attach_parents(df, [ref], parents) if ref else df
                bad = order_violations(both, c.name, F.col(parent_column(*ref) if ref else a["after"]).cast("date"), a.get("min", 0), F.lit(a["end"]))
            if bad is not None:
                one = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(t.name).alias("table"), F.lit(c.name).alias("column"), F.lit(rule).alias("rule"), "violations")
                out = one if out is None else out.unionByName(one)
    return out


def recompute_derived(df: DataFrame, recipes: dict[str, str], parents: dict | None = None) -> DataFrame:
    """df with its derived columns computed again, in the given order; types stay."""
    for column, expression in recipes.items():
        kind, order = df.schema[column].dataType, df.columns
        df = derive(df, expression, parents, as_name="__new").withColumn(column, F.col("__new").cast(kind)).select(*order)
    return df
