"""Guarded SQL: one read-only statement over the tables of a data set, with a row cap and a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession


class SqlRejected(ValueError):
    """The statement isn't allowed."""


class SqlError(RuntimeError):
    """The statement failed."""

    def __init__(self, message: str, hint: str = "", sqlstate: str | None = None):
        super().__init__(message)
        self.hint, self.sqlstate = hint, sqlstate


#: Functions that run code, read files or show the session; fixed values.
DENIED_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "current_catalog",
    "current_database", "current_schema", "version", "spark_partition_id", "monotonically_increasing_id", "sql", "raise_error", "set_config", "pg_sleep", "nextval",
    "pg_read_file", "lo_import", "lo_export", "dblink", "setval", "pg_terminate_backend", "pg_cancel_backend", "read_files",
}
ROOTS = {"Project", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "UnresolvedWith", "Aggregate", "Filter", "Intersect", "Except", "UnresolvedHaving", "Offset", "WithWindowDefinition", "UnresolvedHint", "SubqueryAlias"}
#: Their expressions in the analysed plan, where keyword forms without parentheses are plain too; fixed values.
DENIED_EXPRESSIONS = {"CurrentUser", "CurrentCatalog", "CurrentDatabase", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CallMethodViaReflection", "SparkVersion", "SparkPartitionID", "MonotonicallyIncreasingID"}
#: Functions that may stand for a table.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: What a SELECT may be parsed into; any other node, IDENTIFIER() among them, is refused.
NODES = ROOTS | {"UnresolvedRelation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "Join", "AsOfJoin", "LateralJoin", "Generate", "Window", "Sample", "Pivot", "Unpivot"}
MOST_ROWS, TIMEOUT_MS = 500, 15_000


@dataclass(frozen=True)
class GuardedSql:
    sql: str
    tables: tuple[str, ...]
    limit: int


@dataclass(frozen=True)
class QueryResult:
    columns: tuple[str, ...]
    rows: list[tuple]
    truncated: bool
    elapsed_ms: float
    sql: str

    def records(self) -> list[dict]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows]


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _walk(plan, seen: dict, scope: frozenset[str]) -> None:
    """Note nodes, functions and relations; scope has the names of the WITH clauses around."""
    name = plan.nodeName()
    seen["nodes"].add(name)
    if name == "UnresolvedRelation":
        parts = tuple(_seq(plan.multipartIdentifier()))
        seen["relations"].append((parts, len(parts) == 1 and parts[0].lower() in scope))
    elif name == "UnresolvedTableValuedFunction":
        seen["functions"].add(_seq(plan.name())[-1].lower())
        seen["table functions"].add(_seq(plan.name())[-1].lower())
    elif name == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            own = pair._1().lower()
            _walk(pair._2(), seen, scope | {own} if plan.allowRecursion() else scope)
            scope |= {own}
        for child in _seq(plan.children()):
            _walk(child, seen, scope)
        return
    for e in _seq(plan.expressions()):
        _walk_expression(e, seen, scope)
    for child in (*_seq(plan.children()), *_seq(plan.innerChildren())):
        if hasattr(child, "nodeName") and child.getClass().getName().startswith("org.apache.spark.sql.catalyst"):
            _walk(child, seen, scope)


def _walk_expression(e, seen: dict, scope: frozenset[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind in ("UnresolvedFunction",):
        seen["functions"].add(_seq(e.nameParts())[-1].lower())
    elif kind == "UnresolvedGenerator":
        seen["functions"].add(e.name().funcName().lower())
    elif "UnresolvedIdentifier" in kind:
        seen["nodes"].add("IDENTIFIER")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedTableArgPlanId", "FunctionTableSubqueryArgumentExpression") and hasattr(e, "plan") and kind != "InSubquery":
        _walk(e.plan(), seen, scope)
    for child in _seq(e.children()):
        _walk_expression(child, seen, scope)


def guard(spark: SparkSession, sql: str, *, limit: int = MOST_ROWS, tables: set[str] | None = None) -> GuardedSql:
    """Accept a single SELECT or set operation (with CTEs) that names only the data set's tables."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise SqlRejected("exactly one statement is expected")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as e:
        raise SqlRejected(f"exactly one SELECT is expected: {str(e).strip().splitlines()[0]}") from e
    seen: dict = {"nodes": set(), "functions": set(), "table functions": set(), "relations": []}
    if plan.nodeName() not in ROOTS:
        raise SqlRejected(f"only SELECT and set operations are allowed, not {plan.nodeName()}")
    _walk(plan, seen, frozenset())
    if bad := seen["nodes"] - NODES:
        raise SqlRejected(f"not allowed: {', '.join(sorted(bad))}")
    if bad := seen["functions"] & DENIED_FUNCTIONS:
        raise SqlRejected(f"function not allowed: {', '.join(sorted(bad))}")
    if bad := seen["table functions"] - TABLE_FUNCTIONS:
        raise SqlRejected(f"table function not allowed: {', '.join(sorted(bad))}")
    if bad := [r for r, _ in seen["relations"] if len(r) > 1]:
        raise SqlRejected(f"only plain table names are allowed, not {'.'.join(bad[0])}")
    names = sorted({r[0].lower() for r, _ in seen["relations"]})
    own = sorted({r[0].lower() for r, with_clause in seen["relations"] if not with_clause})
    if tables is not None and (bad := [n for n in own if n not in {t.lower() for t in tables}]):
        raise SqlRejected(f"unknown table {bad[0]}")
    return GuardedSql(text, tuple(names), limit)


def _refuse_analysed(df: DataFrame) -> None:
    """No expression of the analysed plan shows the session, the files or the partitions."""

    def walk(plan) -> None:
        for e in _seq(plan.expressions()):
            look(e)
        for child in (*_seq(plan.children()), *_seq(plan.innerChildren())):
            if hasattr(child, "expressions") and hasattr(child, "nodeName"):
                walk(child)

    def look(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind in DENIED_EXPRESSIONS:
            raise SqlRejected(f"not allowed: {kind}")
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            walk(e.plan())
        for child in _seq(e.children()):
            look(child)

    walk(df._jdf.queryExecution().analyzed())


def guarded_frame(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The guarded statement as a DataFrame over the given tables, capped if a limit is given.

    The tables have their names only while the statement is analysed; a view of such a name has it again afterwards."""
    checked = guard(spark, sql, tables=set(tables))
    mine = {name.lower(): df for name, df in tables.items() if name.lower() in checked.tables}
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in mine if name in views}
    try:
        for name, df in mine.items():
            df.createOrReplaceTempView(name)
        out = spark.sql(checked.sql)
        _refuse_analysed(out)
    finally:
        for name in mine:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
    return out if limit is None else out.limit(limit)


def run_readonly(spark: SparkSession, sql: str, tables: dict[str, DataFrame], *, limit: int = MOST_ROWS, timeout_ms: int = TIMEOUT_MS) -> QueryResult:
    """Run a guarded statement: at most ``limit`` rows, with a flag for more, cancelled after the time limit."""
    began = time.time()
    group = uuid.uuid4().hex
    sc = spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout_ms / 1000, stop)
    sc.setJobGroup(group, "guarded SQL", True)
    timer.start()
    try:
        df = guarded_frame(spark, sql, tables)
        rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    except SqlRejected:
        raise
    except AnalysisException as e:
        raise SqlError(str(e).splitlines()[0], "check the table and column names", e.getSqlState()) from e
    except (PySparkException, Py4JJavaError) as e:
        if late.is_set():
            raise SqlError(f"the query took more than {timeout_ms} ms", "aggregate or filter more", "57014") from e
        state = e.getSqlState() if isinstance(e, PySparkException) else None
        raise SqlError(str(e).splitlines()[0], "", state) from e
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return QueryResult(tuple(df.columns), rows[:limit], len(rows) > limit, (time.time() - began) * 1000, sql)


@dataclass
class Tools:
    """run_sql and render_chart by name, with errors as results; charts use the last rows."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    last: QueryResult | None = None
    calls: list[str] = field(default_factory=list)

    def dispatch(self, name: str, args: dict) -> dict:
        from ..operators.charts import ChartSpec, ChartSpecError, series

        self.calls.append(name)
        try:
            if name == "run_sql":
                self.last = run_readonly(self.spark, args["sql"], self.tables)
                return {"columns": list(self.last.columns), "rows": [list(map(_plain, r)) for r in self.last.rows[:40]], "row_count": len(self.last.rows), "truncated": self.last.truncated}
            if name == "render_chart":
                if self.last is None:
                    return {"error": "run a query first"}
                spec = ChartSpec(**args)
                return {"chart": spec.kind, "points": len(series(spec, list(self.last.columns), self.last.rows))}
            return {"error": f"unknown tool {name}"}
        except (SqlRejected, SqlError, ChartSpecError, TypeError, KeyError) as e:
            return {"error": str(e), "hint": getattr(e, "hint", "")}


def _plain(v):
    import datetime as dt
    from decimal import Decimal

    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v.decode("utf-8", "replace") if isinstance(v, (bytes, bytearray)) else v
