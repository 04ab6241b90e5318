"""Constraint validation: all rules, keys, foreign keys, CHECKs and row counts of a schema as one DataFrame.

One pass over a table takes the values that break a rule; rows that break none leave nothing. Each key and foreign key
reads its own columns alone and is grouped in their types; keys that are referred to are counted before they meet their
parents. The single checks below it are for one table and one kind of rule.

Issues are rows (table, column, rule, violations, examples). Input columns may be typed or text, as read from files; a
typed column can't break the type rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import INTEGERS, TEMPORAL, Column, ForeignKey, Schema, Table

ISSUES = "table string, column string, rule string, violations long, examples array<string>"


@dataclass
class Report:
    """Issues found, notes on what wasn't checked, and row counts."""

    issues: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.issues

    def by_table(self, name: str) -> list[dict]:
        return [i for i in self.issues if i["table"].lower() == name.lower()]

    def summary(self, most: int = 8) -> str:
        if self.ok:
            return f"no issues in {sum(self.rows.values())} rows of {len(self.rows)} tables"
        lines = [f"{i['table']}.{i['column']}: {i['rule']} ({i['violations']})" for i in self.issues[:most]]
        return "\n".join([*lines, *([f"... and {len(self.issues) - most} more"] if len(self.issues) > most else [])])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(i[k] for k in ("table", "column", "rule", "violations", "examples")) for i in self.issues], ISSUES)


def _text(df: DataFrame, c: Column) -> bool:
    return isinstance(df.schema[_actual(df, c.name)].dataType, T.StringType)


def _actual(df: DataFrame, name: str) -> str:
    return next(x for x in df.columns if x.lower() == name.lower())


def column_rules(df: DataFrame, c: Column) -> dict[str, Col]:
    """Rule -> condition that a row breaks it. Rows of the wrong type are left out of the rules that follow."""
    x = F.col(_actual(df, c.name))
    raw, is_text = x, _text(df, c)
    out: dict[str, Col] = {}
    if not c.nullable:
        out["not_null"] = x.isNull()
    wrong = F.lit(False)
    if is_text and c.type in INTEGERS:
        wrong = x.isNotNull() & (~F.trim(x).rlike(r"^[+-]?\d+$") | x.try_cast("long").isNull())
    elif is_text and c.type in ("DECIMAL", "FLOAT"):
        wrong = x.isNotNull() & x.try_cast("double").isNull()
    elif is_text and c.type == "BOOLEAN":
        wrong = x.isNotNull() & ~F.lower(F.trim(x)).isin("true", "false", "t", "f", "1", "0")
    elif is_text and c.type in TEMPORAL:
        wrong = x.isNotNull() & (F.try_to_date(x) if c.type == "DATE" else F.try_to_timestamp(x)).isNull()
    if is_text and c.type in (*INTEGERS, "DECIMAL", "FLOAT", "BOOLEAN"):
        out["type"] = wrong
    elif is_text and c.type in TEMPORAL:
        out["date_invalid"] = wrong
    right = x.isNotNull() & ~wrong
    if c.type == "ENUM":
        out["enum"] = right & ~raw.isin(*c.values)
    if c.max_length and c.type != "ENUM":
        out["varchar_length"] = right & (F.char_length(raw) > c.max_length)
    if c.type == "DECIMAL":
        if is_text:
            digits = F.when(F.instr(raw, ".") > 0, F.length(F.substring_index(raw, ".", -1))).otherwise(0)
            out["decimal_scale"] = right & (digits > c.scale)
        value = x.try_cast("double") if is_text else x.cast("double")
        out["decimal_precision"] = right & (F.abs(value) >= F.lit(10.0 ** (c.precision - c.scale)))
    return out


def column_issues(df: DataFrame, table: Table, examples: int = 5) -> DataFrame:
    """(table, column, rule, violations, examples) of all column rules, in one pass over the table.

    Examples are the least values that break a rule, so that reruns agree.
    """
    aggs, rules = [F.count(F.lit(1)).alias("rows")], []
    for c in table.columns:
        for rule, bad in column_rules(df, c).items():
            k = len(rules)
            rules.append((c.name, rule))
            shown = F.substring(F.col(_actual(df, c.name)).cast("string"), 1, 60)
            aggs += [F.count(F.when(bad, 1)).alias(f"n{k}"), F.min(F.when(bad, shown)).alias(f"e{k}")]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(table.name).alias("table"), F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"n{k}").alias("violations"), F.array_compact(F.array(F.col(f"e{k}"))).alias("examples")) for k, (c, r) in enumerate(rules)]
    if not parts:
        return df.sparkSession.createDataFrame([], ISSUES)
    return one.select(F.explode(F.array(*parts)).alias("i")).select("i.*")


def key_issues(df: DataFrame, table: Table) -> DataFrame:
    """Rows beyond the first of each repeated key; a key with a null is exempt."""
    out = None
    for key in table.keys:
        cols = [_actual(df, c) for c in key]
        rule = "pk_duplicate" if key == table.primary_key else "unique"
        whole = df
        for c in cols:
            whole = whole.where(F.col(c).isNotNull())
        more = whole.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        one = more.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"), F.min(F.concat_ws(", ", *[F.col(c).cast("string") for c in cols])).alias("e"))
        one = one.select(F.lit(table.name).alias("table"), F.lit(", ".join(key)).alias("column"), F.lit(rule).alias("rule"), "violations", F.array_compact(F.array("e")).alias("examples"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], ISSUES)


def dangling(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows whose whole key is set and has no parent row."""
    cols = [_actual(child, c) for c in fk.columns]
    for c in cols:
        child = child.where(F.col(c).isNotNull())
    keys = parent.select(*[F.col(_actual(parent, p)).alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)])
    on = None
    for i, c in enumerate(cols):
        one = F.col(c) == F.col(f"_p{i}")
        on = one if on is None else on & one
    return child.join(keys, on, "left_anti")


def fk_issues(tables: dict[str, DataFrame], table: Table) -> DataFrame | None:
    out = None
    for fk in table.foreign_keys:
        child, parent = tables.get(table.name.lower()), tables.get(fk.parent.lower())
        if child is None or parent is None:
            continue
        shown = F.concat_ws(", ", *[F.col(_actual(child, c)).cast("string") for c in fk.columns])
        one = dangling(child, parent, fk).agg(F.count(F.lit(1)).alias("violations"), F.min(shown).alias("e"))
        one = one.select(F.lit(table.name).alias("table"), F.lit(", ".join(fk.columns)).alias("column"), F.lit("fk_dangling").alias("rule"), "violations", F.array_compact(F.array("e")).alias("examples"))
        out = one if out is None else out.unionByName(one)
    return out


#: What a CHECK may hold for us to evaluate it: columns, literals, comparisons, AND OR NOT, BETWEEN, IN, IS NULL.
_CHECK_TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|\"[^\"]+\"|`[^`]+`|-?\d+(?:\.\d+)?|<=|>=|<>|!=|=|<|>|\(|\)|,|[A-Za-z_]\w*")
_CHECK_WORDS = {"AND", "OR", "NOT", "BETWEEN", "IN", "IS", "NULL", "TRUE", "FALSE"}


def check_condition(check: str, table: Table) -> tuple[str | None, str]:
    """(Spark SQL of a CHECK, columns it names); None where the CHECK is outside what is evaluated."""
    out, names, pos, previous = [], [], 0, ""
    while pos < len(check):
        m = _CHECK_TOKEN.match(check, pos)
        if not m:
            return None, ""
        tok, pos = m.group(), m.end()
        if tok.isspace():
            continue
        if re.match(r'[A-Za-z_"`]', tok):
            bare = tok.strip('"`')
            if tok.upper() in _CHECK_WORDS and tok[0] not in '"`':
                tok = tok.upper()
            elif table.has(bare):
                names.append(table.column(bare).name)
                tok = f"`{table.column(bare).name}`"
            else:
                return None, ""  # a function, LIKE or an unknown column
        elif tok == "(" and previous.startswith("`"):
            return None, ""
        out.append(tok)
        previous = tok
    if not names or not any(t in ("=", "<>", "!=", "<", ">", "<=", ">=", "BETWEEN", "IN", "IS") for t in out):
        return None, ""
    return " ".join(out), ", ".join(dict.fromkeys(names))


def check_failed(condition: str) -> Col:
    """Only FALSE fails; NULL passes."""
    return F.coalesce(~F.expr(condition), F.lit(False))


def check_issues(df: DataFrame, table: Table, notes: list[str]) -> DataFrame | None:
    out = None
    for check in table.checks:
        condition, names = check_condition(check, table)
        if condition is None:
            notes.append(f"{table.name}: CHECK ({check}) isn't evaluated")
            continue
        one = df.agg(F.count(F.when(check_failed(condition), 1)).alias("violations"))
        one = one.select(F.lit(table.name).alias("table"), F.lit(names).alias("column"), F.lit("check").alias("rule"), "violations", F.array().cast("array<string>").alias("examples"))
        out = one if out is None else out.unionByName(one)
    return out


def check_bounds(check: str, column: str) -> tuple[float | None, float | None, list[str] | None]:
    """(lowest, highest, allowed values) that a CHECK sets for one column; strict integer bounds move by one."""
    lo = hi = None
    name = rf'["`]?{re.escape(column)}["`]?'
    if m := re.search(rf"{name}\s+IN\s*\(([^)]*)\)", check, re.I):
        return None, None, [x.strip().strip("'") for x in m[1].split(",")]
    if m := re.search(rf"{name}\s+BETWEEN\s+(-?[\d.]+)\s+AND\s+(-?[\d.]+)", check, re.I):
        return float(m[1]), float(m[2]), None
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    found = [(m[1], m[2]) for m in re.finditer(rf"(?<![\w.]){name}\s*(<=|>=|<|>)\s*(-?\d+(?:\.\d+)?)", check, re.I)]
    found += [(flip[m[2]], m[1]) for m in re.finditer(rf"(-?\d+(?:\.\d+)?)\s*(<=|>=|<|>)\s*{name}(?!\w)", check, re.I)]
    for op, text in found:
        v = float(text)
        step = 1 if op in "<>" and "." not in text else 0
        if op[0] == ">":
            lo = v + step if lo is None else max(lo, v + step)
        else:
            hi = v - step if hi is None else min(hi, v - step)
    return lo, hi, None


@dataclass(frozen=True)
class _Tag:
    kind: str  # rule, key, fk or rows
    table: str
    column: str
    rule: str


#: Examples of an issue.
EXAMPLES = 5


#: Types whose values are grouped as they are; others as text.
_PLAIN = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _key(df: DataFrame, column: str, like: T.DataType | None = None) -> Col:
    """A key's column, in a form that equals that of the key of type ``like`` that it refers to: whole numbers as long,
    values of one plain type as they are, others as text, in the other type where they fit."""
    x, own = F.col(_actual(df, column)), df.schema[_actual(df, column)].dataType
    like = own if like is None else like
    if isinstance(own, T.IntegralType) and isinstance(like, T.IntegralType):
        return x.cast("long")
    if own == like and isinstance(own, _PLAIN):
        return x
    return F.coalesce(x.try_cast(like).cast("string"), x.cast("string"))


def _keys(df: DataFrame, columns: tuple[str, ...], like: list[T.DataType] | None = None) -> DataFrame:
    """(k0, k1, ...) of the rows whose key has no null."""
    whole = F.lit(True)
    for c in columns:
        whole &= F.col(_actual(df, c)).isNotNull()
    return df.where(whole).select(*[_key(df, c, kind).alias(f"k{i}") for i, (c, kind) in enumerate(zip(columns, like or [None] * len(columns), strict=True))])


def _wrong_keys(keys: DataFrame, tag: int, parents: DataFrame | None = None) -> DataFrame:
    """(tag, fact, violations): keys that occur again, by rows beyond the first; or those without a parent, by rows."""
    names = keys.columns
    found = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    found = found.where("n > 1").withColumn("n", F.col("n") - 1) if parents is None else found.join(parents, names, "left_anti")
    return found.select(F.lit(tag).alias("tag"), F.array(*[F.col(c).cast("string") for c in names]).alias("fact"), F.col("n").alias("violations"))


def _facts(schema: Schema, tables: dict[str, DataFrame], notes: list[str]) -> tuple[list[DataFrame], list[DataFrame], list[_Tag]]:
    """Tables (tag, fact, violations) of what is wrong in all tables that have the schema's columns, tables (tag,
    violations) of their rows, and the tags."""
    fits = {t.name: tables[t.name.lower()] for t in schema.tables if t.name.lower() in tables and {c.lower() for c in tables[t.name.lower()].columns} == {c.lower() for c in t.names}}
    tags: list[_Tag] = []
    wrong: list[DataFrame] = []
    counts: list[DataFrame] = []

    def add(*tag: str) -> int:
        tags.append(_Tag(*tag))
        return len(tags) - 1

    for t in schema.tables:
        if (df := fits.get(t.name)) is None:
            continue
        counts.append(df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(add("rows", t.name, "", "rows")).alias("tag"), "violations"))
        broken: list[Col] = []
        for c in t.columns:
            shown = F.array(F.substring(F.col(_actual(df, c.name)).cast("string"), 1, 60))
            for rule, bad in column_rules(df, c).items():
                broken.append(_fact(add("rule", t.name, c.name, rule), shown, bad))
        for key in t.keys:
            wrong.append(_wrong_keys(_keys(df, key), add("key", t.name, ", ".join(key), "pk_duplicate" if key == t.primary_key else "unique")))
        for fk in t.foreign_keys:
            if (parent := fits.get(fk.parent)) is None:
                continue
            own, kinds = ([x.schema[_actual(x, c)].dataType for c in columns] for x, columns in ((df, fk.columns), (parent, fk.parent_columns)))
            at = add("fk", t.name, ", ".join(fk.columns), "fk_dangling")
            # where the child's type is another, both sides are texts of the parent's
            parents = _keys(parent, fk.parent_columns).toDF(*[f"k{i}" for i in range(len(kinds))])
            child = _keys(df, fk.columns, kinds)
            texts = [i for i, (x, y) in enumerate(zip(own, kinds, strict=True)) if child.schema[i].dataType != parents.schema[i].dataType or x != y]
            wrong.append(_wrong_keys(child, at, parents.withColumns({f"k{i}": F.col(f"k{i}").cast(child.schema[i].dataType) for i in texts})))
        for check in t.checks:
            condition, names = check_condition(check, t)
            if condition is None:
                notes.append(f"{t.name}: CHECK ({check}) isn't evaluated")
            else:
                broken.append(_fact(add("rule", t.name, names, "check"), F.array().cast("array<string>"), check_failed(condition)))
        if broken:
            rows = df.select(F.explode(F.array_compact(F.array(*broken))).alias("f")).select("f.*")
            wrong.append(rows.groupBy("tag", "fact").agg(F.count(F.lit(1)).alias("violations")))
    return wrong, counts, tags


def _fact(tag: int, fact: Col, where: Col) -> Col:
    return F.when(where, F.struct(F.lit(tag).alias("tag"), fact.alias("fact")))


def scan(schema: Schema, tables: dict[str, DataFrame], notes: list[str] | None = None) -> DataFrame | None:
    """(kind, table, column, rule, violations, examples) of every tag, zero ones too; of kind rows, violations are the rows."""
    tables = {k.lower(): v for k, v in tables.items()}
    parts, counts, tags = _facts(schema, tables, [] if notes is None else notes)
    if not counts:
        return None
    spark = counts[0].sparkSession
    # one row for each rule of the schema
    named = F.broadcast(spark.createDataFrame([(i, x.kind, x.table, x.column, x.rule) for i, x in enumerate(tags)], "tag int, kind string, table string, column string, rule string"))
    wrong = spark.createDataFrame([], "tag int, fact array<string>, violations long") if not parts else reduce(DataFrame.union, parts)
    place = F.row_number().over(Window.partitionBy("tag").orderBy("fact"))
    shown = wrong.withColumn("place", place).where(F.col("place") <= EXAMPLES)
    shown = shown.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list("fact")), lambda x: F.array_join(x, ", ")).alias("examples"))
    shown = shown.withColumn("examples", F.filter("examples", lambda x: x != ""))
    totals = reduce(DataFrame.union, [wrong.groupBy("tag").agg(F.sum("violations").alias("violations")), *counts])
    out = named.join(totals, "tag", "left").join(shown, "tag", "left")
    return out.select("kind", "table", "column", "rule", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def issue_frame(schema: Schema, tables: dict[str, DataFrame], notes: list[str] | None = None) -> DataFrame | None:
    """Every rule of every supplied table with its violations (zero ones too), as one DataFrame."""
    out = scan(schema, tables, notes)
    return out if out is None else out.where("kind <> 'rows'").drop("kind")


def row_counts(schema: Schema, tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(table, rows, expected, violations) of the tables for which a number of rows is expected."""
    want = F.broadcast(next(iter(tables.values())).sparkSession.createDataFrame(list({k.lower(): v for k, v in expected.items()}.items()), "name string, expected long"))
    out = None
    for t in schema.tables:
        if (df := {k.lower(): v for k, v in tables.items()}.get(t.name.lower())) is not None:
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t.name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
    return out.join(want, F.lower("table") == F.col("name")).select("table", "rows", "expected", F.abs(F.col("rows") - F.col("expected")).alias("violations"))


def validate(schema: Schema, tables: dict[str, DataFrame], *, expected_rows: dict[str, int] | None = None) -> Report:
    """Check tables against their schema. Missing or extra columns skip a table's other checks."""
    report = Report()
    given = {k.lower(): v for k, v in tables.items()}
    expected = {k.lower(): v for k, v in (expected_rows or {}).items()}

    def issue(table: str, column: str, rule: str, n: int, examples=()) -> None:
        report.issues.append({"table": table, "column": column, "rule": rule, "violations": n, "examples": list(examples)})

    found = scan(schema, tables, report.notes)
    told = found.collect() if found is not None else []  # a row for each rule
    rows = {r["table"]: r["violations"] for r in told if r["kind"] == "rows"}
    for t in schema.tables:
        df = given.get(t.name.lower())
        if df is None:
            issue(t.name, "", "missing_table", 1)
            continue
        have, want = {c.lower() for c in df.columns}, {c.lower() for c in t.names}
        if have != want:
            issue(t.name, "", "columns_mismatch", len(have ^ want), sorted(have ^ want))
        report.rows[t.name] = rows[t.name] if t.name in rows else df.count()
        if (n := expected.get(t.name.lower())) is not None and n != report.rows[t.name]:
            issue(t.name, "", "row_count", abs(n - report.rows[t.name]))
    for r in told:
        if r["kind"] != "rows" and r["violations"]:
            issue(r["table"], r["column"], r["rule"], r["violations"], r["examples"])
    return report
