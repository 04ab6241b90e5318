"""Registered queries of the relational operators over the driver's tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import derive
from .operators import charts, consistency, edit, generate, unique, validate
from .plans.guard import guarded_frame
from .plans.schema import Column, parse_ddl
from .sources.csvio import csv_lines

#: The driver's tables as DDL of our own.
DDL = """
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL);
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) NOT NULL, n_regionkey INT NOT NULL REFERENCES region);
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(25) NOT NULL, c_nationkey INT NOT NULL REFERENCES nation, c_acctbal DOUBLE, c_mktsegment VARCHAR(10) NOT NULL);
CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR(25) NOT NULL, s_nationkey INT NOT NULL REFERENCES nation, s_acctbal DOUBLE);
CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name VARCHAR(55), p_brand VARCHAR(10), p_type VARCHAR(25), p_size INT CHECK (p_size >= 1 AND p_size <= 50), p_retailprice DOUBLE);
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL REFERENCES customer, o_orderstatus ENUM('F', 'O', 'P') NOT NULL, o_totalprice DOUBLE NOT NULL, o_orderdate TIMESTAMP, o_orderpriority VARCHAR(15));
CREATE TABLE lineitem (l_orderkey BIGINT NOT NULL REFERENCES orders, l_partkey BIGINT NOT NULL REFERENCES part, l_suppkey BIGINT NOT NULL REFERENCES supplier, l_linenumber INT NOT NULL, l_quantity DOUBLE,
  l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag ENUM('A', 'N', 'R'), l_linestatus ENUM('F', 'O'), l_shipdate TIMESTAMP, PRIMARY KEY (l_orderkey, l_linenumber),
  CHECK (l_quantity BETWEEN 1 AND 50), CHECK (l_discount <= 0.05 OR l_tax > 0.02));
"""
SCHEMA = parse_ddl(DDL)
TABLES = tuple(t.name for t in SCHEMA.tables)


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TABLES}


_LIMITED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: Guarded SQL whose text runs unchanged in both engines.
GUARDED = {
    "guarded_revenue_by_nation": "SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC NULLS LAST, n_name",
    "guarded_topk_customers_nulls_last": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20",
    "guarded_cte_order_counts": "WITH n AS (SELECT o_custkey, count(*) AS orders_n FROM orders GROUP BY o_custkey) SELECT orders_n, count(*) AS customers_n FROM n GROUP BY orders_n",
    "guarded_union_keys": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "guarded_union_all_keys": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "guarded_intersect_keys": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0",
    "guarded_except_keys": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders",
    "guarded_window_rank_per_nation": "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rnk FROM customer",
    "guarded_running_total_orders": "SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
    "guarded_lag_lead_orders": "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before_key, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS after_key FROM orders",
    "guarded_rollup_status_priority": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "guarded_cube_flags": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "guarded_grouping_sets": "SELECT p_brand, coalesce(p_size, -1) AS p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (part.p_size), ())",
    "guarded_outer_join_orders_without_items": "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL",
    "guarded_full_outer_nations": "SELECT coalesce(c_nationkey, -1) AS c_nation, coalesce(s_nationkey, -1) AS s_nation, count(*) AS n FROM customer FULL JOIN supplier ON c_custkey = s_suppkey GROUP BY c_nationkey, s_nationkey",
    "guarded_exists_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "guarded_not_exists_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "guarded_theta_join_regions": "SELECT a.r_name AS low_name, b.r_name AS high_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "guarded_distinct_having": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers_n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10",
    "guarded_aggregate_filter": "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS large_n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag",
    "guarded_case_and_functions": "SELECT p_partkey, upper(p_brand) AS brand, coalesce(p_size, 0) AS size, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, length(p_name) AS name_length FROM part",
    "guarded_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "guarded_offset_page": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 20",
}


def _guarded(text: str):
    return lambda spark, sf_dir: guarded_frame(spark, text, load(spark, sf_dir))


for _name, _text in GUARDED.items():
    _QUERIES[_name], _SQL[_name] = _guarded(_text), _text


@query(f"{_LIMITED} LIMIT 50")
def guarded_row_limit(spark, d):
    return guarded_frame(spark, _LIMITED, load(spark, d), limit=50)


@query("SELECT count(*) AS violations FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 0.011 UNION ALL SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + INTERVAL 5 DAY AND l_shipdate < DATE '1998-01-01' UNION ALL SELECT count(*) FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(a, 0)) > 0.011")
def consistency_of_plan(spark, d):
    """All relations of a plan in one table of issues: a derived price, a date after the parent's, a total of children."""
    import datetime as dt

    plans = generate.plan(SCHEMA)
    plans["lineitem"].columns.update({"l_extendedprice": generate.Recipe("derived", {"expression": "l_quantity * parent(l_partkey).p_retailprice"}), "l_shipdate": generate.Recipe("datetime", {"start": dt.date(1992, 1, 1), "end": dt.date(1998, 1, 1), "after": "parent(l_orderkey).o_orderdate", "min": 5})})
    plans["orders"].columns["o_totalprice"] = generate.Recipe("aggregate", {"child": "lineitem", "fk": "l_orderkey", "column": "l_quantity", "agg": "sum"})
    found = consistency.check(SCHEMA, plans, load(spark, d))
    return found.where("column IN ('l_extendedprice', 'l_shipdate', 'o_totalprice')").select("violations")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def validate_pk_duplicates_lineitem(spark, d):
    return validate.key_issues(load(spark, d)["lineitem"], SCHEMA.table("lineitem")).select("violations")


@query("SELECT 'region' AS tbl, count(*) - count(DISTINCT r_regionkey) AS violations FROM region UNION ALL SELECT 'nation', count(*) - count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'customer', count(*) - count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'supplier', count(*) - count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'part', count(*) - count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'orders', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))")
def validate_pk_all_tables(spark, d):
    out = None
    for name, df in load(spark, d).items():
        one = validate.key_issues(df, SCHEMA.table(name)).select(F.lit(name).alias("tbl"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


_FK_SQL = " UNION ALL ".join(f"SELECT '{t.name}' AS tbl, '{fk.columns[0]}' AS col, count(*) AS violations FROM {t.name} c WHERE {fk.columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE p.{fk.parent_columns[0]} = c.{fk.columns[0]})" for t in SCHEMA.tables for fk in t.foreign_keys)


@query(_FK_SQL)
def validate_fk_all(spark, d):
    tables = load(spark, d)
    out = None
    for t in SCHEMA.tables:
        one = validate.fk_issues(tables, t)
        if one is not None:
            out = one if out is None else out.unionByName(one)
    return out.select(F.col("table").alias("tbl"), F.col("column").alias("col"), "violations")


@query("SELECT count(*) AS violations FROM (SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def validate_fk_dangling_corrupted(spark, d):
    t = load(spark, d)
    bad = t["orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") % 101 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey")))
    return validate.fk_issues({**t, "orders": bad}, SCHEMA.table("orders")).select("violations")


def _corrupted_orders(spark, d) -> DataFrame:
    """Text-typed orders with every kind of wrong value, by arithmetic on the key."""
    k = F.col("o_orderkey")
    return load(spark, d)["orders"].select(
        k.cast("string").alias("o_orderkey"),
        F.when(k % 97 == 0, None).when(k % 89 == 0, F.lit("abc")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(k % 83 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 79 == 0, F.lit("many")).otherwise(F.lit("12.5")).alias("o_totalprice"),
        F.when(k % 73 == 0, F.lit("not-a-date")).otherwise(F.lit("2024-02-29 10:00:00")).alias("o_orderdate"),
        F.when(k % 71 == 0, F.lit("a priority that is far too long")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


@query("""SELECT * FROM (
  SELECT 'o_orderkey' AS col, 'not_null' AS rule, 0 AS violations UNION ALL SELECT 'o_orderkey', 'type', 0
  UNION ALL SELECT 'o_custkey', 'not_null', count(*) FROM orders WHERE o_orderkey % 97 = 0
  UNION ALL SELECT 'o_custkey', 'type', count(*) FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0
  UNION ALL SELECT 'o_orderstatus', 'not_null', 0 UNION ALL SELECT 'o_orderstatus', 'enum', count(*) FROM orders WHERE o_orderkey % 83 = 0
  UNION ALL SELECT 'o_totalprice', 'not_null', 0 UNION ALL SELECT 'o_totalprice', 'type', count(*) FROM orders WHERE o_orderkey % 79 = 0
  UNION ALL SELECT 'o_orderdate', 'date_invalid', count(*) FROM orders WHERE o_orderkey % 73 = 0
  UNION ALL SELECT 'o_orderpriority', 'varchar_length', count(*) FROM orders WHERE o_orderkey % 71 = 0)""")
def validate_column_rules_corrupted(spark, d):
    return validate.column_issues(_corrupted_orders(spark, d), SCHEMA.table("orders")).select(F.col("column").alias("col"), "rule", "violations")


_DECIMAL = parse_ddl("CREATE TABLE prices (k BIGINT, price DECIMAL(6, 2))").table("prices")


@query("SELECT 'decimal_scale' AS rule, count(*) AS violations FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'decimal_precision', count(*) FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 = 0 UNION ALL SELECT 'type', 0 UNION ALL SELECT 'type', 0")
def validate_decimal_rules_corrupted(spark, d):
    k = F.col("p_partkey")
    rows = load(spark, d)["part"].select(k.cast("string").alias("k"), F.when(k % 11 == 0, F.lit("1.234")).when(k % 13 == 0, F.lit("123456.7")).otherwise(F.lit("9.50")).alias("price"))
    return validate.column_issues(rows, _DECIMAL).select("rule", "violations")


@query("SELECT 'l_quantity' AS cols, count(*) AS violations FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 50) UNION ALL SELECT 'l_discount, l_tax', count(*) FROM lineitem WHERE NOT (l_discount <= 0.05 OR l_tax > 0.02)")
def validate_checks_lineitem(spark, d):
    return validate.check_issues(load(spark, d)["lineitem"], SCHEMA.table("lineitem"), []).select(F.col("column").alias("cols"), "violations")


@query("SELECT count(*) AS violations FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS s FROM part) WHERE NOT (s >= 10 AND s <= 40)")
def validate_check_three_valued(spark, d):
    rows = load(spark, d)["part"].withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    condition, _ = validate.check_condition("p_size >= 10 AND p_size <= 40", SCHEMA.table("part"))
    return rows.where(validate.check_failed(condition)).agg(F.count(F.lit(1)).alias("violations"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES))
def validate_row_counts(spark, d):
    return validate.row_counts(SCHEMA, load(spark, d), dict.fromkeys(TABLES, 0)).select(F.col("table").alias("tbl"), F.col("rows").alias("n"))


def _report_sql() -> str:
    """The same rules over typed columns: types can't be wrong, lengths, enums, keys and CHECKs can."""
    parts = []
    for t in SCHEMA.tables:
        def one(column: str, rule: str, count: str, table: str = t.name) -> None:
            parts.append(f"SELECT '{table}' AS tbl, '{column}' AS col, '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations")

        for c in t.columns:
            if not c.nullable:
                one(c.name, "not_null", f"SELECT count(*) FROM {t.name} WHERE {c.name} IS NULL")
            if c.type == "ENUM":
                one(c.name, "enum", f"SELECT count(*) FROM {t.name} WHERE {c.name} NOT IN ({', '.join(repr(v) for v in c.values)})")
            elif c.max_length:
                one(c.name, "varchar_length", f"SELECT count(*) FROM {t.name} WHERE length({c.name}) > {c.max_length}")
        for key in t.keys:
            one(", ".join(key), "pk_duplicate", f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t.name} GROUP BY {', '.join(key)})")
        for fk in t.foreign_keys:
            one(", ".join(fk.columns), "fk_dangling", f"SELECT count(*) FROM {t.name} WHERE {fk.columns[0]} NOT IN (SELECT {fk.parent_columns[0]} FROM {fk.parent})")
        for check in t.checks:
            names = validate.check_condition(check, t)[1]
            one(names, "check", f"SELECT count(*) FROM {t.name} WHERE NOT ({check})")
    return " UNION ALL ".join(parts)


@query(_report_sql())
def validate_report(spark, d):
    return validate.issue_frame(SCHEMA, load(spark, d)).select(F.col("table").alias("tbl"), F.col("column").alias("col"), "rule", "violations")


@query("""SELECT 'l_partkey' AS col, (SELECT count(*) FROM lineitem WHERE l_orderkey % 40 = 0) AS violations, (SELECT array_to_string(list(k ORDER BY k)[1:5], ';') FROM (SELECT DISTINCT CAST(-1 - l_partkey AS VARCHAR) AS k FROM lineitem WHERE l_orderkey % 40 = 0)) AS examples
  UNION ALL SELECT 'l_returnflag', (SELECT count(*) FROM lineitem WHERE l_orderkey % 30 = 0), (SELECT array_to_string(list(k ORDER BY k)[1:5], ';') FROM (SELECT DISTINCT 'Z' || (l_orderkey % 7) AS k FROM lineitem WHERE l_orderkey % 30 = 0))""")
def validate_examples_corrupted(spark, d):
    """One scan of corrupted line items: how many break each kind of rule, and the five least values that do."""
    t = load(spark, d)
    k = F.col("l_orderkey")
    t["lineitem"] = t["lineitem"].withColumns({
        "l_partkey": F.when(k % 40 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")),
        "l_returnflag": F.when(k % 30 == 0, F.concat(F.lit("Z"), (k % 7).cast("string"))).otherwise(F.col("l_returnflag")),
    })
    found = validate.issue_frame(SCHEMA, t).where("table = 'lineitem' AND rule IN ('fk_dangling', 'enum') AND column IN ('l_partkey', 'l_returnflag')")
    return found.select(F.col("column").alias("col"), "violations", F.array_join("examples", ";").alias("examples"))


def _aggregate(agg: str):
    def run(spark, d):
        t = load(spark, d)
        items = t["lineitem"].withColumn("v", F.col("l_quantity"))
        wide = consistency.child_aggregate(t["orders"], "o_orderkey", items, "l_orderkey", "v", agg)
        return wide.select("o_orderkey", F.round(F.col("recomputed").cast("double"), 6).alias("recomputed"))

    return run


for _agg in consistency.AGGREGATES:
    _sql_agg = "count(*)" if _agg == "count" else f"{_agg}(l_quantity)"
    _QUERIES[f"consistency_aggregate_{_agg}"] = _aggregate(_agg)
    _SQL[f"consistency_aggregate_{_agg}"] = f"SELECT o_orderkey, round(CAST(coalesce(a, 0) AS DOUBLE), 6) AS recomputed FROM orders LEFT JOIN (SELECT l_orderkey, {_sql_agg} AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"


@query("SELECT count(*) AS violations FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 0.011")
def consistency_derived_extended_price(spark, d):
    t = load(spark, d)
    bad = consistency.derived_mismatches(t["lineitem"], "l_extendedprice", "l_quantity * parent(l_partkey).p_retailprice", {"l_partkey": (t["part"], "p_partkey")})
    return bad.agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT count(*) AS violations FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(a, 0)) > 0.011")
def consistency_aggregate_mismatches(spark, d):
    t = load(spark, d)
    return consistency.aggregate_mismatches(t["orders"], "o_orderkey", "o_totalprice", t["lineitem"], "l_orderkey", "l_quantity", "sum").agg(F.count(F.lit(1)).alias("violations"))


def _ships(spark, d, gap: int) -> DataFrame:
    t = load(spark, d)
    both = t["lineitem"].join(t["orders"].select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return consistency.order_violations(both, "l_shipdate", F.col("o_orderdate"), gap).agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def consistency_after_shipdate(spark, d):
    return _ships(spark, d, 0)


@query("SELECT count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 30 DAYS")
def consistency_after_min_gap(spark, d):
    return _ships(spark, d, 30)


def _derive(table: str, key: str, expression: str, **how):
    def run(spark, d):
        t = load(spark, d)
        parents = {"l_partkey": (t["part"], "p_partkey"), "l_orderkey": (t["orders"], "o_orderkey"), "o_custkey": (t["customer"], "c_custkey")}
        df = t[table]
        if how.get("nulls"):
            df = df.withColumn(how["nulls"], F.when(F.col(key) % 5 != 0, F.col(how["nulls"])))
        out = derive(df, expression, parents)
        c = F.col("derived")
        return out.select(key, (F.round(c, 6) if how.get("round", True) else c).alias("derived"))

    return run


_DERIVED = {
    "derive_net_price": ("lineitem", "l_orderkey", "l_extendedprice * (1 - l_discount)", {}, "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) AS derived FROM lineitem"),
    "derive_status_conditional": ("orders", "o_orderkey", "'big' if o_totalprice > 200000 else ('open' if o_orderstatus == 'O' else 'other')", {"round": False}, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS derived FROM orders"),
    "derive_floor_mod_semantics": ("part", "p_partkey", "(p_size - 25) // 7 + (p_size - 25) % 7", {}, "SELECT p_partkey, round(floor((p_size - 25) / 7.0::DOUBLE) + ((p_size - 25) - floor((p_size - 25) / 7.0::DOUBLE) * 7), 6) AS derived FROM part"),
    "derive_null_poison": ("part", "p_partkey", "1 if (p_size > 10 or p_size + 1 > 0) else 0", {"nulls": "p_size"}, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CASE WHEN p_size > 10 OR p_size + 1 > 0 THEN 1.0 ELSE 0.0 END END AS derived FROM part"),
    "derive_not_null_is_true": ("part", "p_partkey", "1 if not p_size else 0", {"nulls": "p_size"}, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_size = 0 THEN 1.0 ELSE 0.0 END AS derived FROM part"),
    "derive_coalesce_min_max": ("part", "p_partkey", "coalesce(max(p_size, 10), 0) + min(p_partkey, 100)", {"nulls": "p_size"}, "SELECT p_partkey, CAST((CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE greatest(p_size, 10) END) + least(p_partkey, 100) AS DOUBLE) AS derived FROM part"),
    "derive_days_between_parent": ("lineitem", "l_orderkey", "days_between(parent(l_orderkey).o_orderdate, l_shipdate)", {}, "SELECT l_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS derived FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"),
    "derive_division_by_zero": ("part", "p_partkey", "p_retailprice / (p_size - 10)", {}, "SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE round(p_retailprice / (p_size - 10), 6) END AS derived FROM part"),
}
for _name, (_t, _k, _e, _how, _text) in _DERIVED.items():
    _QUERIES[_name], _SQL[_name] = _derive(_t, _k, _e, **_how), _text


@query("SELECT o_orderkey, CAST(coalesce(a, 0) AS DOUBLE) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def recompute_order_totals(spark, d):
    t = load(spark, d)
    return consistency.child_aggregate(t["orders"].drop("o_totalprice"), "o_orderkey", t["lineitem"], "l_orderkey", "l_quantity", "sum", 0, "o_totalprice").select("o_orderkey", "o_totalprice")


def _edited(spark, d, table: str, *ops: edit.Op) -> dict[str, DataFrame]:
    tables = load(spark, d)
    edit.check_ops(SCHEMA, table, list(ops))
    t = SCHEMA.table(table)
    for o in ops:
        hit = edit.with_condition(tables[table], o.args.get("where"), SCHEMA, tables, t)
        if o.op == "set_values":
            tables[table] = edit.set_values(hit, F.col("__hit"), o.args["column"], F.lit(o.args["value"])).drop("__hit")
    return tables


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'heavy' ELSE p_type END AS p_type FROM part")
def edit_set_values_where(spark, d):
    return _edited(spark, d, "part", edit.Op("set_values", {"column": "p_type", "value": "heavy", "where": "p_size > 40"}))["part"].select("p_partkey", "p_type")


@query("SELECT o_orderkey, CASE WHEN c_acctbal < 0 AND o_orderdate >= DATE '1995-01-01' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
def edit_set_values_parent_filter(spark, d):
    op = edit.Op("set_values", {"column": "o_orderstatus", "value": "P", "where": "parent(o_custkey).c_acctbal < 0 and o_orderdate >= '1995-01-01'"})
    return _edited(spark, d, "orders", op)["orders"].select("o_orderkey", "o_orderstatus")


def _u(table: str, column: str, key: str, seed: int = 7, draw: int = 0) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|{table}|{column}|' || CAST({key} AS VARCHAR) || '|{draw}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(1 + floor({_u('part', 'p_size', 'p_partkey')} * 5) AS INTEGER) ELSE p_size END AS p_size FROM part")
def edit_regenerate_column(spark, d):
    t = load(spark, d)["part"]
    c = SCHEMA.table("part").column("p_size")
    new = generate.value(generate.Recipe("int_range", {"lo": 1, "hi": 5}), 7, "part", c, F.col("p_partkey"))
    return edit.set_values(t, F.col("p_size") < 10, "p_size", generate.conform(new, c)).select("p_partkey", "p_size")


@query(f"SELECT p_partkey, CASE CAST(floor({_u('part', 'p_brand', 'p_partkey')} * 3) AS INTEGER) WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS p_brand FROM part")
def edit_update_pool(spark, d):
    u = generate.uniform(7, "part", "p_brand", F.col("p_partkey"))
    return edit.update_pool(load(spark, d)["part"], F.lit(True), "p_brand", ["red", "green", "blue"], u).select("p_partkey", "p_brand")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + i AS INTEGER), 'new' FROM range(1, 4) t(i)")
def edit_add_rows(spark, d):
    t = load(spark, d)
    return edit.add_rows(t["region"], SCHEMA.table("region"), 3, {"r_name": generate.Recipe("constant", {"value": "new"})}, 7, t)


@query("SELECT 'nation' AS tbl, (SELECT count(*) FROM nation WHERE n_nationkey = 3) AS n UNION ALL SELECT 'customer', (SELECT count(*) FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier WHERE s_nationkey = 3) UNION ALL SELECT 'orders', (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))")
def edit_delete_cascade_counts(spark, d):
    t = load(spark, d)
    after, _ = edit.delete_rows(SCHEMA, t, "nation", t["nation"].where("n_nationkey = 3"))
    out = None
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        before, left = t[name].agg(F.count(F.lit(1)).alias("a")), after[name].agg(F.count(F.lit(1)).alias("b"))
        one = before.join(left).select((F.col("a") - F.col("b")).alias("n"))
        one = one.select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, CAST(coalesce((SELECT sum(CASE WHEN l_quantity > 40 THEN 1 ELSE l_quantity END) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS DOUBLE) AS o_totalprice FROM orders")
def edit_apply_refreshes_totals(spark, d):
    """An edit of line items; the orders' totals follow it."""
    plans = {"orders": {"o_totalprice": generate.Recipe("aggregate", {"child": "lineitem", "fk": "l_orderkey", "column": "l_quantity", "agg": "sum"})}}
    after, _ = edit.apply(SCHEMA, load(spark, d), "lineitem", [edit.Op("set_values", {"column": "l_quantity", "value": 1, "where": "l_quantity > 40"})], plans=plans)
    return after["orders"].select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT o_orderkey, CAST(coalesce(q, 0) AS DOUBLE) AS o_totalprice, CAST(coalesce(q, 0) AS DOUBLE) * 2 AS o_twice FROM (SELECT o_orderkey, (SELECT sum(CASE WHEN l_quantity > 49 AND l_linenumber = 1 THEN 1 WHEN l_quantity < 2 AND l_linenumber = 2 THEN 60 ELSE l_quantity END) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders)")
def edit_apply_touched_totals(spark, d):
    """Edits of some line items; only totals of their orders are computed again, from tables whose totals were right."""
    t = load(spark, d)
    schema = parse_ddl(
        "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_totalprice DOUBLE PRECISION, o_twice DOUBLE PRECISION);"
        "CREATE TABLE lineitem (l_orderkey BIGINT NOT NULL REFERENCES orders, l_linenumber INT NOT NULL, l_quantity DOUBLE PRECISION, PRIMARY KEY (l_orderkey, l_linenumber))"
    )
    data = {"orders": t["orders"].select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("o_twice")), "lineitem": t["lineitem"].select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))}
    total = generate.Recipe("aggregate", {"child": "lineitem", "fk": "l_orderkey", "column": "l_quantity", "agg": "sum"})
    plans = {"orders": {"o_totalprice": total, "o_twice": generate.Recipe("derived", {"expression": "o_totalprice * 2"})}}
    ops = [edit.Op("set_values", {"column": "l_quantity", "value": 1, "where": "l_quantity > 49 and l_linenumber == 1"}), edit.Op("set_values", {"column": "l_quantity", "value": 60, "where": "l_quantity < 2 and l_linenumber == 2"})]
    after, _ = edit.apply(schema, edit.refresh(schema, data, plans), "lineitem", ops, plans=plans, delta=True)
    return after["orders"].select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_twice").cast("double").alias("o_twice"))


_GEN = Column("v", "INTEGER")
_GENERATED = {
    "gen_int_range": (generate.Recipe("int_range", {"lo": 10, "hi": 99}), _GEN, "CAST(10 + floor(u * 90) AS INTEGER)"),
    "gen_boolean": (generate.Recipe("boolean", {"ratio": 0.8}), Column("v", "BOOLEAN"), "u < 0.8"),
    "gen_enum_weighted": (generate.Recipe("enum", {"values": ["a", "b", "c"], "weights": [2, 1, 1]}), Column("v", "VARCHAR", length=5), "CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END"),
    "gen_sequence": (generate.Recipe("sequence", {"start": 5, "step": 3}), Column("v", "BIGINT"), "CAST(5 + (i - 1) * 3 AS BIGINT)"),
    "gen_pattern_seq": (generate.Recipe("pattern", {"template": "ORD-{seq}"}), Column("v", "VARCHAR", length=20), "'ORD-' || CAST(i AS VARCHAR)"),
}
for _name, (_recipe, _column, _expr) in _GENERATED.items():
    _QUERIES[_name] = lambda spark, d, r=_recipe, c=_column: spark.range(1, 20001).select("id", generate.conform(generate.value(r, 7, "t", c, F.col("id")), c).alias("v"))
    _SQL[_name] = f"SELECT i AS id, {_expr} AS v FROM (SELECT i, {_u('t', 'v', 'i')} AS u FROM range(1, 20001) t(i))"


@query(f"SELECT i AS id, o_orderkey AS k FROM (SELECT i, CAST(floor({_u('t', 'k', 'i')} * (SELECT count(*) FROM orders)) AS BIGINT) AS pos FROM range(1, 20001) t(i)) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) ON pos = r")
def gen_fk_uniform(spark, d):
    rows = spark.range(1, 20001)
    return generate.sample_parent(rows, load(spark, d)["orders"], ["k"], ["o_orderkey"], generate.uniform(7, "t", "k", F.col("id"))).select("id", "k")


@query(f"""WITH weights AS (
  SELECT c_custkey, CAST(floor(1e12::DOUBLE * pow(row_number() OVER (ORDER BY c_custkey)::DOUBLE, -0.8)) AS BIGINT) AS w FROM customer
), summed AS (SELECT c_custkey, w, CAST(sum(w) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) - w AS before_ FROM weights),
drawn AS (SELECT o_orderkey AS id, CAST(floor({_u('t', 'k', 'o_orderkey')} * (SELECT CAST(sum(w) AS DOUBLE) FROM weights)) AS BIGINT) AS place FROM orders)
SELECT id, c_custkey AS k FROM drawn JOIN summed ON place >= before_ AND place < before_ + w""")
def gen_fk_zipf(spark, d):
    t = load(spark, d)
    rows = t["orders"].select(F.col("o_orderkey").alias("id"))
    return generate.sample_parent(rows, t["customer"], ["k"], ["c_custkey"], generate.uniform(7, "t", "k", F.col("id")), zipf=True).select("id", "k")


@query("""SELECT round_no, CAST(least(40, (SELECT count(*) FROM customer) - 40 * (round_no - 1)) AS BIGINT) AS n, CAST(least(40, (SELECT count(*) FROM customer) - 40 * (round_no - 1)) AS BIGINT) AS distinct_n
  FROM (SELECT unnest(range(1, CAST(ceil((SELECT count(*) FROM customer) / 40.0) AS BIGINT) + 1)) AS round_no)""")
def gen_pool_distinct(spark, d):
    """A unique column of a pool of 40 values: each value once, then each once with -2, and so on."""
    rows = load(spark, d)["customer"].select((F.col("c_custkey") + 1).alias("__row"))  # keys from 0 on
    n = rows.count()
    pool = generate.Recipe("pool", {"values": [f"value{i}" for i in range(40)], "unique": True})
    drawn = rows.select(generate.distinct_value(pool, 7, "t", Column("v", "VARCHAR", length=20), n).alias("v"))
    round_no = F.coalesce(F.regexp_extract("v", "-([0-9]+)$", 1).try_cast("long"), F.lit(1).cast("long"))
    return drawn.groupBy(round_no.alias("round_no")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("distinct_n"))


@query(f"""WITH rows_ AS (
  SELECT o_custkey, o_orderkey, o_orderkey % 4 AS slot, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS n,
    CAST('0x' || substr(md5('7|' || o_custkey), 1, 13) AS BIGINT) % 100000 AS turn FROM orders
), taken AS (SELECT o_custkey, list((slot - turn + 100000) % 100000) AS slots FROM rows_ WHERE n = 1 GROUP BY 1),
again AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM rows_ WHERE n > 1)
SELECT o_orderkey, slot AS code FROM rows_ WHERE n = 1
UNION ALL SELECT o_orderkey, (list_filter(range(60), lambda x: NOT list_contains(slots, x))[j] + turn) % 100000 FROM again JOIN taken USING (o_custkey)""")
def unique_set_of_customer_and_code(spark, d):
    """UNIQUE (o_custkey, code): codes that a customer has already are drawn anew, from 100,000."""
    t = load(spark, d)["orders"].select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("code"))
    out = unique.set_unique(t, ["o_custkey", "code"], "o_orderkey", 100_000, F.col("code"), lambda x, at: x.withColumn("code", F.col(at)), seed=7)
    return out.select("o_orderkey", "code")


RESTAURANT_DDL = """
CREATE TABLE places (place_id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(60) NOT NULL, kind ENUM('Bistro', 'Diner', 'Cafe') NOT NULL, rating DECIMAL(3, 2));
CREATE TABLE guests (guest_id INT PRIMARY KEY AUTO_INCREMENT, first_name VARCHAR(40) NOT NULL, last_name VARCHAR(40) NOT NULL, email VARCHAR(80) UNIQUE NOT NULL, joined_date DATE NOT NULL);
CREATE TABLE dishes (dish_id INT PRIMARY KEY AUTO_INCREMENT, place_id INT NOT NULL REFERENCES places, name VARCHAR(60) NOT NULL, price DECIMAL(8, 2) NOT NULL);
CREATE TABLE bills (bill_id INT PRIMARY KEY AUTO_INCREMENT, guest_id INT NOT NULL REFERENCES guests, place_id INT NOT NULL REFERENCES places, total_amount DECIMAL(12, 2) NOT NULL);
CREATE TABLE bill_items (item_id INT PRIMARY KEY AUTO_INCREMENT, bill_id INT NOT NULL REFERENCES bills, dish_id INT NOT NULL REFERENCES dishes, quantity INT NOT NULL CHECK (quantity >= 1 AND quantity <= 9), subtotal DECIMAL(12, 2) NOT NULL);
"""


def _no_issue_sql(schema) -> str:
    """A row with 0 for each rule of a schema over typed columns."""
    rules = []
    for t in schema.tables:
        for c in t.columns:
            rules += [(t.name, c.name, "not_null")] * (not c.nullable) + [(t.name, c.name, "enum")] * (c.type == "ENUM")
            rules += [(t.name, c.name, "varchar_length")] * bool(c.max_length and c.type != "ENUM") + [(t.name, c.name, "decimal_precision")] * (c.type == "DECIMAL")
        rules += [(t.name, ", ".join(k), "pk_duplicate" if k == t.primary_key else "unique") for k in t.keys]
        rules += [(t.name, ", ".join(fk.columns), "fk_dangling") for fk in t.foreign_keys]
        rules += [(t.name, validate.check_condition(k, t)[1], "check") for k in t.checks]
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, '{r}' AS rule, 0::BIGINT AS violations" for t, c, r in rules)


@query(_no_issue_sql(parse_ddl(RESTAURANT_DDL)))
def gen_dataset_issues(spark, d):
    """A generated data set and its validation: every rule with 0 violations."""
    schema = parse_ddl(RESTAURANT_DDL)
    tables = generate.expand(spark, schema, generate.plan(schema, 500), seed=42)
    return validate.issue_frame(schema, tables).select(F.col("table").alias("tbl"), F.col("column").alias("col"), "rule", "violations")


@query("SELECT c_custkey, c_name || CASE WHEN n > 1 THEN '-' || CAST(n AS VARCHAR) ELSE '' END AS c_name FROM (SELECT c_custkey, c_mktsegment AS c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def string_suffix_unique(spark, d):
    df = load(spark, d)["customer"].select("c_custkey", F.col("c_mktsegment").alias("c_name"))
    return generate.suffix_unique(df, "c_name", "c_custkey")


@query("""SELECT c_custkey, v || CASE WHEN n = 1 THEN '' WHEN v LIKE '%-2' THEN '-' || n ELSE '-' || (n + 1) END AS v
  FROM (SELECT c_custkey, v, row_number() OVER (PARTITION BY v ORDER BY c_custkey) AS n FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '-2' ELSE '' END AS v FROM customer))""")
def string_suffix_unique_taken(spark, d):
    """Values that end in -2 already: the number 2 of their stem is taken."""
    tail = F.when(F.col("c_custkey") % 5 == 0, "-2").otherwise("")
    return unique.suffix_unique(load(spark, d)["customer"].select("c_custkey", F.concat("c_mktsegment", tail).alias("v")), "v", "c_custkey")


@query("""SELECT n_nationkey, CASE WHEN n = 1 THEN v ELSE '-' || (row_number() OVER (PARTITION BY n > 1 ORDER BY v, n_nationkey) + 1) END AS v
  FROM (SELECT n_nationkey, v, row_number() OVER (PARTITION BY v ORDER BY n_nationkey) AS n FROM (SELECT n_nationkey, chr(97 + n_nationkey % 20) || 'x' AS v FROM nation))""")
def string_suffix_unique_char2(spark, d):
    """CHAR(2): the suffix takes the whole length."""
    code = F.concat(F.substring(F.lit("abcdefghijklmnopqrst"), (F.col("n_nationkey") % 20 + 1).cast("int"), F.lit(1)), F.lit("x"))
    return unique.suffix_unique(load(spark, d)["nation"].select("n_nationkey", code.alias("v")), "v", "n_nationkey", 2)


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS slug FROM part")
def pattern_slug_names(spark, d):
    return load(spark, d)["part"].select("p_partkey", generate.slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('a', 'b') THEN p_type ELSE 'a' END AS e, CAST(least(greatest(round(p_retailprice, 1), -99.9), 99.9) AS DOUBLE) AS dec, rtrim(substr(p_name, 1, 4)) AS s FROM part")
def conform_values(spark, d):
    t = load(spark, d)["part"]
    enum, dec, text = Column("e", "ENUM", values=("a", "b")), Column("d", "DECIMAL", precision=3, scale=1), Column("s", "VARCHAR", length=4)
    return t.select("p_partkey", generate.conform(F.col("p_type"), enum).alias("e"), generate.conform(F.col("p_retailprice"), dec).cast("double").alias("dec"), generate.conform(F.col("p_name"), text).alias("s"))


@query("""SELECT '"' || CAST(r_regionkey AS VARCHAR) || '","' || replace(r_name, '"', '""') || '"' AS line FROM region""")
def csv_lines_region(spark, d):
    return csv_lines(load(spark, d, "region")["region"])


@query("SELECT CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2100 THEN 13 ELSE 1 + floor((p_retailprice - 900) / 100) END AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1")
def chart_histogram(spark, d):
    return charts.histogram(load(spark, d)["part"], "p_retailprice", 900, 2100, 12)


@query("SELECT l_returnflag AS x, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS y FROM lineitem GROUP BY l_returnflag")
def chart_series_bar(spark, d):
    return guarded_frame(spark, "SELECT l_returnflag AS x, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS y FROM lineitem GROUP BY l_returnflag", load(spark, d))


@query("SELECT CAST(o_orderdate AS TIMESTAMP) AS x, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS y, o_orderstatus AS color FROM orders GROUP BY o_orderdate, o_orderstatus")
def chart_series_frame(spark, d):
    """The points of a line chart over a guarded result with dates and decimals."""
    text = "SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderstatus"
    return charts.series_frame(charts.ChartSpec("line", "day", "total", "o_orderstatus"), guarded_frame(spark, text, load(spark, d)))


@query("SELECT p_partkey, trim(regexp_replace('  ' || replace(p_name, ' ', chr(9) || ' ') || chr(10), '\\s+', ' ', 'g')) AS name FROM part")
def string_squeeze(spark, d):
    messy = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("\t ")), F.lit("\n"))
    return load(spark, d)["part"].select("p_partkey", generate.squeeze(messy).alias("name"))


@query(f"""SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(1 + floor({_u('part', 'p_size', 'p_partkey', 7000)} * 5) AS INTEGER) ELSE p_size END AS p_size,
  CASE CAST(floor({_u('part', 'p_brand', 'p_partkey', 7001)} * 3) AS INTEGER) WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS p_brand, CASE WHEN p_retailprice > 1500 THEN 'dear' ELSE p_type END AS p_type FROM part""")
def edit_apply_three_operations(spark, d):
    """Numbers drawn anew, a pool exchanged and values set, as one checked edit."""
    ops = [
        edit.Op("regenerate_column", {"column": "p_size", "recipe": generate.Recipe("int_range", {"lo": 1, "hi": 5}), "where": "p_size < 10"}),
        edit.Op("update_pool", {"column": "p_brand", "values": ["red", "green", "blue"]}),
        edit.Op("set_values", {"column": "p_type", "value": "dear", "where": "p_retailprice > 1500"}),
    ]
    after, _ = edit.apply(SCHEMA, load(spark, d), "part", ops, seed=7)
    return after["part"].select("p_partkey", "p_size", "p_brand", "p_type")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def events_json_prop_counts(spark, d):
    return load(spark, d, "events")["events"].groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed_counts(spark, d):
    from .streaming.incremental import windowed_counts

    return windowed_counts(load(spark, d, "events")["events"], "ts", "event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
