import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import charts, consistency, edit, generate
from ledgerloom.operators.validate import validate
from ledgerloom.plans.guard import SqlError, SqlRejected, Tools, guard, guarded_frame, run_readonly
from ledgerloom.plans.schema import parse_ddl
from ledgerloom.queries import RESTAURANT_DDL
from ledgerloom.sources.csvio import CsvFormatError, csv_lines, read_csv, write_csv, write_zip
from ledgerloom.sources.registry import Dataset, DatasetNotFound, Registry
from ledgerloom.streaming.incremental import broken_rows


@pytest.fixture(scope="module")
def schema():
    return parse_ddl(RESTAURANT_DDL)


@pytest.fixture(scope="module")
def data(spark, schema):
    made = generate.expand(spark, schema, generate.plan(schema, {"places": 8, "guests": 30, "dishes": 20, "bills": 40, "bill_items": 80}), seed=3)
    return {k: spark.createDataFrame(v.collect(), v.schema) for k, v in made.items()}


def test_generated_is_valid_and_repeatable(spark, schema, data):
    report = validate(schema, data, expected_rows={"places": 8, "bill_items": 80})
    assert report.ok, report.summary()
    plans = generate.plan(schema, {"places": 8, "guests": 30, "dishes": 20, "bills": 40, "bill_items": 80})
    again, other = (generate.expand(spark, schema, plans, seed=s)["guests"].collect() for s in (3, 4))
    assert again == data["guests"].collect() != other
    assert consistency.derived_mismatches(data["bill_items"], "subtotal", "quantity * parent(dish_id).price", {"dish_id": (data["dishes"], "dish_id")}).count() == 0
    assert consistency.aggregate_mismatches(data["bills"], "bill_id", "total_amount", data["bill_items"], "bill_id", "subtotal", "sum").count() == 0


def test_one_issue_for_each_break(spark, schema, data):
    def broken(table, column, value):
        df = data[table]
        key = schema.table(table).primary_key[0]
        return {**data, table: df.withColumn(column, F.when(F.col(key) == 3, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))}

    for table, column, value, rule in (("places", "kind", "Moon", "enum"), ("guests", "first_name", None, "not_null"), ("guests", "last_name", "x" * 41, "varchar_length"), ("bill_items", "quantity", 77, "check"), ("bill_items", "dish_id", 999, "fk_dangling")):
        issues = validate(schema, broken(table, column, value)).issues
        assert [(i["table"], i["rule"], i["violations"]) for i in issues] == [(table, rule, 1)]
    twice = {**data, "places": data["places"].union(data["places"].where("place_id = 1"))}
    assert [i["rule"] for i in validate(schema, twice).issues] == ["pk_duplicate"]
    assert [i["rule"] for i in validate(schema, {k: v for k, v in data.items() if k != "bill_items"}).issues] == ["missing_table"]
    assert [i["rule"] for i in validate(schema, {**data, "places": data["places"].drop("rating")}).issues] == ["columns_mismatch"]


def test_text_rules_and_checks(spark):
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, p DECIMAL(4, 2), ok BOOLEAN, d DATE, a INT, b INT, CHECK (b >= a), CHECK (LENGTH(ok) > 2))")
    df = spark.createDataFrame([("1", "1.234", "yes", "2024-02-30", 1, 0), ("x", "123", "true", "2024-02-29", 1, None), ("3", "z", None, None, 1, 2)], "id string, p string, ok string, d string, a int, b int")
    r = validate(s, {"t": df})
    assert {(i["column"], i["rule"]): i["violations"] for i in r.issues} == {("id", "type"): 1, ("p", "decimal_scale"): 1, ("p", "type"): 1, ("p", "decimal_precision"): 1, ("ok", "type"): 1, ("d", "date_invalid"): 1, ("b, a", "check"): 1}
    assert len(r.notes) == 1 and broken_rows(df, s.table("t")).count() == 3


def test_edits(spark, schema, data):
    before = {k: v.count() for k, v in data.items()}
    out, report = edit.apply(schema, data, "dishes", [edit.Op("set_values", {"column": "price", "value": 5, "where": "price > 20"}), edit.Op("add_rows", {"count": 4, "recipes": {"name": generate.Recipe("constant", {"value": "soup"}), "price": generate.Recipe("constant", {"value": 3})}})])
    assert report.ok and out["dishes"].count() == before["dishes"] + 4 and out["dishes"].where("price > 20").count() == 0
    assert {k: v.count() for k, v in data.items()} == before
    bills = data["bills"].where("guest_id = 1").count()
    items = data["bill_items"].join(data["bills"].where("guest_id = 1"), "bill_id", "left_semi").count()
    out, report = edit.apply(schema, data, "guests", [edit.Op("delete_rows", {"where": "guest_id == 1"})])
    assert report.ok and (before["bills"] - out["bills"].count(), before["bill_items"] - out["bill_items"].count()) == (bills, items)
    if bills:
        with pytest.raises(edit.EditError):
            edit.apply(schema, data, "guests", [edit.Op("delete_rows", {"where": "guest_id == 1", "cascade": False})])
    for op in (edit.Op("set_values", {"column": "nope", "value": 1}), edit.Op("set_values", {"column": "guest_id", "value": 1}), edit.Op("set_values", {"column": "first_name", "value": None}), edit.Op("add_rows", {"count": 0}), edit.Op("update_pool", {"column": "first_name", "values": []}), edit.Op("drop", {})):
        with pytest.raises(edit.EditError):
            edit.apply(schema, data, "guests", [op])


def test_self_reference_cascades(spark):
    s = parse_ddl("CREATE TABLE e (id INT PRIMARY KEY, boss INT REFERENCES e)")
    t = {"e": spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, boss int")}
    out, _ = edit.apply(s, t, "e", [edit.Op("delete_rows", {"where": "id == 1"})])
    assert sorted(map(tuple, out["e"].collect())) == [(2, None), (3, 2)]


def test_edits_refresh_derived_and_totals(spark):
    s = parse_ddl("CREATE TABLE a (id INT PRIMARY KEY, total DECIMAL(9, 2), twice DECIMAL(9, 2)); CREATE TABLE b (id INT PRIMARY KEY, a_id INT NOT NULL REFERENCES a, n INT, price DECIMAL(9, 2))")
    tables = {"a": spark.createDataFrame([(1, 0, 0), (2, 9, 9)], "id int, total int, twice int"), "b": spark.createDataFrame([(1, 1, 2, 0), (2, 1, 3, 0), (3, 2, 1, 7)], "id int, a_id int, n int, price int")}
    plans = {"a": {"total": generate.Recipe("aggregate", {"child": "b", "fk": "a_id", "column": "price", "agg": "sum"}), "twice": generate.Recipe("derived", {"expression": "total * 2"})}, "b": {"price": generate.Recipe("derived", {"expression": "n * 10"})}}
    out, _ = edit.apply(s, tables, "b", [edit.Op("set_values", {"column": "n", "value": 5, "where": "id == 2"})], plans=plans)
    assert sorted((r["id"], float(r["total"]), float(r["twice"])) for r in out["a"].collect()) == [(1, 70, 140), (2, 10, 20)]
    out, _ = edit.apply(s, tables, "b", [edit.Op("delete_rows", {"where": "a_id == 1"}), edit.Op("add_rows", {"count": 2, "recipes": {"n": generate.Recipe("constant", {"value": 4})}})], plans=plans, seed=3)
    assert sum(float(r["total"]) for r in out["a"].collect()) == 10 + 2 * 40


def test_ranks_by_ranges_and_own_keys(spark):
    keys = spark.range(0, 500).select((F.col("id") * 37 % 1009).alias("__k0"))
    assert sorted(map(tuple, generate.ranked(keys, ["__k0"], 500, 60).select("__k0", "__rank").collect())) == [(k, i) for i, k in enumerate(sorted(i * 37 % 1009 for i in range(500)))]
    rows = spark.range(1, 8).withColumnRenamed("id", "k")
    got = generate.sample_parent(rows, rows, ["boss"], ["k"], (F.col("k") - 0.5) / 7, own_key="k").collect()  # each draws itself
    assert sorted((r["k"], r["boss"]) for r in got) == [(k, k % 7 + 1) for k in range(1, 8)]
    one = rows.where("k = 1")
    assert generate.sample_parent(one, one, ["boss"], ["k"], F.lit(0.3), own_key="k").first()["boss"] is None
    assert spark.range(1).select(generate.slug(F.lit("Čapek Ștefan-Łódź Ế"))).first()[0] == "capekstefanodze"


ALLOWED = ["SELECT * FROM guests", "WITH a AS (SELECT 1 AS x FROM guests) SELECT * FROM a", "SELECT 1 AS x UNION SELECT 2", "SELECT guest_id FROM guests ORDER BY 1 LIMIT 3;"]
REJECTED = ["", "DROP TABLE guests", "INSERT INTO guests SELECT 1", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "SHOW TABLES", "SET a = 1", "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT * FROM parquet.`/tmp/x`", "SELECT TRANSFORM (guest_id) USING 'cat' FROM guests", "WITH a AS (SELECT java_method('java.lang.Math', 'abs', 1)) SELECT * FROM a", "SELECT (SELECT try_reflect('java.lang.Math', 'abs', 1))", "SELECT * FROM other", "SELECT 1 WHERE EXISTS (SELECT 1 FROM parquet.`/x`)"]


def test_delete_goes_by_foreign_key(spark):
    s = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (a INT, b INT, pid INT NOT NULL REFERENCES p, PRIMARY KEY (a, b))")
    t = {"p": spark.createDataFrame([(1,), (2,)], "id int"), "c": spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1)], "a int, b int, pid int")}
    out, removed = edit.delete_rows(s, t, "p", t["p"].where("id = 1"))
    assert list(map(tuple, out["c"].collect())) == [(1, 1, 2)] and removed["c"].count() == 2


def test_suffixes_meet_no_other_value(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-2"), (6, "x@y"), (7, "x@y"), (8, None), (9, None)]
    got = {r["id"]: r["v"] for r in generate.suffix_unique(spark.createDataFrame(rows, "id int, v string"), "v", "id").collect()}
    set_values = [v for v in got.values() if v is not None]
    assert len(set_values) == len(set(set_values)) == 7 and got[1] == "a" and got[3] == "a-2" and got[7] == "x-2@y" and got[8] is None


PROBED = [
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis')", "SELECT * FROM IDENTIFIER('parquet.`/tmp/x`')", "SELECT * FROM IDENTIFIER('guests')", "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret)",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "SELECT IDENTIFIER('guest_id') FROM guests",
]
KNOWN = [
    "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b JOIN guests ON true", "SELECT * FROM guests WHERE guest_id IN (SELECT guest_id FROM guests)", "SELECT kind, count(*) FROM places GROUP BY ROLLUP (kind) HAVING count(*) > 0",
    "SELECT *, rank() OVER w FROM guests WINDOW w AS (ORDER BY guest_id)", "SELECT * FROM (VALUES (1), (2)) AS v(x)", "SELECT * FROM guests LATERAL VIEW explode(array(1, 2)) e AS y", "(SELECT guest_id FROM guests) INTERSECT (SELECT guest_id FROM guests)",
    "SELECT * FROM guests, LATERAL (SELECT guest_id + 1 AS z)", "SELECT * FROM range(3)", "SELECT (SELECT max(guest_id) FROM guests) AS m",
]


@pytest.mark.parametrize("sql", PROBED)
def test_guard_rejects_names_that_are_made(spark, data, sql):
    with pytest.raises(SqlRejected):
        guard(spark, sql, tables=set(data))


@pytest.mark.parametrize("sql", KNOWN)
def test_guard_accepts_forms_of_select(spark, data, sql):
    guard(spark, sql, tables=set(data))


SHOWN = ["SELECT current_user", "SELECT current_user() AS u", "SELECT guest_id FROM guests WHERE first_name = current_database", "SELECT (SELECT current_catalog)", "SELECT user FROM guests", "SELECT * FROM sql_keywords()", "SELECT max(session_user) FROM guests"]


@pytest.mark.parametrize("sql", SHOWN)
def test_guard_shows_nothing_of_the_session(spark, data, sql):
    with pytest.raises((SqlRejected, SqlError)):
        run_readonly(spark, sql, data)


def test_names_are_those_of_the_data_set_only_while_analysed(spark, data):
    spark.range(3).createOrReplaceTempView("guests")
    one = guarded_frame(spark, "SELECT count(*) AS n FROM guests", data)
    two = guarded_frame(spark, "SELECT count(*) AS n FROM guests", {"guests": data["guests"].limit(2)})
    assert (one.first()[0], two.first()[0], spark.table("guests").count()) == (30, 2, 3)
    spark.catalog.dropTempView("guests")
    user = spark.createDataFrame([("me",)], "user string")  # a column may have the name
    assert guarded_frame(spark, "SELECT user FROM t", {"t": user}).first()[0] == "me"
    assert not spark.catalog.tableExists("t")


def test_guard(spark, data):
    for sql in ALLOWED:
        guard(spark, sql, tables=set(data))
    for sql in REJECTED:
        with pytest.raises(SqlRejected):
            guard(spark, sql, tables=set(data))
    r = run_readonly(spark, "SELECT guest_id FROM guests ORDER BY guest_id", data, limit=5)
    assert r.truncated and [x[0] for x in r.rows] == [1, 2, 3, 4, 5]
    with pytest.raises(SqlError) as e:
        run_readonly(spark, "SELECT nope FROM guests", data)
    assert e.value.sqlstate == "42703"


def test_tools_and_charts(spark, data):
    tools = Tools(spark, data)
    assert "error" in tools.dispatch("render_chart", {"kind": "bar", "x": "kind", "y": "n"})
    assert tools.dispatch("run_sql", {"sql": "SELECT kind, count(*) AS n FROM places GROUP BY kind"})["row_count"] >= 1
    assert tools.dispatch("render_chart", {"kind": "bar", "x": "kind", "y": "n"})["points"] >= 1
    for spec in (charts.ChartSpec("bar", "q", "n"), charts.ChartSpec("bar", "kind"), charts.ChartSpec("bar", "n", "kind"), charts.ChartSpec("cloud", "kind", "n")):
        with pytest.raises(charts.ChartSpecError):
            charts.series(spec, ["kind", "n"], [("a", 1)])
    assert [p["x"] for p in charts.series(charts.ChartSpec("line", "x", "y"), ["x", "y"], [(2, 1), (1, 1)])] == [1, 2]


def test_csv_round_trip(spark, tmp_path):
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, price DECIMAL(10,2), ok BOOLEAN, d DATE, ts DATETIME, note VARCHAR(50), ratio FLOAT)")
    t = s.table("t")
    rows = [(1, 12.5, True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 13, 45, 7), 'say "hi", ok', 0.5), (-2, None, False, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, price double, ok boolean, d date, ts timestamp_ntz, note string, ratio double").withColumn("price", F.col("price").cast("decimal(10,2)"))
    assert sorted(r["line"] for r in csv_lines(df).collect()) == ['"-2",,"false",,,,', '"1","12.50","true","2024-02-29","2024-01-02 13:45:07","say ""hi"", ok","0.5"']
    write_csv(df.coalesce(1), str(tmp_path / "t"), t.names)
    back = read_csv(spark, str(tmp_path / "t"), t)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(CsvFormatError):
        read_csv(spark, str(tmp_path / "t"), parse_ddl("CREATE TABLE t (a INT)").table("t"))
    for name, frame in (("many", spark.range(40, numPartitions=8).select(F.col("id").cast("int").alias("id"))), ("none", df.select("id").limit(0))):
        one = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY)").table("t")
        write_csv(frame, str(tmp_path / name), ["id"])
        assert sorted(r["id"] for r in read_csv(spark, str(tmp_path / name), one).collect()) == sorted(r["id"] for r in frame.collect())
    write_zip({"t": df}, s, "ddl", {"n": 1}, str(tmp_path / "x.zip"))
    assert sorted(zipfile.ZipFile(tmp_path / "x.zip").namelist()) == ["manifest.json", "schema.ddl", "t.csv"]


def test_registry(spark, schema, data, tmp_path):
    reg = Registry(spark, tmp_path / "sets")
    ds = Dataset("demo", RESTAURANT_DDL, data)
    reg.save(ds)
    reg.save(ds)
    back = reg.load(ds.id)
    assert {k: v.count() for k, v in back.tables.items()} == {k: v.count() for k, v in data.items()}
    assert [m["id"] for m in reg.list()] == [ds.id] and reg.load_schema(ds.id).has("bills")
    for bad in ("../../etc", "aaaaaaaaaaaa"):
        with pytest.raises(DatasetNotFound):
            reg.info(bad)
    assert reg.delete(ds.id) and not reg.delete(ds.id)


def test_empty_parent_and_unique_exhaustion(spark):
    s = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, p_id INT NOT NULL REFERENCES p)")
    with pytest.raises(generate.ExpansionError):
        generate.expand(spark, s, generate.plan(s, {"p": 0, "c": 3}))
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, code CHAR(1) UNIQUE NOT NULL)")
    with pytest.raises(generate.ExpansionError):
        generate.expand(spark, s, generate.plan(s, 100))
