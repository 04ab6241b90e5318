"""The whole way from DDL to checked tables, text pools, and checks of rows that arrive as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.engine import WordPools, build, fill_pools
from ledgerloom.operators import generate
from ledgerloom.operators.plan_check import Override
from ledgerloom.operators.recipes import Recipe
from ledgerloom.plans.schema import DDLParseError, parse_ddl
from ledgerloom.streaming.checks import accepted, dangling_rows, first_of_keys, repeated_keys

DDL = """
CREATE TABLE goods (id INT PRIMARY KEY, label VARCHAR(12) UNIQUE NOT NULL, price DECIMAL(7, 2) NOT NULL CHECK (price >= 2 AND price <= 90), listed_start DATE NOT NULL, listed_end DATE);
CREATE TABLE sales (id INT PRIMARY KEY, goods_id INT NOT NULL REFERENCES goods, quantity INT NOT NULL, line_total DECIMAL(12, 2), sold DATE NOT NULL);
"""


def test_build(spark):
    steps = []
    asked = [Override("goods", "label", "pool", {"brief": "names of goods", "unique": True}), Override("sales", "sold", "date", {"after": "parent(goods_id).listed_start", "min": 2, "max": 9}), Override("sales", "goods_id", "constant", {"value": 1})]
    made = build(spark, DDL, {"goods": 30, "sales": 50}, seed=4, overrides=asked, progress=steps.append)
    assert made.report.ok, made.report.summary()
    assert steps == ["parse", "plan", "pools", "rows", "check"] == list(made.seconds)
    assert made.report.rows == {"goods": 30, "sales": 50} and any("keys stay" in n for n in made.notes)
    labels = [r["label"] for r in made.tables["goods"].collect()]
    assert len(set(labels)) == 30 and all(" " in x for x in labels)
    both = made.tables["sales"].join(made.tables["goods"].withColumnRenamed("id", "goods_id"), "goods_id")
    assert both.where("sold < least(date_add(listed_start, 2), DATE'2026-08-25') OR abs(line_total - quantity * price) > 0.011").count() == 0
    again = build(spark, DDL, {"goods": 30, "sales": 50}, seed=4, overrides=asked)
    assert sorted(map(tuple, again.tables["sales"].collect())) == sorted(map(tuple, made.tables["sales"].collect()))
    with pytest.raises(DDLParseError):
        build(spark, "CREATE VIEW x")


def test_pools_fall_back():
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, a VARCHAR(6), b TEXT, c TEXT)")
    plans = generate.plan(s, 500)
    plans["t"].columns.update({c: Recipe("pool", {"brief": c}) for c in "abc"})

    class Client:
        asked = []

        def texts(self, brief, count):
            self.asked.append((brief, count))
            if brief == "c":
                raise RuntimeError("no answer")
            return [" one ", "one", "", "far too long"] if brief == "a" else []

    out, notes = fill_pools(plans, s, Client())
    assert out["t"].columns["a"].args["values"] == ["one"] and [out["t"].columns[c].kind for c in "bc"] == ["pattern", "pattern"]
    assert Client.asked == [("a", 200), ("b", 200), ("c", 200)] and len(notes) == 3 and "no answer" in notes[1]
    texts = WordPools().texts("x", 150)
    assert len(set(texts)) == 150 and texts == WordPools().texts("x", 150)


def test_a_stream_is_checked_as_a_batch(spark, tmp_path):
    s = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE e (id INT PRIMARY KEY, p_id INT REFERENCES p, kind ENUM('a', 'b') NOT NULL, ts TIMESTAMP NOT NULL)")
    start = dt.datetime(2026, 1, 1)
    rows = [(i % 90 if i % 17 else None, i % 12, "ab?"[i % 3 if i % 5 == 0 else i % 2], start + dt.timedelta(seconds=20 * i)) for i in range(120)]
    schema = "id int, p_id int, kind string, ts timestamp"
    for k in range(2):  # two files, read one after the other
        spark.createDataFrame(rows[60 * k : 60 * k + 60], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    parents, table = {"p": spark.range(10).select(F.col("id").cast("int").alias("id"))}, s.table("e")
    batch = spark.createDataFrame(rows, schema)
    closing = spark.createDataFrame([(999, 1, "a", start + dt.timedelta(days=1))], schema)  # moves the watermark on
    closing.coalesce(1).write.parquet(f"{tmp_path}/in/2")

    def streamed(check, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        run = check(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).outputMode("append").start()
        run.awaitTermination()
        return sorted((tuple(r) for r in spark.table(name).collect() if r[0] != 999), key=repr)

    def same(check, name):
        want = sorted(map(tuple, check(batch).collect()), key=repr)
        assert want and streamed(check, name) == want
        return want

    same(lambda x: dangling_rows(x, parents, table), "dangling")
    same(lambda x: accepted(x, parents, table), "good")
    firsts = same(lambda x: first_of_keys(x, ("id",), "ts", "1 hour").select("id"), "firsts")
    assert len([f for f in firsts if f[0] is not None]) == len({r[0] for r in rows} - {None}) and firsts.count((None,)) == sum(r[0] is None for r in rows)
    same(lambda x: repeated_keys(x, ("p_id",), "ts", "30 minutes").select("p_id", "start", "n"), "repeats")
