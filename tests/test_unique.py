"""Unique columns and sets, distinct draws, exact weights, refused conversions."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import generate, unique
from ledgerloom.operators.plan_check import Override, merge, plan_faults
from ledgerloom.operators.recipes import Recipe
from ledgerloom.operators.validate import validate
from ledgerloom.plans.schema import parse_ddl


def suffixed(rows, length=None):
    """By search, one row after the other: of a value's occurrences the first keeps it. Only for values that fit uncut."""
    first, out = {}, {}
    for i, v in rows:
        if v is not None:
            first.setdefault(v, i)
    taken = set(first)
    for i, v in sorted(rows, key=lambda r: (r[1] or "", r[0])):
        if v is None or first[v] == i:
            out[i] = v
            continue
        local, at, host = v.partition("@") if "@" in v and " " not in v else (v, "", "")
        out[i] = next(x for k in itertools.count(2) if (x := f"{local}-{k}{at}{host}") not in taken)
        taken.add(out[i])
    return out


VALUES = ["a", "a", "a-2", "a", "a-2", "x@y", "x@y", None, None, "a b@c", "a b@c", "a-3-2", "a-2", "a-02", "a-02", "a--2", "-2", "-2", "x-3@y", "x@y", "", ""]


@pytest.mark.parametrize("per_task", [10**6, 3])
def test_suffixes_take_the_free_numbers(spark, per_task):
    rows = list(enumerate(VALUES))
    df = spark.createDataFrame(rows, "id int, v string").withColumn("other", F.col("id") * 2)
    got = unique.suffix_unique(df, "v", "id", per_task=per_task)
    assert got.columns == df.columns
    assert {r["id"]: r["v"] for r in got.collect()} == suffixed(rows)


def test_cut_values_share_their_numbers(spark):
    rows = [(i, ["abcd", "abce", "ab", "abcd@x"][i % 4]) for i in range(300)]
    got = {r["id"]: r["v"] for r in unique.suffix_unique(spark.createDataFrame(rows, "id int, v string"), "v", "id", 6).collect()}
    assert len(set(got.values())) == 300 and max(map(len, got.values())) <= 6 and [got[i] for i in range(4)] == [v for _, v in rows[:4]]
    assert all(v.endswith("@x") and len(v) > 4 for i, v in got.items() if i % 4 == 3)  # a part of the name is left


@pytest.mark.parametrize(("letters", "rows", "length"), [("abc", 24, 1), ("abc", 6, 1), ("a", 10, 2)])
def test_too_few_values(spark, letters, rows, length):
    df = spark.createDataFrame([(i, (letters[i % len(letters)] * length)) for i in range(rows)], "id int, v string")
    with pytest.raises(unique.Exhausted):
        unique.suffix_unique(df, "v", "id", length)


@pytest.mark.parametrize("per_task", [10**6, 7])
def test_sets_are_repaired_within_families(spark, per_task):
    rows = [(i, i % 4 if i % 11 else None, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = unique.set_unique(df, ["a", "b"], "id", 10, F.col("b"), lambda x, at: x.withColumn("b", F.col(at).cast("int")), per_task=per_task).collect()
    kept = {r["id"]: (r["a"], r["b"]) for r in got}
    assert len(kept) == 40 and all(kept[i] == (a, b) for i, a, b in rows if i < 11 or a is None)
    full = Counter(v for v in kept.values() if v[0] is not None)
    assert max(full.values()) == 1 and all(0 <= b < 10 for _, b in full)
    with pytest.raises(unique.Exhausted):
        unique.set_unique(df, ["a", "b"], "id", 8, F.col("b"), lambda x, at: x.withColumn("b", F.col(at).cast("int")))


def test_running_sums_over_ranges_are_those_of_windows(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).cast("int").alias("k"), (F.col("id") * 37 % 101).alias("o"), "id").withColumn("k", F.when(F.col("k") < 2, F.lit(0)).otherwise(F.lit(None)))
    one, many = (sorted(map(tuple, unique.running(df, ["k"], ["o", "id"], F.col("o"), "s", n).collect()), key=repr) for n in (10**6, 40))
    assert one == many and max(r[3] for r in one) > 10_000


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(spark, n):
    a, b = ([r[0] for r in spark.range(n).select(unique.permuted(F.col("id"), n, seed)).collect()] for seed in ("x", "y"))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 17 or a != b)


def test_generated_keys_are_unique(spark):
    s = parse_ddl(
        "CREATE TABLE p (id INT PRIMARY KEY, code CHAR(3) UNIQUE NOT NULL, n INT UNIQUE NOT NULL, color VARCHAR(20) UNIQUE NOT NULL);"
        "CREATE TABLE q (id INT PRIMARY KEY, p_id INT UNIQUE NOT NULL REFERENCES p, mail VARCHAR(14) UNIQUE);"
        "CREATE TABLE pq (p_id INT NOT NULL REFERENCES p, q_id INT NOT NULL REFERENCES q, PRIMARY KEY (p_id, q_id));"
        "CREATE TABLE r (id INT PRIMARY KEY, p_id INT NOT NULL REFERENCES p, place INT NOT NULL, note VARCHAR(30) NOT NULL, day DATE NOT NULL, UNIQUE (p_id, place), UNIQUE (p_id, note), UNIQUE (place, day))"
    )
    rows = {"p": 40, "q": 40, "pq": 150, "r": 200}
    plans = generate.plan(s, rows)
    plans["p"].columns["n"] = Recipe("int_range", {"lo": 5, "hi": 44})
    plans["p"].columns["color"] = Recipe("pool", {"values": ["red", "green", "blue"], "unique": True})
    plans["r"].columns["place"] = Recipe("int_range", {"lo": 1, "hi": 60})
    plans["r"].columns["note"] = Recipe("pattern", {"template": "{faker:city}"})
    made = generate.expand(spark, s, plans, seed=5)
    report = validate(s, made, expected_rows=rows)
    assert report.ok, report.summary(40)
    assert sorted(r["n"] for r in made["p"].collect()) == list(range(5, 45))
    assert Counter(r["color"].split("-")[0] for r in made["p"].collect()) in ({"red": 14, "green": 13, "blue": 13}, {"red": 13, "green": 14, "blue": 13}, {"red": 13, "green": 13, "blue": 14})
    for table, n in (("q", 41), ("pq", 40 * 40 + 1)):
        with pytest.raises(generate.ExpansionError):
            generate.expand(spark, s, generate.plan(s, {**rows, table: n}), seed=5)["pq"].count()


def test_zipf_places_follow_the_weights(spark):
    keys = spark.createDataFrame([(f"k{i:03}",) for i in range(50)], "k string")
    rows = spark.range(4000).select("id", ((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(r["fk"] for r in generate.sample_parent(rows, keys, ["fk"], ["k"], F.col("u"), zipf=True).collect())
    total = sum((i + 1) ** -0.8 for i in range(50))
    assert all(abs(got[f"k{i:03}"] - 4000 * (i + 1) ** -0.8 / total) <= 1 for i in range(50))


def test_values_that_cannot_be_stored(spark):
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, n INT, d DATE)")
    plans = generate.plan(s, 30)
    wrong = generate.rejected(spark.createDataFrame([("7",), ("x",), ("x",), (None,)], "v string"), F.col("v"), s.table("t").column("n"))
    assert [tuple(r) for r in wrong.collect()] == [("x", 2)]
    plans["t"].columns["n"] = Recipe("constant", {"value": "many"})
    with pytest.raises(generate.ExpansionError, match="t.n"):
        generate.expand(spark, s, plans)
    with pytest.raises(generate.ExpansionError, match="cannot store 'soon' .5 rows. in a DATE"):
        generate._refuse_rejected(spark.range(5), F.lit("soon"), "t", s.table("t").column("d"))


PLAN_DDL = """
CREATE TABLE a (id INT PRIMARY KEY, name VARCHAR(10) NOT NULL, kind ENUM('x', 'y') NOT NULL, price DECIMAL(5, 2), start_date DATE NOT NULL, end_date DATE, note TEXT);
CREATE TABLE b (id INT PRIMARY KEY, a_id INT NOT NULL REFERENCES a, n SMALLINT, total DECIMAL(9, 2), at TIMESTAMP)
"""
FAULTY = [
    ("a", "name", Recipe("int_range", {"lo": 1, "hi": 2}), "doesn't suit"), ("a", "kind", Recipe("enum", {"values": ["x", "z"]}), "aren't in the ENUM"), ("a", "name", Recipe("enum", {"values": ["x" * 11]}), "longer"),
    ("a", "name", Recipe("constant", {"value": "a"}, 0.5), "NOT NULL"), ("a", "price", Recipe("decimal_range", {"lo": 0, "hi": 1000}), "exceeds"), ("b", "n", Recipe("int_range", {"lo": 0, "hi": 40_000}), "exceeds"),
    ("a", "price", Recipe("decimal_range", {"lo": 3, "hi": 1}), "empty"), ("a", "end_date", Recipe("date", {"start": 1, "end": 2, "after": "name"}), "no such date"), ("b", "at", Recipe("datetime", {"start": 1, "end": 2, "after": "parent(a_id).name"}), "no date"),
    ("b", "at", Recipe("datetime", {"start": 1, "end": 2, "after": "parent(n).start_date"}), "no foreign key"), ("b", "total", Recipe("derived", {"expression": "nope * 2"}), "unknown column"), ("b", "total", Recipe("derived", {"expression": "parent(a_id).nope"}), "no column"),
    ("b", "total", Recipe("derived", {"expression": "import os"}), "parse"), ("a", "price", Recipe("aggregate", {"child": "b", "fk": "n", "column": "total", "agg": "sum"}), "doesn't refer"), ("a", "price", Recipe("aggregate", {"child": "b", "fk": "a_id", "column": "at", "agg": "sum"}), "numeric"),
    ("a", "price", Recipe("constant", {"value": "dear"}), "no DECIMAL"), ("a", "kind", Recipe("constant", {"value": "z"}), "ENUM"), ("a", "name", Recipe("pattern", {"template": "{col:nope}"}), "unknown column"), ("b", "a_id", Recipe("fk", {"parent": "b", "column": "id"}), "refers to a"),
    ("a", "name", Recipe("pool", {"values": []}), "no values"), ("b", "n", Recipe("derived", {"expression": "n + 1"}), None),
]


@pytest.mark.parametrize(("table", "column", "recipe", "what"), FAULTY)
def test_faults_of_a_plan(table, column, recipe, what):
    s = parse_ddl(PLAN_DDL)
    plans = generate.plan(s, 10)
    assert plan_faults(plans, s) == []
    plans[table].columns[column] = recipe
    found = plan_faults(plans, s)
    assert (found == []) if what is None else (len(found) == 1 and found[0].startswith(f"{table}.{column}: ") and what in found[0]), found


def test_cycles_and_missing_parts_of_a_plan(spark):
    s = parse_ddl(PLAN_DDL)
    plans = generate.plan(s, 10)
    plans["b"].columns.update({"n": Recipe("derived", {"expression": "total"}), "total": Recipe("derived", {"expression": "n"})})
    assert [f.split(":")[0] for f in plan_faults(plans, s)] == ["b"] and "depend on each other" in plan_faults(plans, s)[0]
    with pytest.raises(generate.ExpansionError):
        generate.expand(spark, s, plans)
    del plans["a"].columns["note"]
    del plans["b"]
    assert plan_faults(plans, s) == ["a.note: no recipe", "b: missing from the plan"]


def test_merge_of_proposals():
    s = parse_ddl(PLAN_DDL)
    base = generate.plan(s, 10)
    start = base["a"].columns["end_date"].args
    asked = [
        Override("A", "PRICE", "decimal_range", {"lo": 1, "hi": 9}), Override("a", "end_date", "date", {"min": 3}, 0.5), Override("a", "note", None, None, 0.9), Override("a", "id", "constant", {"value": 1}), Override("a", "name", None, None, 0.2),
        Override("a", "price", "decimal_range", {"lo": 1, "hi": 10**6}), Override("c", "x", "boolean"), Override("a", "x", "boolean"), Override("b", "n", "int_range", {"lo": "low", "hi": 3}), Override("b", "total", "derived", {"expression": "total + n"}), Override("b", "n", "derived", {"expression": "total"}),
    ]
    plan, notes = merge(base, asked, s, {"a": 1000, "B": 20, "z": 3}, most_rows=30)
    assert (plan["a"].rows, plan["b"].rows) == (30, 20) and base["a"].rows == 10
    assert plan["a"].columns["price"].args == {"lo": 1, "hi": 9, "distribution": "skewed_low"} and plan["a"].columns["note"].null_ratio == 0.9
    assert plan["a"].columns["end_date"] == Recipe("date", {**start, "min": 3}, 0.5)
    assert plan["b"].columns["total"].kind == "derived" and plan["b"].columns["n"].kind == "int_range"  # the later one would close a cycle
    left = [n.split(" ")[0] for n in notes if "left out" in n]
    assert left == ["rows", "a.id", "a.name", "a.price", "c.x", "a.x", "b.n", "b.n"] and notes[-1] == "4 of 11 proposals used"
    assert plan_faults(plan, s) == []
