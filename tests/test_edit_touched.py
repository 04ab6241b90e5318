"""Edits that compute only touched rows again give the tables that whole columns computed again give."""

import pytest

from ledgerloom.operators import edit
from ledgerloom.operators.generate import Recipe, conform
from ledgerloom.plans.schema import parse_ddl
from ledgerloom.sources.csvio import read_csv

DDL = """
CREATE TABLE clubs (id INT PRIMARY KEY, members INT, dues DOUBLE PRECISION, doubled DOUBLE PRECISION);
CREATE TABLE people (id INT PRIMARY KEY, club_id INT REFERENCES clubs, rate DOUBLE PRECISION, paid DOUBLE PRECISION);
CREATE TABLE bills (id INT PRIMARY KEY, person_id INT NOT NULL REFERENCES people, hours INT, price DOUBLE PRECISION);
CREATE TABLE halls (id INT PRIMARY KEY, size INT, twice INT)
"""
PLANS = {
    "clubs": {
        "members": Recipe("aggregate", {"child": "people", "fk": "club_id", "column": None, "agg": "count"}),
        "dues": Recipe("aggregate", {"child": "people", "fk": "club_id", "column": "paid", "agg": "sum"}),
        "doubled": Recipe("derived", {"expression": "dues * 2"}),
    },
    "people": {"paid": Recipe("aggregate", {"child": "bills", "fk": "person_id", "column": "price", "agg": "sum"})},
    "bills": {"price": Recipe("derived", {"expression": "hours * parent(person_id).rate"})},
    "halls": {"twice": Recipe("derived", {"expression": "size * 2"})},
}


@pytest.fixture(scope="module")
def world(spark):
    schema = parse_ddl(DDL)
    tables = {
        "clubs": spark.createDataFrame([(i, 0, 0.0, 0.0) for i in range(1, 5)], "id int, members int, dues double, doubled double"),
        "people": spark.createDataFrame([(i, i % 4 or None, float(i), 0.0) for i in range(1, 13)], "id int, club_id int, rate double, paid double"),
        "bills": spark.createDataFrame([(i, i % 11 + 1, i % 5, 0.0) for i in range(1, 41)], "id int, person_id int, hours int, price double"),
        "halls": spark.createDataFrame([(1, 4, 8)], "id int, size int, twice int"),
    }
    return schema, edit.refresh(schema, tables, PLANS)


@pytest.mark.parametrize(
    ("table", "ops"),
    [
        ("people", [edit.Op("set_values", {"column": "rate", "value": 100, "where": "id == 3"})]),
        ("bills", [edit.Op("delete_rows", {"where": "hours == 2"}), edit.Op("add_rows", {"count": 3, "recipes": {"hours": Recipe("constant", {"value": 4})}})]),
        ("clubs", [edit.Op("delete_rows", {"where": "id == 2"}), edit.Op("add_rows", {"count": 1})]),
        ("bills", [edit.Op("set_values", {"column": "hours", "value": None, "where": "id == 7"})]),
        ("bills", [edit.Op("set_values", {"column": "hours", "value": 1, "where": "id == 999"})]),
    ],
)
def test_touched_rows_give_what_whole_columns_give(world, table, ops):
    schema, tables = world
    whole, _ = edit.apply(schema, tables, table, ops, plans=PLANS, seed=5)
    delta, _ = edit.apply(schema, tables, table, ops, plans=PLANS, seed=5, delta=True)
    for name in tables:
        assert sorted(map(tuple, delta[name].collect()), key=str) == sorted(map(tuple, whole[name].collect()), key=str), name
    assert delta["halls"] is tables["halls"]


def test_only_touched_parents_are_computed(world):
    schema, tables = world
    stale = {**tables, "people": tables["people"].withColumn("paid", tables["people"]["paid"] + 1000)}
    ops = [edit.Op("set_values", {"column": "hours", "value": 9, "where": "id == 1"})]  # a bill of person 2
    out, _ = edit.apply(schema, stale, "bills", ops, plans=PLANS, delta=True)
    paid = {r["id"]: r["paid"] for r in out["people"].collect()}
    assert paid[2] < 1000 and all(v >= 1000 for i, v in paid.items() if i != 2)
    assert "LeftSemi" in out["people"]._jdf.queryExecution().optimizedPlan().toString()


def test_boolean_texts_are_read(spark, tmp_path):
    table = parse_ddl("CREATE TABLE flags (id INT PRIMARY KEY, on_ BOOLEAN)").table("flags")
    texts = ["true", "T", "1", "yes", "Y", "false", "f", "0", "No", "n", ""]
    (tmp_path / "flags.csv").write_text("id,on_\n" + "".join(f"{i},{x}\n" for i, x in enumerate(texts)))
    got = [r["on_"] for r in read_csv(spark, str(tmp_path / "flags.csv"), table).orderBy("id").collect()]
    assert got == [True] * 5 + [False] * 5 + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, on_ string").orderBy("id")
    assert [r[0] for r in rows.where("on_ <> ''").select(conform(rows["on_"], table.column("on_"))).collect()] == got[:-1]
    (tmp_path / "bad.csv").write_text("id,on_\n1,maybe\n")
    with pytest.raises(Exception, match="no boolean: maybe"):
        read_csv(spark, str(tmp_path / "bad.csv"), table).collect()
