"""The scan of a schema: keys in their own types, text keys that refer to numbers, keys of two columns."""

from ledgerloom.operators.validate import scan, validate
from ledgerloom.plans.schema import parse_ddl

DDL = """
CREATE TABLE a (id INT PRIMARY KEY, code VARCHAR(5) UNIQUE);
CREATE TABLE b (x INT, y VARCHAR(5) REFERENCES a (code), z INT REFERENCES a, PRIMARY KEY (x, y))
"""


def test_keys_are_grouped_in_their_types(spark):
    schema = parse_ddl(DDL)
    a = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (3, None)], "id int, code string")
    b = spark.createDataFrame([(1, "p", "01"), (1, "p", " 2"), (1, "q", "7"), (1, "q", "7"), (1, "q", "x"), (2, "r", None), (None, None, "2")], "x int, y string, z string")
    issues = {(i["table"], i["column"], i["rule"]): (i["violations"], i["examples"]) for i in validate(schema, {"a": a, "b": b}).issues}
    assert issues.pop(("b", "z", "type")) == (1, ["x"])
    assert {k: v for k, v in issues.items() if k[2] != "not_null"} == {
        ("a", "id", "pk_duplicate"): (1, ["3"]),
        ("b", "x, y", "pk_duplicate"): (3, ["1, p", "1, q"]),
        ("b", "y", "fk_dangling"): (1, ["r"]),
        ("b", "z", "fk_dangling"): (3, ["7", "x"]),
    }
    # rows that break no rule are not taken apart: whole numbers are grouped as such, not as texts beside their tag
    plan = scan(schema, {"a": a, "b": b.withColumn("z", b["z"].try_cast("int"))})._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("Aggregate ", 1)[1] for line in plan.splitlines() if "Aggregate [" in line]
    assert any(g.startswith("[k0#") for g in grouped) and any(g.startswith("[k0#") and ", k1#" in g.split("]")[0] for g in grouped)
