import pytest

from ledgerloom.operators.validate import check_bounds
from ledgerloom.plans.schema import DDLEmitError, DDLParseError, UnsatisfiableSchemaError, emit_foreign_keys, emit_schema_script, emit_identity_restarts, emit_tables, parse_ddl, schema_summary, table_order


def test_both_dialects():
    s = parse_ddl("""
      CREATE TABLE `a` (id INT PRIMARY KEY AUTO_INCREMENT, e ENUM('x', 'it''s') NOT NULL COMMENT 'c', d DECIMAL(8, 3), KEY k (e));
      CREATE TABLE IF NOT EXISTS "B" ("Id" SERIAL, a_id INTEGER REFERENCES a, n CHARACTER VARYING(20) DEFAULT 'q', z POINT, PRIMARY KEY ("Id"), UNIQUE (n), CONSTRAINT c CHECK (a_id > 0));
      ALTER TABLE "B" ADD COLUMN t TIMESTAMP WITH TIME ZONE, ADD CONSTRAINT f FOREIGN KEY (a_id) REFERENCES a(id) ON DELETE SET NULL;
      CREATE INDEX i ON a (e);
    """)
    a, b = s.table("A"), s.table("b")
    assert a.column("e").values == ("x", "it's") and a.column("e").max_length == 4
    assert (a.column("d").precision, a.column("d").scale) == (8, 3)
    assert not a.column("id").nullable and a.column("id").identity
    assert b.column("n").length == 20 and b.column("z").type == "UNKNOWN" and s.notes
    assert len(b.foreign_keys) == 1 and b.foreign_keys[0].parent_columns == ("id",) and b.foreign_keys[0].on_delete == "SET NULL"
    assert len(s.ignored) == 1 and b.checks == ("a_id > 0",)
    assert [f.dataType.simpleString() for f in a.struct().fields] == ["int", "string", "decimal(8,3)"]


@pytest.mark.parametrize("ddl", ["", "SELECT 1", "CREATE TABLE t (a INT, a INT)", "CREATE TABLE t (a INT); CREATE TABLE T (b INT)", "CREATE TABLE t (a INT REFERENCES u)", "CREATE TABLE t (a INT, PRIMARY KEY (b))", "CREATE TABLE p (x INT, y INT, PRIMARY KEY (x, y)); CREATE TABLE t (a INT REFERENCES p)", "CREATE TABLE t (a INT", "ALTER TABLE t ADD COLUMN a INT", "CREATE TABLE t (a)"])
def test_errors(ddl):
    with pytest.raises(DDLParseError):
        parse_ddl(ddl)


def test_the_place_of_a_fault():
    with pytest.raises(DDLParseError) as e:
        parse_ddl("CREATE TABLE t (\n  a INT,\n  b INT NOT NUL\n)")
    assert (e.value.line, e.value.ddl.count("\n")) == (3, 3)
    lines = e.value.excerpt().split("\n")
    assert lines[:2] == ["2:   a INT,", "3:   b INT NOT NUL"] and lines[2].index("^") - 3 == e.value.column - 1 and lines[3] == "4: )"
    assert DDLParseError("the DDL is empty").excerpt() == ""


def test_identity_goes_on_behind_the_rows(spark):
    s = parse_ddl("CREATE TABLE a (id SERIAL PRIMARY KEY, n INT); CREATE TABLE b (id INT PRIMARY KEY AUTO_INCREMENT); CREATE TABLE c (id INT PRIMARY KEY)")
    tables = {"a": spark.createDataFrame([(4, 9), (7, 1)], "id int, n int"), "b": spark.createDataFrame([], "id int"), "c": spark.createDataFrame([(1,)], "id int")}
    assert emit_identity_restarts(s, tables) == ['ALTER TABLE "a" ALTER COLUMN "id" RESTART WITH 8', 'ALTER TABLE "b" ALTER COLUMN "id" RESTART WITH 1']


def test_order_and_cycles():
    s = parse_ddl("CREATE TABLE c (id INT PRIMARY KEY, b INT NOT NULL REFERENCES b, m INT REFERENCES c); CREATE TABLE b (id INT PRIMARY KEY, c INT REFERENCES c)")
    order = table_order(s)
    assert order.tables == ("b", "c") and {(t, fk.columns) for t, fk in order.deferred} == {("c", ("m",)), ("b", ("c",))}
    for bad in ("CREATE TABLE c (id INT PRIMARY KEY, m INT NOT NULL REFERENCES c)", "CREATE TABLE a (id INT PRIMARY KEY, b INT NOT NULL REFERENCES b); CREATE TABLE b (id INT PRIMARY KEY, a INT NOT NULL REFERENCES a)"):
        with pytest.raises(UnsatisfiableSchemaError):
            table_order(parse_ddl(bad))


def test_emit_round_trip():
    s = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY, e ENUM('a','b')); CREATE TABLE q (id INT PRIMARY KEY, p_id INT NOT NULL REFERENCES p ON DELETE CASCADE, u VARCHAR(9) UNIQUE)")
    again = parse_ddl(emit_schema_script(s))
    assert [t.name for t in again.tables] == ["p", "q"] and again.table("q").foreign_keys[0].on_delete == "CASCADE"
    assert 'CHECK ("e" IN (\'a\', \'b\'))' in emit_tables(s)[0] and len(emit_foreign_keys(s)) == 1
    assert "p_id integer [not null, -> p.id]" in schema_summary(s)
    with pytest.raises(DDLEmitError):
        emit_tables(parse_ddl('CREATE TABLE t ("A" INT, b INT); CREATE TABLE u (c INT)').__class__((parse_ddl("CREATE TABLE t (a INT)").tables[0], parse_ddl('CREATE TABLE "T" (a INT)').tables[0])))


@pytest.mark.parametrize(("check", "bounds"), [("r >= 1 AND r <= 5", (1, 5, None)), ("r BETWEEN 2 AND 9", (2, 9, None)), ("r > 1 AND r < 5", (2, 4, None)), ("5 >= r", (None, 5, None)), ("r IN ('a', 'b')", (None, None, ["a", "b"])), ("r > 1.5", (1.5, None, None))])
def test_bounds(check, bounds):
    assert check_bounds(check, "r") == bounds
