"""Edits from words, their history, the question loop and points of charts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import charts, edit
from ledgerloom.operators.drafts import History, check_filter, draft
from ledgerloom.plans.agent import Agent, Call, Reply
from ledgerloom.plans.guard import Tools
from ledgerloom.plans.schema import parse_ddl

SCHEMA = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, n INT, kind ENUM('a', 'b') NOT NULL)")


class Scripted:
    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def propose(self, request, schema, fault):
        self.seen.append(fault)
        return self.replies.pop(0)

    def reply(self, messages):
        self.seen.append(messages)
        return self.replies.pop(0)


def test_a_draft_is_corrected_once():
    good = [{"op": "set_values", "args": {"column": "n", "value": 1, "where": "n > 5"}}]
    for bad in ([{"op": "drop"}], [], ["x"], [{"op": "set_values", "args": {"column": "nope", "value": 1}}], [{"op": "set_values", "args": {"column": "n", "value": 1}}], [{"op": "set_values", "args": {"column": "n", "value": 1, "where": "n >"}}]):
        writer = Scripted(bad, good)
        assert [o.op for o in draft(writer, "set n to 1 where it is more than 5", SCHEMA, "t")] == ["set_values"]
        assert writer.seen[0] is None and writer.seen[1]
        with pytest.raises(edit.EditError):
            draft(Scripted(bad, bad), "set n to 1 where it is more than 5", SCHEMA, "t")


def test_requests_that_choose_rows_need_a_filter():
    every = [edit.Op("delete_rows", {})]
    with pytest.raises(edit.EditError, match="unless"):
        check_filter("delete them unless they are new", every)
    check_filter("delete everything", every)
    check_filter("delete old ones, if any", [edit.Op("delete_rows", {"where": "n > 3"})])
    check_filter("add five after the others", [*every, edit.Op("add_rows", {"count": 5})])


def test_history_can_be_replayed(spark):
    start = {"t": spark.createDataFrame([(i, i, "a") for i in range(1, 7)], "id int, n int, kind string")}
    h = History(SCHEMA, start)
    assert h.do("t", [edit.Op("set_values", {"column": "n", "value": 0, "where": "id > 3"})]).ok
    assert h.do("t", [edit.Op("delete_rows", {"where": "n == 0"})]).ok
    with pytest.raises(edit.EditError):
        h.do("t", [edit.Op("set_values", {"column": "kind", "value": "z"})])
    rows = lambda n=None: sorted((r["id"], r["n"]) for r in h.state(n)["t"].collect())
    assert (len(h.edits), rows(0), rows(1), rows()) == (2, [(i, i) for i in range(1, 7)], [(1, 1), (2, 2), (3, 3), (4, 0), (5, 0), (6, 0)], [(1, 1), (2, 2), (3, 3)])
    h.undo()
    assert rows() == rows(1)


def test_questions_and_rounds(spark):
    tools = Tools(spark, {"t": spark.createDataFrame([(1, 2), (2, 3)], "id int, n int")})
    ask = Call("run_sql", {"sql": "SELECT sum(n) AS s FROM t"})
    agent = Agent(Scripted(Reply(calls=(ask, Call("run_sql", {"sql": "DROP TABLE t"}))), Reply("five")), tools)
    events = list(agent.ask("how many?"))
    assert [e.kind for e in events] == ["call", "result", "call", "result", "answer"] and events[1].data["rows"] == [[5]] and "error" in events[3].data
    assert [m["role"] for m in agent.backend.seen[1]] == ["user", "tool", "tool"]
    agent.backend.replies = [Reply(calls=(Call("nothing", {}),))] * 9
    assert [e.kind for e in agent.ask("again?")][-1] == "stopped" and len(agent.backend.replies) == 3
    agent.backend.replies = [Reply("yes")] * 8
    for _ in range(8):
        list(agent.ask("more?"))
    assert len(agent.backend.seen[-1]) == 13 and agent.turns[0] == ("how many?", "five")


def test_points_of_charts(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 2), "7.5", 1), (dt.date(2026, 1, 1), "x", 2)], "day date, text string, n int").withColumn("d", F.col("n").cast("decimal(5,2)"))
    got = charts.series_frame(charts.ChartSpec("line", "day", "text"), df)
    assert got.dtypes == [("x", "timestamp_ntz"), ("y", "double")] and [r["y"] for r in got.collect()] == [None, 7.5]
    assert charts.series_frame(charts.ChartSpec("bar", "n", "d", "text"), df).dtypes == [("x", "int"), ("y", "double"), ("color", "string")]
    for spec, rows in ((charts.ChartSpec("bar", "n", "day"), df), (charts.ChartSpec("bar", "n", "text"), df.where("text = 'x'")), (charts.ChartSpec("bar", "n", "d"), df.where("false")), (charts.ChartSpec("bar", "n"), df), (charts.ChartSpec("bar", "q", "n"), df)):
        with pytest.raises(charts.ChartSpecError):
            charts.series_frame(spec, rows)
