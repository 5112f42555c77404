"""What is costly is worked out once for each row, not once for each use."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomlog.operators import normalise
from loomlog.plans import logs, more, rules
from loomlog.sources import common

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_input_is_parsed_once_for_all_fields_of_its_events(spark):
    plan = _plan(normalise.events(more._calls(spark, SF)).select("id", "tool_kind", "tool_resolved", "file", "plan_path"))
    assert plan.lower().replace("_", "").count("parsejson") == 1


def test_spawn_records_and_messages_are_written_once(spark):
    """Only the sidecars, which sessions are joined with, are still read from the orders."""
    for name in ("claude_spawns", "spawn_costs"):
        assert _plan(entry.queries()[name](spark, SF)).count("o_totalprice") <= 2


def test_bodies_broadcast_no_table(spark):
    """Spark takes exploded rows for few and small; whole tables of events would go through the driver."""
    plan = entry.queries()["bodies_by_ref"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_incidents_sort_no_events(spark):
    """Their queries need no number of an event, so no session's events are shuffled and sorted, bodies and all."""
    plan = _plan(rules._shell(spark, SF)[0].where("type = 'tool_call(bash)'"))
    assert "Generate explode" in plan and "Window" not in plan


def test_spawn_costs_looks_for_no_requests_answers_and_estimates(spark):
    """None of them is in its rows: the only numbers are those by which a call of several records counts once."""
    out = entry.queries()["spawn_costs"](spark, SF)
    plan = _plan(out)
    assert plan.count("Window [") == 1
    assert "qa#" not in plan and "chars" not in plan and out.count() == 1500


def test_fields_of_events_that_nobody_reads_are_not_worked_out(spark):
    """A call's file, kind and target are looked up in its input only where they are read."""
    events = normalise.events(more._calls(spark, SF))
    assert "$.subagent_type" in _plan(events.select("tool_resolved"))
    assert "$.subagent_type" not in _plan(events.where("tool = 'Task'").select("session_id", "tool_use_id"))


def test_lines_that_are_no_objects_are_not_parsed(spark):
    """Failing to parse a line costs more than reading it; no record's whole schema is worked out to tell what it is."""
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(['{"a":1}', " \t{}", '{"a":', "[1]", '"{}"', "{x}", "", "5", '{"a":{}}'])], "file string, at int, value string")
    rows = common.from_lines(lines)
    plan = _plan(rows)
    assert "schemaOfVariant" not in plan and "startswith" in plan.lower()
    assert [(r.line_no, r.x) for r in rows.select("line_no", F.to_json("v").alias("x")).orderBy("line_no").collect()] == [(1, '{"a":1}'), (2, "{}"), (9, '{"a":{}}')]


def test_lines_of_orders_are_not_compared(spark):
    """Each has a place of its own; comparing them all sent them through one more exchange."""
    rows = spark.createDataFrame([(1, 7)], "k long, turn long")
    plan = _plan(logs._each_line(rows, F.lit("f"), (F.lit(0), F.lit("{}"))))
    assert "Aggregate" not in plan and "Aggregate" in _plan(logs._lines(rows, F.lit("f"), (F.lit(0), F.lit("{}"))))
