"""The five log formats from small files written here, with hostile lines in between."""

import json

import pytest

from loomlog.operators import aggregate, normalise, plan_events, sessions, tokens
from loomlog.sources import antigravity, claude, codex, opencode, pi
from loomlog.sources.adapters import ingest_all

HOSTILE = ['{"type":"user","message":', "\x00\x01", "[1,2,3]", '"text"', "", '{"type":5,"message":{"content":7}}', '{"type":"user","type":"user","message":{"content":"twice"}}']


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows]
    path.write_bytes("\n".join(lines).encode() + b"\n\xff\xfe broken\n")


def part(kind, **more):
    return {"type": kind, **more}


@pytest.fixture(scope="module")
def claude_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("claude")
    user = lambda content, **more: {"type": "user", "timestamp": "2025-01-01T10:00:00Z", "sessionId": "s1", "cwd": "/w/p", "message": {"role": "user", "content": content}, **more}
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": True}
    said = lambda content, **more: {"type": "assistant", "timestamp": "2025-01-01T10:01:00Z", "requestId": "r1", "message": {"role": "assistant", "id": "m1", "model": "big-1", "usage": usage, "content": content}, **more}
    write(
        root / "proj" / "s1.jsonl",
        [
            user("Fix the bug"),
            *HOSTILE,
            said([part("thinking", thinking="hm")]),
            said([part("text", text="I will use docker."), part("tool_use", id="t1", name="Edit", input={"file_path": "a.py", "old_string": "x", "new_string": "y"})]),
            user([part("tool_result", tool_use_id="t1", content=[part("text", text="<tool_use_error>no")])]),
            said([part("tool_use", id="t2", name="Task", input={"subagent_type": "tester"}), part("tool_use", id="t3", name="AskUserQuestion", input={"questions": [{"question": "Which?", "options": [{"label": "A"}, {"label": "B"}]}]})], requestId="r2"),
            user([part("tool_result", tool_use_id="t2", content="done")], toolUseResult={"agentType": "tester", "status": "completed", "totalTokens": 77, "totalDurationMs": False}),
            user([part("tool_result", tool_use_id="t3", content='"Which?"="B"')]),
            said([part("tool_use", id="t4", name="Write", input={"file_path": "/h/plans/p.md", "content": "# Plan A\n## Steps\ndo this thing now"})], requestId="r3"),
            said([part("tool_use", id="t5", name="ExitPlanMode", input={"plan": "# Plan B\n## Steps\ndo that"})], requestId="r4"),
            user([part("tool_result", tool_use_id="t5", content='User chose to stay in plan mode\nComments on the plan:\n[Re: "do that"] why?')]),
            user([part("image", source={"type": "base64"}), part("text", text="see https://x.example/a and @src/b.py")]),
            {"type": "custom-title", "customTitle": "My title"},
        ],
    )
    write(root / "proj" / "s1" / "subagents" / "agent-9.jsonl", [user("sub work", isSidechain=True), said([part("text", text="ok")], message={"role": "assistant", "content": "plain"})])
    (root / "proj" / "s1" / "subagents" / "agent-9.meta.json").write_text(json.dumps({"agentType": "tester", "toolUseId": "t2", "spawnDepth": 1}))
    return str(root)


def test_claude(spark, claude_root, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"cliSessionId": "s1", "title": "Desk", "cwd": "/other", "lastActivityAt": 1735725600000}))
    (tmp_path / "e.json").write_text(json.dumps({"sessionId": "only", "title": "Lost", "cwd": "/o"}))
    s, m = claude.ingest(spark, claude_root, str(tmp_path))
    by = {x.session_id: x for x in s.collect()}
    assert set(by) == {"s1", "agent-9", "only"}
    assert (by["s1"].title, by["s1"].project_dir, by["s1"].models) == ("Desk", "/w/p", ["big-1"])
    assert (by["agent-9"].parent_uuid, by["agent-9"].kind, by["agent-9"].subagent_type, by["agent-9"].spawn_tool_use_id) == ("s1", "subagent", "tester", "t2")
    assert by["only"].message_count == 0
    rows = {x.message_index: x for x in m.where("session_id = 's1'").collect()}
    assert rows[0].text == "Fix the bug" and rows[1].thinking == "hm"
    assert rows[3].tool_result[0].is_error is True
    cost = next(r.tool_result[0].subagent for r in rows.values() if r.tool_result and r.tool_result[0].tool_use_id == "t2")
    assert (cost.agent_type, cost.total_tokens, cost.duration_ms) == ("tester", 77, None)
    assert [q.answer for r in rows.values() for q in (r.qa or [])] == ["B"]
    exact = tokens.exact_totals(m.where("session_id = 's1'")).head()
    assert (exact.tokens.total, exact.tokens.cache_read) == (60, None)  # four calls of 15; booleans are no numbers
    e = normalise.events(normalise.fold_thinking(m.where("session_id = 's1'")))
    kinds = [(x.type, x.tool_kind, x.tool_resolved, x.file) for x in e.orderBy("seq").collect()]
    assert kinds[0][0] == "user_turn" and kinds[1][0] == "assistant_turn"
    assert ("tool_call(edit)", "edit", None, "a.py") in kinds and ("tool_call(other)", "task", "tester", None) in kinds
    plans = plan_events.plans(e, m).orderBy("seq").collect()
    assert [(p.version, p.kind, p.task_key) for p in plans] == [(1, "draft", "plans/p.md"), (2, "final", "plans/p.md")]
    told = plan_events.feedback(e, m).collect()
    assert [(f.quote, f.comment, f.section, f.version, f.ref) for f in told] == [("do that", "why?", "Steps", 2, "s1:pf0")]
    last = e.where("type = 'user_turn'").orderBy("seq").collect()[-1]
    assert [(r.kind, r.target, r.origin) for r in last.user_refs] == [("image", None, "structured"), ("url", "https://x.example/a", "text"), ("file", "src/b.py", "text")]
    wrong = normalise.with_errors(e, m).where("tool = 'Edit'").head()
    assert wrong.is_error is True
    tree = tokens.tree_tokens(tokens.session_tokens(m, s), s).where("session_id = 's1'").head()
    assert tree.total == tree.own + tree.children
    parts = aggregate.totals(s.join(tokens.session_tokens(m, s), ["agent", "session_id"]), ["count", "tokens"]).head()
    assert parts.tokens_exact + parts.tokens_estimated + parts.tokens_unknown == parts["count"]


def test_codex(spark, tmp_path):
    item = lambda **p: {"timestamp": "2025-02-01T00:00:00.000Z", "type": "response_item", "payload": p}
    say = lambda role, text, kind="input_text": item(type="message", role=role, content=[{"type": kind, "text": text}])
    count = lambda n: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}}}}
    write(
        tmp_path / "2025" / "rollout-a.jsonl",
        [
            {"type": "session_meta", "timestamp": "2025-02-01T00:00:00Z", "payload": {"id": "c1", "cwd": "/w", "originator": "cli", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "c0", "depth": 2}}}}},
            {"type": "turn_context", "payload": {"model": "m-1"}},
            say("user", "<permissions> x"), say("user", "Do the task please"),
            {"type": "event_msg", "payload": {"type": "user_message", "message": "Do the task please"}},
            item(type="reasoning", summary=[{"text": "think"}]), item(type="function_call", name="exec_command", arguments='{"cmd": "echo 1 > out.txt"}', call_id="k1"),
            item(type="function_call_output", output="ok", call_id="k1"), item(type="web_search_call", action={"query": "q"}), say("assistant", "Done.", "output_text"), count(5), count(9),
            item(type="function_call", name="update_plan", arguments=json.dumps({"plan": [{"step": "A", "status": "completed"}, {"step": "B", "status": "in_progress"}]})),
        ],
    )
    s, m = codex.ingest(spark, str(tmp_path))
    x = s.head()
    assert (x.session_id, x.title, x.parent_uuid, x.spawn_depth, x.models, x.launch_surface) == ("c1", "Do the task please", "c0", 2, ["m-1"], "cli")
    roles = [(r.role, r.text, r.model) for r in m.orderBy("message_index").collect()]
    assert roles == [("user", "<permissions> x", None), ("user", "Do the task please", None), ("assistant", "", "m-1"), ("assistant", "", "m-1"), ("tool", "", None), ("assistant", "", "m-1"), ("assistant", "Done.", "m-1"), ("assistant", "", "m-1")]
    assert codex.last_counter(codex.records(spark, str(tmp_path))).head().tokens.total == 10
    e = normalise.events(m)
    assert e.where("type = 'plan_event'").head().plan_status == "in_progress"
    from loomlog.operators import edits

    assert [(r.file, r.append, r.intent) for r in edits.file_edits(e, m).collect()] == [("out.txt", False, "Do the task please")]


def test_opencode(spark, tmp_path):
    spark.createDataFrame([("o1", None, "T", 1000, 2000, "/w"), ("o2", "o1", "", 1000, 3000, None)], "id string, parent_id string, title string, time_created long, time_updated long, directory string").write.parquet(str(tmp_path / "session.parquet"))
    msg = lambda i, s, t, **d: (i, s, t, t, json.dumps(d))
    spark.createDataFrame([msg("m1", "o1", 5, role="user"), msg("m2", "o1", 6, role="assistant", modelID="z", tokens={"input": 3, "output": 4, "cache": {"read": 1}}), msg("m3", "o1", 7, role="assistant")], "id string, session_id string, time_created long, time_updated long, data string").write.parquet(str(tmp_path / "message.parquet"))
    p = lambda i, m, t, **d: (i, m, "o1", t, t, json.dumps(d))
    spark.createDataFrame(
        [p("p1", "m1", 5, type="text", text="hello"), p("p2", "m1", 5, type="file", mime="image/png", filename="a.png", url="data:xx"), p("p4", "m2", 8, type="tool", tool="bash", callID="c", state={"status": "error", "input": {"command": "ls"}}), p("p3", "m2", 7, type="reasoning", text="why"), p("p5", "m2", 9, type="patch", hash="h", files=[{"path": "f.py", "added": 1, "removed": 0}])],
        "id string, message_id string, session_id string, time_created long, time_updated long, data string",
    ).write.parquet(str(tmp_path / "part.parquet"))
    s, m = opencode.ingest(spark, str(tmp_path))
    rows = m.orderBy("message_index").collect()
    assert [r.role for r in rows] == ["user", "assistant", "assistant"]
    assert [(r.kind, r.target) for r in rows[0].user_refs] == [("image", "a.png")]
    assert rows[1].thinking == "why" and rows[1].tool_result[0].is_error is True and rows[1].tokens.total == 8
    assert [t.name for t in rows[1].tool_use] == ["bash", "patch"] and rows[2].text == ""
    assert {x.session_id: (x.title, x.parent_uuid, x.message_count) for x in s.collect()} == {"o1": ("T", None, 3), "o2": ("Untitled", "o1", 0)}


def test_antigravity(spark, tmp_path):
    logs = tmp_path / "brain" / "g1" / ".system_generated" / "logs"
    write(logs / "overview.txt", [{"timestamp": "2025-03-01T00:00:00Z", "source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "Build it"}, {"source": "MODEL", "type": "X", "content": "Sure", "tool_calls": [{"name": "write_file", "args": {"path": "z.txt"}}]}])
    (tmp_path / "brain" / "g1" / "implementation_plan.md").write_text("# The plan\ntext")
    root = str(tmp_path / "brain")
    s, m = antigravity.ingest(spark, root)
    assert (s.head().session_id, s.head().title) == ("g1", "Build it")
    e = normalise.events(m, antigravity.plan_files(spark, root)).orderBy("seq").collect()
    assert [(x.type, x.message_index) for x in e] == [("user_turn", 0), ("assistant_turn", 1), ("tool_call(write)", 1), ("plan_event", -1)]
    assert e[3].title == "The plan" and e[2].file == "z.txt"


def test_pi_and_union(spark, tmp_path, claude_root):
    write(
        tmp_path / "x" / "f.jsonl",
        [
            {"type": "session", "id": "p1", "timestamp": "2025-04-01T00:00:00Z", "cwd": "/w", "parentSession": "/a/b/p0.jsonl"},
            {"type": "message", "timestamp": "2025-04-01T00:00:01Z", "message": {"role": "user", "content": "go"}},
            {"type": "message", "message": {"role": "assistant", "timestamp": 1743465602000, "model": "q", "usage": {"input": 2, "output": 3, "totalTokens": 5}, "content": [{"type": "thinking", "thinking": "t"}, {"type": "toolCall", "id": "1", "name": "read", "arguments": {"path": "r.md"}}]}},
            {"type": "message", "message": {"role": "toolResult", "toolCallId": "1", "content": [{"type": "text", "text": "body"}], "isError": False}},
            {"type": "session_info", "name": "Named"},
        ],
    )
    s, m = pi.ingest(spark, str(tmp_path))
    assert (s.head().title, s.head().parent_uuid, s.head().models) == ("Named", "p0", ["q"])
    assert [r.role for r in m.orderBy("message_index").collect()] == ["user", "assistant", "tool"]
    both, _ = ingest_all(spark, {"pi": str(tmp_path), "claude": claude_root})
    assert {(x.agent, x.sessions) for x in sessions.diagnostics(both).collect()} == {("pi", 1), ("claude", 2)}


def test_files_are_listed_together(spark, tmp_path):
    """Looking up many files takes a few tasks, not one for each."""
    from loomlog.sources import antigravity

    for i in range(150):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "transcript.jsonl").write_text('{"source":"MODEL","content":"x"}\n')
        (tmp_path / f"s{i}" / "implementation_plan.md").write_text("# Plan\n")
    sc = spark.sparkContext
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("listing", "listing")
    try:
        rows, plans = antigravity.records(spark, str(tmp_path)), antigravity.plan_files(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert len(tasks) == 2 and max(tasks) <= 32
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert rows.count() == plans.count() == 150
