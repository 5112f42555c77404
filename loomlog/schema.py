"""Schemas of the three tables that every source is turned into.

Absent values are NULL throughout: no signal is never written as 0, false or ''.
"""

TOOL_USE = "array<struct<ord:int,name:string,input:string,tool_use_id:string,ts:timestamp>>"
TOOL_RESULT = "array<struct<ord:int,content:string,is_error:boolean,tool_use_id:string,subagent:struct<agent_type:string,model:string,status:string,duration_ms:bigint,tool_uses:bigint,total_tokens:bigint>>>"
QA = "array<struct<question:string,options:array<string>,answer:string>>"
USER_REFS = "array<struct<kind:string,target:string,origin:string>>"
TOKENS = "struct<input:bigint,output:bigint,reasoning:bigint,cache_read:bigint,cache_write:bigint,total:bigint>"

SESSIONS = {
    "agent": "string",
    "session_id": "string",
    "title": "string",
    "date": "timestamp",
    "path": "string",
    "message_count": "bigint",
    "parent_uuid": "string",
    "kind": "string",
    "project_dir": "string",
    "launch_surface": "string",
    "models": "array<string>",
    "extra": "map<string,string>",
    "spawn_tool_use_id": "string",
    "spawn_depth": "int",
    "subagent_type": "string",
}

MESSAGES = {
    "agent": "string",
    "session_id": "string",
    "message_index": "bigint",
    "role": "string",
    "text": "string",
    "ts": "timestamp",
    "thinking": "string",
    "model": "string",
    "tool_use": TOOL_USE,
    "tool_result": TOOL_RESULT,
    "qa": QA,
    "user_refs": USER_REFS,
    "tokens": TOKENS,
    "call_key": "string",
}


def conform(df, schema: dict):
    """df with exactly the schema's columns: missing ones null, all cast."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
