"""The session's methods as tools of a line-based JSON-RPC 2.0 server."""

from __future__ import annotations

import inspect
import json
import sys

from .session import Session, plain

# Fixed values of the protocol
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE_ERROR, UNKNOWN_METHOD, BAD_PARAMS = -32700, -32601, -32602
TYPES = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array", "dict": "object"}
OPTIONS = {
    "module_search": {"context": "int", "most": "int", "limit": "int"},
    "grep": {"name": "str", "exports": "str", "filter": "str", "context": "int", "most": "int", "limit": "int"},
    "diff": {"max_diff_bytes": "int", "context": "int", "max_hunk_bytes": "int"},
    "graph": {"direction": "str", "depth": "int", "max_nodes": "int", "external": "bool", "detect_cycles": "bool"},
}


def _calls(session: Session) -> dict:
    own = ("bundle_list", "bundle_info", "bundle_add", "bundle_reindex", "bundle_remove", "filter_test", "module_search", "grep", "module_get", "diff", "graph")
    docs = ("list", "get", "put", "patch", "fork", "delete")
    return {n: getattr(session, n) for n in own} | {f"filter_{n}": getattr(session.filters, n) for n in docs}


def tools(session: Session) -> list[dict]:
    """Name, description and JSON schema of every tool, read off the signatures."""
    out = []
    for name, f in _calls(session).items():
        fields, needed = {}, []
        for p in inspect.signature(f).parameters.values():
            if p.kind == p.VAR_KEYWORD:
                fields |= {k: {"type": TYPES[t]} for k, t in OPTIONS[name].items()}
                continue
            fields[p.name] = {"type": TYPES[str(p.annotation).removesuffix(" | None")]}
            if p.default is p.empty:
                needed.append(p.name)
        out.append({"name": name, "description": (inspect.getdoc(f) or name.replace("_", " ")).split("\n")[0], "inputSchema": {"type": "object", "properties": fields, "required": needed, "additionalProperties": False}})
    return out


def handle(session: Session, line: str) -> dict | None:
    """The answer to one message; a notification has none.  A tool that fails is a result, not a fault of transport."""
    try:
        message = json.loads(line)
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
    if not isinstance(message, dict) or "id" not in message:
        return None
    head, method, params = {"jsonrpc": "2.0", "id": message["id"]}, message.get("method"), message.get("params") or {}
    if method == "initialize":
        asked = params.get("protocolVersion")
        return head | {"result": {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "modlens", "version": "1"}}}
    if method == "ping":
        return head | {"result": {}}
    if method == "tools/list":
        return head | {"result": {"tools": tools(session)}}
    if method != "tools/call":
        return head | {"error": {"code": UNKNOWN_METHOD, "message": f"unknown method {method!r}"}}
    if not params.get("name"):
        return head | {"error": {"code": BAD_PARAMS, "message": "a tool's name is needed"}}
    try:
        call = _calls(session).get(params["name"])
        if call is None:
            raise LookupError(f"unknown tool {params['name']!r}")
        text, failed = json.dumps(plain(call(**(params.get("arguments") or {}))), ensure_ascii=False, indent=2, default=str), False
    except Exception as e:  # whatever went wrong is told to the caller
        text, failed = f"{type(e).__name__}: {e}", True
    return head | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(session: Session, stdin=None, stdout=None) -> None:
    """Answers line by line until the input ends."""
    stdout = stdout or sys.stdout
    for line in stdin or sys.stdin:
        if line.strip() and (answer := handle(session, line)) is not None:
            stdout.write(json.dumps(answer, ensure_ascii=False) + "\n")
            stdout.flush()
