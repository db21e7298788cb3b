"""The read tools as functions over rows, and JSON-RPC around them."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import aggregates, graph, search

TOOLS = {
    "find_symbol": ("Find symbols by name, prefix, glob or capitals", {"name": "string", "ignoreCase": "boolean"}, ["name"]),
    "find_callers": ("List the callers of a node", {"nodeId": "string"}, ["nodeId"]),
    "find_callees": ("List what a node calls", {"nodeId": "string"}, ["nodeId"]),
    "get_outline": ("List the symbols of a file", {"file": "string"}, ["file"]),
}


#: rows in one reply
PAGE = 10_000


class ToolError(Exception):
    pass


class Tools:
    """Tool calls over an index.

    A reply has the whole count and at most PAGE rows from ``offset`` on, in a
    fixed order; ``next`` says where to go on, so no reply holds a whole table.
    """

    def __init__(self, index: dict[str, DataFrame]):
        self.index = index

    def find_symbol(self, name: str = "", ignoreCase: bool = False, offset: int = 0) -> dict:
        if not name:
            raise ToolError("name is required")
        rows = search.query(self.index["nodes"], name, ignoreCase).select("name", "file", "line", "column", "id").orderBy("file", "line", "column", "name", "id")
        return _reply("symbols", rows, offset)

    def find_callers(self, nodeId: str = "", offset: int = 0) -> dict:
        rows = graph.callers_of(self.index["edges"], self.index["nodes"], nodeId).select("caller_name", "file", "line").orderBy("caller_name", "file", "line")
        return _reply("callers", rows, offset)

    def find_callees(self, nodeId: str = "", offset: int = 0) -> dict:
        rows = graph.callees_of(self.index.get("edges_by_src", self.index["edges"]), self.index["nodes"], nodeId).select("callee_name", "file", "line").orderBy("callee_name", "file", "line")
        return _reply("callees", rows, offset)

    def get_outline(self, file: str = "", offset: int = 0) -> dict:
        return {"file": file, **_reply("symbols", aggregates.outline(self.index["nodes"], file).select("name", "line", "column"), offset)}

    def handle(self, request: dict) -> dict | None:
        """The reply to a request; none to a notification."""
        method, rid = request.get("method"), request.get("id")
        if method == "initialize":
            return _result(rid, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "spanloom", "version": "0.1.0"}})
        if method == "tools/list":
            tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]
            return _result(rid, {"tools": tools})
        if method != "tools/call":
            return None if rid is None else _error(rid, -32601, f"method not found: {method}")
        params = request.get("params")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            return _error(rid, -32602, "invalid params")
        if params["name"] not in TOOLS:
            return _error(rid, -32601, f"unknown tool: {params['name']}")
        try:
            found = getattr(self, params["name"])(**(params.get("arguments") or {}))
        except (ToolError, TypeError) as e:
            return _error(rid, -32000, str(e))
        return _result(rid, {"content": [{"type": "text", "text": json.dumps(found, indent=2, ensure_ascii=False)}]})

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """Replies to JSON lines; blank and malformed lines are passed over."""
        for line in lines:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if isinstance(request, dict) and (reply := self.handle(request)) is not None:
                yield json.dumps(reply, ensure_ascii=False)


def _reply(what: str, rows: DataFrame, offset: int = 0) -> dict:
    found = [r.asDict() for r in rows.offset(offset).limit(PAGE + 1).collect()]
    if not offset and len(found) <= PAGE:
        return {"count": len(found), what: found}
    more = {"next": offset + PAGE} if len(found) > PAGE else {}
    return {"count": rows.count(), what: found[:PAGE], **more}


def _result(rid, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": rid, "result": result}


def _error(rid, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": message}}


def as_json(rows: DataFrame, what: str) -> DataFrame:
    """One row of JSON: the count and the rows, in a fixed order, for replies made in a plan."""
    cols = rows.columns
    return rows.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct(*cols))).alias(what))).alias("json"))


def main(index: dict[str, DataFrame]) -> None:
    for reply in Tools(index).serve(sys.stdin):
        print(reply, flush=True)
