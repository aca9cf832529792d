import io
import json

from vaultmill.plans.tools import ToolResult
from vaultmill.server import serve


class Fake:
    def query(self, question, **options):
        if question == "break":
            raise RuntimeError("x")
        return ToolResult(json.dumps([{"q": question} | options]))

    def graph_neighbors(self, doc_id):
        return ToolResult(f"unknown document {doc_id}", True)


def talk(*messages):
    out = io.StringIO()
    serve(Fake(), io.StringIO("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def call(name, i=1, **arguments):
    return {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_messages():
    got = talk(
        {"jsonrpc": "2.0", "id": 0, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"},
        call("query", 2, question="a", expand=True), call("graph_neighbors", 3, doc_id="d"), call("query", 4), call("query", 5, question="a", other=1), call("other", 6), call("query", 7, question="break"), "{", {"jsonrpc": "2.0", "id": 8, "method": "x"},
    )
    assert got[0]["result"]["capabilities"] == {"tools": {}} and [t["name"] for t in got[1]["result"]["tools"]] == ["query", "graph_neighbors"]
    assert json.loads(got[2]["result"]["content"][0]["text"]) == [{"q": "a", "expand": True}] and got[2]["result"]["isError"] is False
    assert got[3]["result"]["isError"] is True
    assert [g["error"]["code"] for g in got[4:]] == [-32602, -32602, -32602, -32603, -32700, -32601]
