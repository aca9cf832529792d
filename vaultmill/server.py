"""A tool server on standard input and output: JSON-RPC 2.0, one message per line.

Answers initialize, ping, tools/list and tools/call with the tools query and graph_neighbors. One
store, one embedder and one session live as long as the process; logs go to standard error only.

python -m vaultmill.server --store vault.store
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from vaultmill.errors import ToolStartError
from vaultmill.operators.embed import HashingEmbedder, named
from vaultmill.plans.tools import Tools

log = logging.getLogger(__name__)
PROTOCOL = "2024-11-05"
_int = {"type": "integer"}
TOOLS = [
    {
        "name": "query",
        "description": "Rank the chunks of a store of notes for a question, with optional graph expansion. Candidates only; claims are not checked.",
        "inputSchema": {
            "type": "object",
            "properties": {"question": {"type": "string"}, "lexical_top_k": _int, "semantic_top_k": _int, "final_top_k": _int, "expand": {"type": "boolean"}, "expand_depth": _int, "expand_top_k": _int},
            "required": ["question"],
        },
    },
    {
        "name": "graph_neighbors",
        "description": "Outbound edges of a document; dangling targets have a null target_path.",
        "inputSchema": {"type": "object", "properties": {"doc_id": {"type": "string"}}, "required": ["doc_id"]},
    },
]


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params, i = message.get("method"), message.get("params") or {}, message.get("id")
    if i is None:
        return None
    reply = {"jsonrpc": "2.0", "id": i}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "vaultmill", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        spec = next((t for t in TOOLS if t["name"] == params.get("name")), None)
        given = params.get("arguments") or {}
        if spec is None:
            return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
        if set(given) - set(spec["inputSchema"]["properties"]) or set(spec["inputSchema"]["required"]) - set(given):
            return reply | {"error": {"code": -32602, "message": "wrong arguments"}}
        try:
            r = tools.query(**given) if spec["name"] == "query" else tools.graph_neighbors(**given)
        except Exception:
            log.exception("unexpected failure of %s", spec["name"])
            return reply | {"error": {"code": -32603, "message": "internal error"}}
        return reply | {"result": {"content": [{"type": "text", "text": r.text}], "isError": r.is_error}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vaultmill-server")
    p.add_argument("--store", required=True)
    p.add_argument("--embedder", metavar="MODULE:FACTORY", help="what makes the embedder; hashed words without it")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr)
    spark = SparkSession.builder.appName("vaultmill-server").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        tools = Tools(spark, a.store, named(a.embedder) if a.embedder else HashingEmbedder())
    except ToolStartError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    serve(tools, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
