"""Command line: ingest a folder of markdown, search, list, or serve the tools as JSON lines on standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from larkspur.plans.store import Store
from larkspur.session import build
from larkspur.sources.markdown import read_local_markdown, read_markdown
from larkspur.sources.provider import http_embedder
from larkspur.tools import ToolError, Tools

NAMES = ("search_knowledge", "list_knowledge", "write_knowledge", "delete_knowledge", "get_tool")


def answer(tools: Tools, line: str) -> dict | None:
    """One JSON-RPC request {"method": "tools/call", "params": {"name", "arguments"}}; None for a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", ""), "serverInfo": {"name": "larkspur"}, "capabilities": {"tools": {}}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": (getattr(Tools, n).__doc__ or n.replace("_", " ")).strip()} for n in NAMES]}}
    if method == "ping":
        return reply | {"result": {}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}} if "id" in request else None
    name = params.get("name")
    if name not in NAMES:
        return reply | {"error": {"code": -32602, "message": f"unknown tool {name}"}}
    try:
        return reply | {"result": {"content": [{"type": "text", "text": getattr(tools, name)(**(params.get("arguments") or {}))}]}}
    except (ToolError, TypeError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}
    except KeyError as e:
        return reply | {"error": {"code": -32603, "message": str(e.args[0])}}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    parser.add_argument("--store", default=os.environ.get("LARKSPUR_STORE"), help="folder of the snapshots (LARKSPUR_STORE)")
    parser.add_argument("--model", default=os.environ.get("LARKSPUR_MODEL"), help="embedding model (LARKSPUR_MODEL); hashed vectors without")
    parser.add_argument("--model-url", default=os.environ.get("LARKSPUR_MODEL_URL"), help="its server (LARKSPUR_MODEL_URL)")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("docs")
    one.add_argument("--local", action="store_true", help="read a folder that only the driver has")
    two = sub.add_parser("search")
    two.add_argument("query", nargs="+")
    two.add_argument("--limit", type=int, default=5)
    sub.add_parser("list").add_argument("prefix", nargs="?", default="")
    sub.add_parser("serve").add_argument("--docs", default=os.environ.get("LARKSPUR_DOCS"), help="folder of markdown files that are the truth (LARKSPUR_DOCS)")
    args = parser.parse_args(argv)
    if not args.store:
        parser.error("--store or LARKSPUR_STORE is needed")
    spark = build()
    store = Store(spark, args.store, connect=http_embedder(args.model_url, args.model) if args.model and args.model_url else None)
    tools = Tools(spark, store, getattr(args, "docs", None) if args.command == "serve" else None)
    if args.command == "ingest":
        print(store.ingest((read_local_markdown if args.local else read_markdown)(spark, args.docs)))
    elif args.command == "search":
        print(tools.search_knowledge(" ".join(args.query), args.limit))
    elif args.command == "list":
        print(tools.list_knowledge(args.prefix), end="")
    else:
        if tools.docs_path:
            tools.sync()
        for line in sys.stdin:
            if line.strip() and (out := answer(tools, line)) is not None:
                print(json.dumps(out), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
