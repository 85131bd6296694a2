"""The control surface over HTTP: start runs, look at their state."""

from __future__ import annotations

import dataclasses
import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidemark.functions import statements
from tidemark.operators import staging
from tidemark.plans.runner import QueueFull, RunManager
from tidemark.sources import catalog, files, introspect

log = logging.getLogger("tidemark")


def answer(manager: RunManager, method: str, path: str) -> tuple[int, object]:
    """(status code, body) of a request; text bodies are sent as they are."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    specs = {s.name: s for s in manager.pipeline.targets}
    if method == "POST" and parts[:1] == ["run"]:
        return _run(manager, parts[1:])
    if method != "GET":
        return 405, {"error": "method"}
    match parts:
        case ["live"]:
            return 200, {"status": "ok", "db": "n/a"}
        case ["ready"] | ["health"]:
            wrong = _wrong(manager, sources=parts == ["ready"])
            if wrong:
                return 503, {"status": "degraded", "db": "down" if "session" in wrong or "storage" in wrong else "ok", "error": "; ".join(f"{k}: {v}" for k, v in wrong.items())}
            return 200, {"status": "ready" if parts == ["ready"] else "ok", "db": "ok"}
        case ["status"]:
            return 200, {"targets": manager.status()}
        case ["config"]:
            return 200, {"targets": [{"name": s.name, "group": s.group} for s in specs.values()]}
        case ["metrics"]:
            return 200, manager.exposition()
        case ["api", "targets"]:
            return 200, {"targets": [dataclasses.asdict(s) for s in specs.values()]}
        case ["api", "targets", name] if name in specs:
            return 200, dataclasses.asdict(specs[name])
        case ["api", "targets", name, "ddl"] if name in specs:
            return 200, _ddl(manager, specs[name])
    return 404, {"error": f"no {path}"}


def _wrong(manager: RunManager, sources: bool) -> dict[str, str]:
    """What does not work, by name: the session, the targets' storage, and the sources."""
    checks = {"session": lambda: manager.engine.spark.sql("SELECT 1").first(), "storage": lambda: [manager.engine.state(s) for s in manager.pipeline.targets[:1]]}
    if sources:
        checks |= {f"source of {s.name}": lambda s=s: catalog.source(manager.engine.spark, s).schema for s in manager.pipeline.targets}
    wrong = {}
    for name, check in checks.items():
        try:
            check()
        except Exception as e:
            wrong[name] = str(e).splitlines()[0]
    return wrong


def _run(manager: RunManager, parts: list[str]) -> tuple[int, object]:
    try:
        match parts:
            case []:
                got = manager.submit_all()
            case ["group", number]:
                if not number.lstrip("-").isdigit():
                    return 400, {"error": f"group {number!r} is no number"}
                got = manager.submit_group(int(number))
            case ["target", name]:
                got = manager.submit_target(name)
            case _:
                return 404, {"error": "unknown run"}
    except QueueFull as e:
        return 503, {"error": str(e)}
    if got is None:
        return 404, {"error": "nothing is configured under that name"}
    return (202, got) if got["runId"] else (409, {"error": got["message"]})


def _ddl(manager: RunManager, spec) -> dict:
    try:
        table = manager.engine.table(spec)
        there = bool(table.manifest()["schema"])
        text = introspect.ddl(spec.targetTable, table.read().schema, spec.keyColumns) if there else "-- not loaded yet"
    except Exception as e:
        there, text = False, f"-- not readable: {str(e).splitlines()[0]}"
    return {"targetDdl": text, "targetTableExists": there} | _staging(manager, spec)


def _staging(manager: RunManager, spec) -> dict:
    """The staged page's columns, by analysis of the source, and whether a load has left one."""
    spark = manager.engine.spark
    try:
        own = statements.resolved(spec, spark)
        staged = staging.typed(staging.positional(catalog.source(spark, own), own.insertColumns), own)
        text = introspect.ddl(spec.stagingTable or f"{spec.name} (staged)", staged.schema)
    except Exception as e:
        text = f"-- not readable: {str(e).splitlines()[0]}"
    try:
        there = bool(files.names(spark, f"{manager.engine.warehouse}/_staging/{spec.name}"))
    except Exception:
        there = False
    return {"stagingDdl": text, "stagingTableExists": there}


def server(manager: RunManager, port: int = 8080) -> ThreadingHTTPServer:
    """Listens when its ``serve_forever`` is called."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                code, body = answer(manager, self.command, self.path)
            except Exception as e:
                log.exception("%s %s", self.command, self.path)
                code, body = 500, {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
            data = body.encode() if isinstance(body, str) else json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
