"""Command line: python -m colstate --workflows DIR --root PATH COMMAND [--workflow NAME] ..."""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from colstate.api import Colstate, UnknownWorkflow

COMMANDS: dict[str, Callable] = {
    "workflows": lambda c, a: c.workflows(),
    "ingest": lambda c, a: c.ingest(a.workflow, open(a.file, "rb").read() if a.file else None, a.count),
    "upsert": lambda c, a: c.upsert(a.workflow, count=a.count, updates=a.updates),
    "converge": lambda c, a: c.converge(a.workflow, a.durable, a.run),
    "converge-all": lambda c, a: c.converge_all(a.durable, a.run),
    "status": lambda c, a: c.status(a.workflow),
    "sample": lambda c, a: c.sample(a.workflow, a.n),
    "reset": lambda c, a: c.reset(a.workflow),
    "lifecycle": lambda c, a: c.lifecycle(*c.workflows()["dependency_order"][:2]),
    "matches": lambda c, a: c.match_report(a.workflow),
    "take-up": lambda c, a: c.take_up(),
}

#: The method of each route: what changes datasets is posted.
METHODS = {name: "GET" if name in ("workflows", "status", "sample", "matches") else "POST" for name in COMMANDS}


def _truth(text: str | None) -> bool:
    return (text or "").lower() in ("1", "true", "yes")


def serve(c: Colstate, port: int, host: str = "127.0.0.1"):
    """The commands over HTTP: METHOD /command?workflow=... with the method of METHODS.

    404 for other routes and methods, 400 for unknown workflows and for numbers that aren't any, 500 with the message for all
    other errors. ``durable=1`` or ``run=ID`` (or DURABLE_RUNS in the environment) makes a run that can be taken up again.
    """
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            query, name = dict(parse_qsl(url.query)), url.path.strip("/")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if METHODS.get(name) != self.command:
                return self.say(404, {"error": f"unknown route: {self.command} {url.path}"})
            try:
                a = argparse.Namespace(
                    workflow=query.get("workflow"), file=None, n=int(query.get("n", 5)), updates=int(query.get("updates", 50)),
                    count=int(query.get("count", 500 if name == "ingest" else 100)), run=query.get("run"),
                    durable=_truth(query.get("durable", os.environ.get("DURABLE_RUNS"))),
                )
            except ValueError as e:
                return self.say(400, {"error": str(e)})
            try:
                if name == "ingest" and "application/x-protobuf" in (self.headers.get("Content-Type") or ""):
                    return self.say(200, c.ingest(a.workflow, body))
                return self.say(200, COMMANDS[name](c, a))
            except UnknownWorkflow as e:
                return self.say(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001  the client learns what went wrong, the server goes on
                return self.say(500, {"error": f"{type(e).__name__}: {e}"[:2000]})

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def say(self, code: int, what: dict) -> None:
            data = json.dumps(what, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)


def wait_ready(url: str, seconds: float = 60, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Ask a server for its workflows until it answers; False if it hasn't within the time."""
    from urllib.error import URLError
    from urllib.request import urlopen

    until = time.monotonic() + seconds
    while True:
        try:
            with urlopen(f"{url.rstrip('/')}/workflows", timeout=5) as r:
                return r.status == 200
        except (URLError, OSError):
            if time.monotonic() >= until:
                return False
            sleep(min(1.0, seconds / 10))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="colstate")
    p.add_argument("--workflows", required=True, help="folder of definitions")
    p.add_argument("--root", required=True, help="folder of the datasets")
    p.add_argument("--workflow", help="name, or a part of it that only one name has")
    p.add_argument("--file", help="a serialised batch to ingest")
    p.add_argument("--count", type=int, default=500)
    p.add_argument("--updates", type=int, default=50)
    p.add_argument("--n", type=int, default=5)
    p.add_argument("--host", default="127.0.0.1", help="where serve listens; 0.0.0.0 for all interfaces")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--poll", type=float, default=5, help="seconds between two looks of the worker for runs to take up")
    p.add_argument("--durable", action="store_true", help="converge as a run that can be taken up again")
    p.add_argument("--run", help="id of the run to take up again")
    p.add_argument("command", choices=[*COMMANDS, "serve", "worker"])
    a = p.parse_args(argv)
    c = Colstate.from_dir(SparkSession.builder.appName("colstate").getOrCreate(), a.workflows, a.root)
    if a.workflow and a.workflow not in c.definitions:
        part = [n for n in c.definitions if a.workflow in n]
        a.workflow = part[0] if len(part) == 1 else a.workflow
    if a.command == "serve":
        serve(c, a.port, a.host).serve_forever()
    while a.command == "worker":
        if (done := c.take_up())["runs"]:
            print(json.dumps(done, default=str), flush=True)
        time.sleep(a.poll)
    print(json.dumps(COMMANDS[a.command](c, a), default=str, indent=1))


if __name__ == "__main__":
    main()
