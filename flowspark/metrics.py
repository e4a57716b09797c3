"""What running queries have done: rows in, rows out, and seconds, by query."""

from __future__ import annotations

import json
import logging
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("flowspark")


class Progress(StreamingQueryListener):
    """Counts item_inp_count, item_out_count, epochs and epoch_duration_seconds of each streaming query, and logs them."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))

    def onQueryStarted(self, event) -> None:
        log.info("query %s started", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.counts[p.name or str(p.id)]
        own["item_inp_count"] += p.numInputRows
        own["item_out_count"] += max(0, p.sink.numOutputRows)
        own["epochs"] += 1
        own["epoch_duration_seconds"] += (p.batchDuration or 0) / 1000
        log.debug("query %s: %s", p.name, json.dumps(own))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("query %s ended%s", event.id, f": {event.exception}" if event.exception else "")


def setup_tracing(spark: SparkSession, log_level: str = "ERROR") -> Progress:
    """Sets the level of this package's log and of Spark's, and counts from now on."""
    logging.basicConfig()
    log.setLevel(log_level)
    spark.sparkContext.setLogLevel(log_level)
    progress = Progress()
    spark.streams.addListener(progress)
    return progress


def serve(flow, progress: Progress, port: int = 3030):
    """Serves the step graph at /dataflow and the counts, in Prometheus' form, at /metrics; returns the server, whose shutdown() ends it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    from .plans import to_json

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            if self.path == "/dataflow":
                kind, body = "application/json", to_json(flow)
            elif self.path == "/metrics":
                kind, body = "text/plain", "".join(f'{n}{{step_id="{q}"}} {v:g}\n' for q, own in progress.counts.items() for n, v in own.items())
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
