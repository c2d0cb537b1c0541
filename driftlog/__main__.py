"""``python -m driftlog ROOT [--host H] [--port P]``: the engine as a process until it is interrupted."""

from __future__ import annotations

import argparse
import signal
import threading

from pyspark.sql import SparkSession

from driftlog.server import Runtime, http_server


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="driftlog")
    parser.add_argument("root", help="folder of the tables, shared by all executors")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("driftlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with Runtime(spark, asked.root) as runtime:
        server = http_server(runtime, asked.host, asked.port)
        for signum in (signal.SIGINT, signal.SIGTERM):
            signal.signal(signum, lambda *_: threading.Thread(target=server.shutdown).start())
        server.serve_forever()
        server.server_close()


if __name__ == "__main__":
    main()
