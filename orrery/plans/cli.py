"""Command line: init, train, lttrain, plot, save, debug."""

from __future__ import annotations

import argparse
import json
import os

from ..functions.timefn import PATTERN
from ..session import build
from ..sources.telemetry import EventTableSource


def seconds(text: str) -> float:
    """YYYY/DDD[/HH[:MM[:SS]]] or epoch seconds."""
    import datetime as dt
    import re

    if not re.match(PATTERN, text):
        return float(text)
    part = re.split("[/:]", text)
    base = dt.datetime(int(part[0]), 1, 1, tzinfo=dt.timezone.utc).timestamp()
    day, hour, minute, sec = (*map(float, part[1:]), *[0.0] * 4)[:4] if len(part) > 1 else (1.0, 0.0, 0.0, 0.0)
    return base + (day - 1) * 86400 + hour * 3600 + minute * 60 + sec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery")
    p.add_argument("--data", default=os.environ.get("ORRERY_DATA", "."))
    p.add_argument("--archive", default=os.environ.get("ORRERY_ARCHIVE", "archive"))
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "lttrain"):
        t = sub.add_parser(name)
        t.add_argument("ids", nargs="*")
        t.add_argument("-s", "--start", type=seconds, required=True)
        t.add_argument("-e", "--end", type=seconds, required=True)
        t.add_argument("--input-time", "--input_time", type=seconds, dest="input_time")
        t.add_argument("--input-id", "--inputid", dest="input_id")
        t.add_argument("--mode", choices=("auto", "manual"), default="auto")
    save = sub.add_parser("save")
    save.add_argument("ids", nargs="+")
    plot = sub.add_parser("plot")
    plot.add_argument("kind", choices=("data", "outlier", "event"))
    plot.add_argument("id")
    plot.add_argument("-s", "--start", type=seconds, required=True)
    plot.add_argument("-e", "--end", type=seconds, required=True)
    debug = sub.add_parser("debug")
    debug.add_argument("state", choices=("on", "off"))
    init = sub.add_parser("init")
    init.add_argument("satellite")
    return p


def settings(folder: str) -> dict:
    """What init wrote, with `limits` of sessions and the log level; empty without a file."""
    try:
        with open(os.path.join(folder, "config.json")) as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def plotted(engine, kind: str, channel: str, start: float, end: float):
    """Data, outliers or events of a channel in a time range."""
    from pyspark.sql import functions as F

    if kind == "data":
        return engine.plot_frame(channel, start, end)
    table, name, time = ("outliers", "mnemonic", F.col("time")) if kind == "outlier" else ("events", "id", F.col("timetag") / 1000)
    return engine.archive.read(table).where((F.col(name) == channel) & time.between(start, end)).orderBy(time)


def main(argv: list[str] | None = None) -> int:
    from .engine import Engine

    args = parser().parse_args(argv)
    if args.command == "init":
        os.makedirs(args.archive, exist_ok=True)
        with open(os.path.join(args.archive, "config.json"), "w") as f:
            json.dump({"satellite": args.satellite}, f)
        return 0
    config = settings(args.archive)
    if args.command == "debug":
        with open(os.path.join(args.archive, "config.json"), "w") as f:
            json.dump(config | {"log": "DEBUG" if args.state == "on" else "WARN"}, f)
        return 0
    spark = build()
    spark.sparkContext.setLogLevel(config.get("log", "WARN"))
    source = EventTableSource(spark, args.data)
    engine = Engine(spark, source, args.archive)
    if args.command == "plot":
        plotted(engine, args.kind, args.id, args.start, args.end).show(500, truncate=False)
        return 0
    if args.command == "save":
        print(json.dumps(engine.save(args.ids)))
        return 0
    ids = args.ids or [r.mnemonic for r in source.all().select("mnemonic").distinct().collect()]
    print(*engine.train(ids, args.start, args.end, long_term=args.command == "lttrain", input_time=args.input_time, input_id=args.input_id, manual=args.mode == "manual", **config.get("limits", {})))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
