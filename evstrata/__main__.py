"""Inspection commands: ``python -m evstrata COMMAND DATASET...``.

count    entries of each level (``--hr`` in words)
config   parameter sets (``-M`` modules, ``-S`` services, ``-P`` processes, ``--filter`` labels)
info     ``--event-list``, ``--file-index``, ``--process-history``, ``--range-of-validity full|compact``, ``--db-to-file FOLDER``
sizes    stored bytes by column (``--fraction`` of the whole at least)
metadata catalog metadata as JSON (``--hr`` as text)

The exit code is the number of data sets that could not be read, at most 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .functions.text import json_value
from .operators import provenance, ranges, report
from .plans.session import new_session
from .sources.dataset import DataSet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evstrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in ("count", "config", "info", "sizes", "metadata")}
    for c in commands.values():
        c.add_argument("paths", nargs="+")
    commands["count"].add_argument("--hr", action="store_true")
    commands["metadata"].add_argument("--hr", action="store_true")
    kind = commands["config"].add_mutually_exclusive_group()
    for flag, value in (("-M", "module"), ("-S", "service"), ("-P", "process")):
        kind.add_argument(flag, dest="kind", action="store_const", const=value, default="module")
    commands["config"].add_argument("--filter", default=".*")
    one = commands["info"].add_mutually_exclusive_group()
    one.add_argument("--event-list", action="store_true")
    one.add_argument("--file-index", action="store_true")
    commands["info"].add_argument("--process-history", action="store_true")
    commands["info"].add_argument("--range-of-validity", choices=("full", "compact"))
    commands["info"].add_argument("--db-to-file")
    commands["sizes"].add_argument("--fraction", type=float, default=0.05)
    return p


def lines(args: argparse.Namespace, data: DataSet):
    """The lines that a command prints for a data set, streamed from the executors."""
    if args.command == "count":
        counts = report.count_entries(data.level("events"), has_results=data.results() is not None)
        yield from (r["report"] for r in report.count_entries_text(counts).toLocalIterator()) if args.hr else (json.dumps(r.asDict()) for r in counts.toLocalIterator())
    elif args.command == "config":
        sets = data.sidecar("parameter_sets")
        if sets is not None:
            yield from (f"{r['label']}: {{ {r['body']} }}" for r in report.configurations(sets, args.kind, args.filter).orderBy("label").toLocalIterator())
    elif args.command == "metadata":
        rows = data.sidecar("catalog_metadata").withColumn("json", json_value(F.col("value"))).orderBy("file_no", "seq")
        last = None
        held: list[str] = []
        for r in rows.toLocalIterator():
            if args.hr:
                yield f"{r['file_no']}\t{r['name']}: {r['value']}"
                continue
            if last is not None and r["file_no"] != last:
                yield "{" + ", ".join(held) + "}"
                held = []
            last = r["file_no"]
            held.append(f"{json.dumps(r['name'])}: {r['json']}")
        if held:
            yield "{" + ", ".join(held) + "}"
    elif args.command == "info":
        if args.event_list or args.file_index:
            index = data.sidecar("file_index").orderBy("file_no", "position")
            index = index.filter("entry_type = 'event'") if args.event_list else index
            yield from (f"{r['file_no']}\t{r['run']}\t{r['subrun']}\t{r['event']}\t{r['entry_type']}\t{r['entry']}" for r in index.toLocalIterator())
        if args.process_history and (history := data.sidecar("process_history")) is not None:
            yield from (f"{r['letter']}. {r['processes']}" for r in provenance.histories(history).orderBy("history_id").toLocalIterator())
        if args.range_of_validity:
            find = ranges.full_ranges if args.range_of_validity == "full" else ranges.compact_ranges
            yield from (f"run {r['run']} subrun {r['subrun']} [{r['begin']},{r['end']})" for r in find(data.level("events")).orderBy("run", "subrun", "begin").toLocalIterator())
        if args.db_to_file:
            yield from (f"wrote {name}" for name in data.export(args.db_to_file))
    elif args.command == "sizes":
        events = data.level("events")
        yield from (f"{r['bytes']}\t{r['fraction']:.4f}\t{r['column_name']}" for r in report.column_sizes(events, args.fraction).orderBy("rank").toLocalIterator())


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or new_session("evstrata")
    failed = 0
    for path in args.paths:
        try:
            data = DataSet.open(spark, path)
            for line in lines(args, data):
                print(line)
        except Exception as e:  # the next data set may be sound
            failed += 1
            print(f"{path}: {e}", file=sys.stderr)
    return min(1, failed)


if __name__ == "__main__":
    sys.exit(main())
