"""Command line: info, validate, eval, backtest and stream."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .engine import EngineConfig, RuleEngine
from .errors import RuleEngineError


def _spark(args):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(args.master).appName("sparkrules").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _say(value) -> None:
    print(json.dumps(value, default=str))


def _engine(path: str, config: EngineConfig | None = None) -> RuleEngine:
    return RuleEngine(config).load_rules(path)


def _output(evaluation, mode: str) -> list[dict]:
    """What eval prints, by output mode; row outputs are streamed to the driver."""
    match mode:
        case "summary":
            return evaluation.counts().collect()
        case "rule-counts":
            return evaluation.rule_counts().collect()
        case "grouped-decisions":
            return evaluation.decision_counts().collect()
        case "bitmasks":
            return evaluation.bitmasks().toLocalIterator()
        case "decisions-jsonl":
            return evaluation.decisions().toLocalIterator()
    return []


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkrules", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    v = sub.add_parser("validate")
    v.add_argument("rules")
    e = sub.add_parser("eval")
    e.add_argument("rules")
    e.add_argument("input")
    e.add_argument("--format", default="auto", help="auto, parquet, csv, ndjson, json-array, arrow, avro; - reads NDJSON from standard input")
    e.add_argument("--output", default="summary", choices=["none", "summary", "rule-counts", "grouped-decisions", "bitmasks", "decisions-jsonl"])
    e.add_argument("--clock", help="time field for windows")
    e.add_argument("--write", help="write decisions to this path as Parquet")
    b = sub.add_parser("backtest")
    for name in ("rules_a", "rules_b", "input"):
        b.add_argument(name)
    b.add_argument("--label")
    s = sub.add_parser("stream")
    for name in ("rules", "input", "output", "checkpoint"):
        s.add_argument(name)
    args = p.parse_args(argv)
    try:
        return COMMANDS[args.command](args)
    except RuleEngineError as error:
        print(error, file=sys.stderr)
        return 1


def info(args) -> int:
    import pyspark

    _say({"version": __version__, "spark": pyspark.__version__})
    return 0


def validate(args) -> int:
    engine = _engine(args.rules)
    found = engine.analyze_conflicts().findings
    _say({"rules": len(engine.ruleset.rules), "findings": [f.__dict__ for f in found]})
    return 0


def evaluate(args) -> int:
    from .sources.files import format_of, read_files
    from .sources.ingest import json_array_files, lines_of, messages

    spark, engine = _spark(args), _engine(args.rules)
    fmt = "ndjson" if args.input == "-" else format_of(args.input) if args.format == "auto" else args.format
    if fmt in ("ndjson", "json-array"):
        lines = messages(spark, sys.stdin.read().splitlines()) if args.input == "-" else json_array_files(spark, args.input) if fmt == "json-array" else lines_of(spark, args.input)
        done = engine.evaluate_ndjson(lines, clock=args.clock)
    else:
        done = engine.evaluate(read_files(spark, args.input, fmt), clock=args.clock)
    if args.write:
        done.decisions().write.mode("overwrite").parquet(args.write)
    for row in _output(done, args.output):
        _say(row.asDict(recursive=True))
    if done.rejected is not None and args.output == "summary":
        _say({"skipped": done.rejected.count()})
    return 0


def run_backtest(args) -> int:
    from .operators.backtest import backtest
    from .sources.files import read_files

    summary, rules = backtest(read_files(_spark(args), args.input), _engine(args.rules_a), _engine(args.rules_b), args.label)
    _say(summary.first().asDict())
    for row in rules.collect():
        _say(row.asDict())
    return 0


def stream(args) -> int:
    from .streaming.run import StreamRunner, run_stream
    from .streaming.state import WindowState

    spark = _spark(args)
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{args.output}/batch={n}")
    bad = lambda df, n: df.write.mode("overwrite").json(f"{args.output}-rejected/batch={n}")
    runner = StreamRunner(_engine(args.rules), sink, WindowState(spark, f"{args.checkpoint}/windows"), dead_letter=bad, ndjson=True)
    run_stream(spark.readStream.text(args.input), runner, f"{args.checkpoint}/query").awaitTermination()
    return 0


COMMANDS = {"info": info, "validate": validate, "eval": evaluate, "backtest": run_backtest, "stream": stream}
