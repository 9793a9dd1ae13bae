"""Command line: go (default), build, check, outline, risks, graph."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scan import parse_flag
from codeloom.functions.text import SEVERITIES, to_ascii
from codeloom.operators import graph, rules, score
from codeloom.plans import docs, verify
from codeloom.plans.engine import Analysis
from codeloom.sources.files import read

COMMANDS = ("go", "build", "check", "outline", "risks", "graph", "explore")


def route(argv: list[str]) -> list[str]:
    """Arguments that begin with no command are those of ``go``; help stays help."""
    return argv if argv and (argv[0] in COMMANDS or argv[0] in ("-h", "--help")) else ["go", *argv]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="*" if name in ("go", "explore") else "+", default=["."])
        c.add_argument("-D", dest="flags", action="append", default=[], metavar="NAME[=VALUE]")
        if name in ("go", "build", "explore"):
            c.add_argument("--out", default=".agentdocs")
            c.add_argument("--watch", action="store_true")
        if name in ("outline", "graph", "risks"):
            c.add_argument("--json", action="store_true")
        if name == "risks":
            c.add_argument("--min-severity", default="INFO", choices=SEVERITIES)
        if name == "graph":
            c.add_argument("--table")
            c.add_argument("--routine")
            c.add_argument("--mermaid", action="store_true")
    return p


def say(text: object) -> None:
    text = str(text)
    print(text if (sys.stdout.encoding or "").lower().startswith("utf") else to_ascii(text))


def show(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def model(a: Analysis) -> dict:
    """Everything that the analysis knows, by table, with whole cards of the routines and blocks."""
    tables = {
        "files": a.file.orderBy("file", "variant"), "units": a.unit.orderBy("file", "variant", "unit"), "declarations": a.declaration.orderBy("file", "variant", "unit", "line", "name"), "skipped": a.fact("skipped").orderBy("file", "line"), "issues": a.issue.orderBy("file", "line", "code"),
        "entities": a.er["entity"].orderBy("table_key"), "columns": a.er["col"].drop("at").orderBy("table_key", "name"), "relations": a.er["relation"].orderBy("origin", "src", "dst", "cols"), "risks": rules.ordered(a.risk), "missing": score.missing_ordered(a.missing), "scores": a.score.orderBy("owner_id"), "confidence": a.confidence,
    }
    return {"routines": [json.loads(r["json"]) for r in docs.cards(a).orderBy("id").select("json").collect()]} | {name: show(t) for name, t in tables.items()}


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    o = parser().parse_args(route(argv))
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    flags = dict(parse_flag(f) for f in o.flags)
    a = Analysis(read(spark, o.inputs), flags)
    if o.command in ("go", "build", "explore"):
        docs.write(a, o.out)
        verdict = verify.write(a, o.out)
        say(f"{verdict}: {o.out}")
        if o.watch:
            from codeloom.streaming.watch import watch

            again = lambda _: (docs.write(b := Analysis(read(spark, o.inputs), flags), o.out), say(verify.write(b, o.out)))
            watch(spark, o.inputs, again).awaitTermination()
        return int(verdict == "NOT_VERIFIED")
    if o.command == "check":
        found = show(a.fact("error").where("variant = 'primary'").orderBy("file", "line", "col"))
        for e in found:
            say(f"{e['file']}:{e['line']}:{e['col']}: {e['message']}")
        return int(bool(found))
    if o.command == "outline":
        rows = show(a.step.orderBy("owner_id", "path").select("owner_id", "number", "depth", "kind", "text", "line"))
        if o.json:
            say(json.dumps(model(a), default=str))
        else:
            last = None
            for r in rows:
                if r["owner_id"] != last:
                    say(last := r["owner_id"])
                say(f"{'  ' * r['depth']}{r['number']} {r['kind']} {r['text'][:100]}")
        return int(not a.issue.where("severity = 'ERROR'").isEmpty())
    if o.command == "risks":
        rows = show(rules.ordered(rules.at_least(a.risk, o.min_severity)))
        say(json.dumps(rows)) if o.json else [say(f"{r['severity']} {r['code']} {r['owner_id']} {r['file']}:{r['line']} {r['message']}") for r in rows]
        return 2 if any(r["severity"] == "HIGH" for r in rows) else 0
    if o.mermaid:
        say(docs.mermaid_packages(a))
    elif o.table:
        say(json.dumps(show(a.impact.where(F.upper("table_key") == o.table.upper()).orderBy("role", "node"))))
    elif o.routine:
        say(json.dumps(sorted(r["node"] for r in show(graph.reachable(a.calls, o.routine.upper())))))
    else:
        whole = {"nodes": show(a.node.orderBy("id")), "edges": show(a.edge.orderBy("src", "type", "dst")), "recursion": show(a.recursion.orderBy("component")), "uncalled": show(a.uncalled.orderBy("node")), "impact": show(a.impact.orderBy("table_key", "role", "node"))}
        say(json.dumps(whole, default=str) if o.json else f"{len(whole['nodes'])} nodes, {len(whole['edges'])} edges, {len(whole['recursion'])} recursive groups, {len(whole['uncalled'])} uncalled")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
