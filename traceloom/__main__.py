"""Command line: index, match, query, eval, triage and dump over stored corpora."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import render
from traceloom.operators import corpus
from traceloom.operators.shared import materialize
from traceloom.plans import index, reports
from traceloom.plans.shipping import ship


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="traceloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(title: str, about: str, /, **args: str) -> argparse.ArgumentParser:
        made = sub.add_parser(title, help=about, description=about)
        for arg, text in args.items():
            made.add_argument(arg, help=text)
        return made

    c = command("index", "Fingerprint functions from their traces.", functions="executable files, or a Parquet table of functions", traces="Parquet table of traces, by func_id or by binary and entry")
    c.add_argument("-o", "--out", help="corpus to append to; it is created if missing")
    c.add_argument("--binary", help="label of all rows, in place of the files' names")
    command("match", "Compare two versions by function name.", a="first corpus", b="second corpus")
    c = command("query", "Name unknown functions from a corpus.", target="corpus of the unknown functions")
    c.add_argument("--corpus", required=True)
    c.add_argument("--threshold", type=float, default=C.QUERY_THRESHOLD)
    command("eval", "Measure how well functions of one corpus are found in another.", a="queries", b="corpus")
    c = command("triage", "Weigh functions between a vulnerable and a patched corpus.", target="corpus to look through")
    for side in ("--vuln", "--patched"):
        c.add_argument(side, required=True)
    c.add_argument("--min-sim", type=float, default=C.TRIAGE_MIN_SIMILARITY)
    c.add_argument("--margin", type=float, default=C.TRIAGE_MARGIN)
    command("dump", "Show the traces of a function.", functions="Parquet table of functions", traces="Parquet table of traces", name="name of the function")
    return p


def _index(spark: SparkSession, args: argparse.Namespace) -> None:
    traces = spark.read.parquet(args.traces)
    if {"binary", "entry"} <= set(traces.columns) and "func_id" not in traces.columns:
        made = index.index_files(spark, args.functions, index.traces_provider(traces))
    else:
        made = index.from_traces(spark.read.parquet(args.functions).withColumnRenamed("id", "func_id"), traces)
    if args.binary:
        made = made.withColumn("binary", F.lit(args.binary))
    made = materialize(made, "index")
    s = corpus.index_summary(made, None).first()
    print(f"indexed {s.functions}: {s.named} with a name, {s.usable} that can be looked up")
    if args.out:
        print(f"appended {corpus.append(spark, args.out, made)} to {args.out}")


def _shown(text: str):
    return render.escape(F.col(text)).alias(text)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("traceloom").getOrCreate()
    ship(spark)
    load = lambda path: index.load_index(spark, path)
    if args.command == "index":
        _index(spark, args)
    elif args.command == "match":
        found = materialize(reports.match_by_name(load(args.a), load(args.b)), "match")
        n = reports.match_summary(found).first()
        print(f"compared: {n.compared} (same {n.same}, changed {n.changed}, low signal {n.low_signal}); only in {args.a}: {n.only_a}; only in {args.b}: {n.only_b}")
        for r in reports.match_changed(found).select(_shown("name"), render.percent(F.col("similarity")).alias("p")).collect():
            print(f"  {r.p}  {r.name}")
    elif args.command == "query":
        found = reports.query(load(args.target), load(args.corpus), args.threshold)
        shown = found.select(render.hex_entry(F.col("entry")).alias("at"), render.percent(F.col("similarity")).alias("p"), _shown("guess"), _shown("from_binary"))
        none = True
        for r in shown.toLocalIterator():
            none = False
            print(f"  {r['at']}  {r.p}  {r.guess}  ({r.from_binary})")
        if none:
            print(f"nothing in {args.corpus} reaches {args.threshold:.2f}")
    elif args.command == "eval":
        found = reports.evaluate(reports.evaluate_ranks(load(args.a), load(args.b)))
        counts = ("scored", "rank1", "tp", "fp", "fn", "abstained", "mrr")
        shown = found.select(*(F.col(c).cast("string").alias(c) if c in counts else render.percent(F.col(c)).alias(c) for c in found.columns))
        for k, v in shown.first().asDict().items():
            print(f"{k}: {v.strip()}")
    elif args.command == "triage":
        hits = materialize(reports.triage(load(args.target), load(args.vuln), load(args.patched), args.min_sim, args.margin), "triage")
        for k, v in reports.triage_counts(hits).first().asDict().items():
            print(f"{k}: {v}")
        sides = [render.percent(F.col(f"{t}_similarity")).alias(f"{t}_p") for t in ("vuln", "patched")]
        lead = F.format_string("%+.1f", F.col("lead") * 100).alias("by")
        for r in reports.review_queue(hits).withColumns({"at": render.hex_entry(F.col("entry"))}).select("at", *sides, lead, _shown("vuln_name"), _shown("patched_name")).toLocalIterator():
            print(f"  {r['at']}  vulnerable {r.vuln_p} {r.vuln_name}  patched {r.patched_p} {r.patched_name}  lead {r.by}")
    else:
        functions, traces = spark.read.parquet(args.functions), spark.read.parquet(args.traces)
        for r in reports.dump(traces, functions, args.name).orderBy("path", "line_no").toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
