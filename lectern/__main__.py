"""Command line: python -m lectern COMMAND ... (see --help)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description="Question analytics over a corpus, on Spark.")
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, **about) -> argparse.ArgumentParser:
        one = sub.add_parser(name, **about)
        for option in options:
            one.add_argument(option, action="store_true")
        return one

    a = add("phase-a", "--overwrite", help="papers in a folder to questions")
    a.add_argument("folder")
    a.add_argument("out")
    a.add_argument("--paper")
    a.add_argument("--personas", help="JSON file of personas with perspective and question style")
    a.add_argument("--archetypes", help="JSON file of archetypes and what each persona favours")
    a.add_argument("--log", help="shared folder that keeps every reply, so that a stopped run goes on")
    for name in ("dedup", "generalise", "validate", "consolidate"):
        one = add(name, "--overwrite", help=f"{name} step over the tables in OUT")
        one.add_argument("out")
        if name == "dedup":
            one.add_argument("--paper")
        if name == "consolidate":
            one.add_argument("--no-schema-format", action="store_true")
            one.add_argument("--list-models", action="store_true")
            one.add_argument("--dump-schema", action="store_true")
    g = add("aggregate", help="corpus summary of evaluation files")
    g.add_argument("--eval-dir", required=True)
    g.add_argument("--out")
    t = add("rich-text", "--no-figures", help="markdown preview of a document's text")
    t.add_argument("path")
    args = parser.parse_args(argv)
    return run(args)


def _backend():
    import os

    from .sources.backends import HeuristicBackend, HttpBackend

    url = os.environ.get("LECTERN_MODEL_URL")
    return HttpBackend(url, os.environ.get("LECTERN_MODEL", "default")) if url else HeuristicBackend()


def _who(spark, args: argparse.Namespace) -> tuple:
    """Personas, with perspective and style where a file has them, and the archetypes suggested to each (none without a file)."""
    from .operators import validation
    from .plans.text_queries import personas
    from .sources import files

    def read(path: str) -> str:
        return spark.read.option("wholetext", True).text(path).first()[0]

    who = files.persona_table(spark, read(args.personas)) if args.personas else personas(spark)
    if not args.archetypes:
        return who, None
    known, liked = files.archetype_tables(spark, read(args.archetypes))
    return who, validation.persona_archetypes(who.select("persona"), liked, known)


def run(args: argparse.Namespace) -> int:
    from .operators import replies, report
    from .plans import flows
    from .session import local_session
    from .sources import files, pdf, sinks
    from .sources.calls import Caller, ReplyLog

    if args.command == "consolidate" and args.dump_schema:
        print(replies.CONSOLIDATION_SCHEMA)
        return 0
    spark = local_session()
    if args.command == "aggregate":
        rows = files.evaluations(spark, args.eval_dir)
        summary = report.metric_summary(rows)
        report.console_table(rows.orderBy("paper_id"), [("paper_id", 24, -1), ("n_questions", 6, 0), ("overall", 8, 3), ("coverage", 8, 3), ("faithfulness", 8, 3), ("diversity", 8, 3)]).show(1000, False)
        summary.show(truncate=False)
        report.totals(rows).show()
        if args.out:
            sinks.write_once(summary, args.out, overwrite=True)
        return 0
    if args.command == "rich-text":
        if args.path.lower().endswith(".pdf"):
            sheets = pdf.read(spark, args.path)
            shown = None if args.no_figures else pdf.figures(sheets).select("path", "page", "ord", F.lit(None).cast("string").alias("caption"))
            for r in sheets.where("error is not null").select("page", "error").collect():
                print(f"page {r.page}: {r.error}" if r.page else r.error, file=sys.stderr)
            for r in pdf.page_markdown(pdf.lines(pdf.spans(sheets)), shown).orderBy("page").toLocalIterator():
                print(r.markdown, end="\n\n")
            return 0
        rows = files.read_texts(spark, args.path)
        print("\n".join(r.text or r.error for r in rows.limit(1).collect()))
        return 0
    table = lambda name: spark.read.parquet(f"{args.out}/{name}")
    keep = lambda name, df, by=None: sinks.write_once(df, f"{args.out}/{name}", args.overwrite, by)
    if args.command == "phase-a":
        papers = files.read_texts(spark, args.folder).where("text is not null").withColumn("name", F.substring_index("path", "/", -1))
        papers = papers.withColumn("paper_id", F.regexp_replace("name", r"\.[^.]*$", ""))
        papers = files.target_paper(papers, args.paper) if args.paper else papers
        who, liked = _who(spark, args)
        backend = Caller(_backend(), log=ReplyLog(args.log)) if args.log else _backend()
        for name, df in flows.phase_a(papers.select("paper_id", "text"), who, backend, archetypes=liked).items():
            bad = flows.validation.corrupt_papers(df) if name == "questions" else None
            if name == "evaluation":  # what `aggregate --eval-dir` reads
                sinks.export_records(df, f"{args.out}/{name}")
                continue
            keep(name, df if bad is None else df.join(bad.select("paper"), "paper", "left_anti"))
        return 0
    if args.command == "dedup":
        rows = table("questions")
        rows = rows.where(F.col("paper") == args.paper) if args.paper else rows
        done = flows.dedup(rows, _backend())
    elif args.command == "generalise":
        done = {f"general_{k}": v for k, v in flows.generalise(table("representatives"), _backend()).items()}
    elif args.command == "validate":
        done = {f"validation_{k}": v for k, v in flows.validate(table("general_groups"), table("general_members"), table("representatives"), table("chunks"), _backend()).items()}
    else:
        if args.list_models:
            print(getattr(_backend(), "model", "heuristic rules (no model)"))
            return 0
        done = flows.consolidate(table("general_groups"), table("general_members"), table("representatives"), _backend(), constrained=not args.no_schema_format)
    for name, df in done.items():
        keep(name, df)
    return 0


if __name__ == "__main__":
    sys.exit(main())
