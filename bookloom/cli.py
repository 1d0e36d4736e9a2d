"""Command line: list and run queries, the quality matrix, progress."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    """Runs one command; 1 if a regression was found."""
    parser = argparse.ArgumentParser(prog="bookloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--to", help="write parquet there instead of showing rows")
    evals = sub.add_parser("evals", help="the quality matrix; exit 1 if a check of the baseline broke")
    evals.add_argument("tables")
    evals.add_argument("--checks", nargs="*")
    evals.add_argument("--baseline")
    evals.add_argument("--to")
    progress = sub.add_parser("progress", help="how far each book is")
    progress.add_argument("tables")
    progress.add_argument("--book", default="")
    args = parser.parse_args(argv)

    from bookloom.operators import checks, progress as P
    from bookloom.plans import registry
    from bookloom.sources.tables import table

    if args.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("bookloom").getOrCreate()
    if args.command == "run":
        df = registry.QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.to) if args.to else df.show(50, truncate=60)
    elif args.command == "progress":
        own = P.book_progress(table(spark, args.tables, "segments"), table(spark, args.tables, "takes"))
        needle = args.book.lower().replace(" ", "_")
        own.filter(own.book_id.contains(needle)).orderBy("fraction", ascending=False).show(200, truncate=False)
    else:
        names = args.checks or list(checks.CHECKS)
        found = checks.violations(lambda name: table(spark, args.tables, name), names)
        docs = table(spark, args.tables, "pages").selectExpr("book_id as doc_id")
        results = checks.results(found, docs, names)
        if args.to:
            results.write.mode("overwrite").parquet(args.to)
            results = spark.read.parquet(args.to)
        results.groupBy("stage", "dimension", "status").count().orderBy("stage", "dimension", "status").show(200, truncate=False)
        if args.baseline:
            broke = checks.regressions(spark.read.parquet(args.baseline), results)
            broke.show(50, truncate=False)
            return int(not broke.isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
