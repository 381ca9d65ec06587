"""python -m tallyforge VERB: queries of the entry module, corpora and their audits, from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    run = verbs.add_parser("run", help="run a query over the tables of a folder, and write or show its result")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="folder for Parquet; without it the first rows are shown")
    make = verbs.add_parser("generate", help="write the generated corpus as JSON lines")
    make.add_argument("out")
    audit = verbs.add_parser("validate", help="audit a corpus of JSON lines; exit 1 if there are issues")
    audit.add_argument("corpus")
    estimate = verbs.add_parser("estimate", help="worst-case calls of a configuration")
    estimate.add_argument("config")
    a = parser.parse_args(arguments)

    from tallyforge.plans import QUERIES

    if a.verb == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.verb == "estimate":
        from tallyforge.functions import config

        found = config.load_config(a.config)
        print(config.canonical({"calls_per_example": config.calls_per_example(found), "budget": config.budget(found), "problems": config.check_strategy(found)}))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "run":
        if a.name not in QUERIES:
            parser.error(f"no query {a.name}")
        df = QUERIES[a.name](spark, a.tables)
        df.write.mode("errorifexists").parquet(a.out) if a.out else df.show(20, truncate=80)
        return 0
    if a.verb == "generate":
        from tallyforge.sources.corpus import build

        build(spark).write.mode("errorifexists").json(a.out)
        return 0
    from tallyforge import reports
    from tallyforge.operators import quality
    from tallyforge.sources.files import read_jsonl

    issues = quality.example_issues(read_jsonl(spark, a.corpus).where("bad_line is null"))
    print(reports.markdown(issues))
    return int(not issues.isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
