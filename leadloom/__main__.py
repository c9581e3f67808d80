"""Command line: ``python -m leadloom queries | run NAME DIR [--out DIR] | list CSV OUT [--blocked FILE]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries
from .plans.pipeline import LeadRules, lead_list
from .sources import files, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leadloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries of the core")
    run = sub.add_parser("run", help="run a query over a data folder")
    run.add_argument("name", choices=sorted(queries.queries()))
    run.add_argument("folder")
    run.add_argument("--out", help="Parquet folder for the result; shown if missing")
    ls = sub.add_parser("list", help="turn a lead CSV of any header spelling into a ranked lead list")
    ls.add_argument("csv")
    ls.add_argument("out")
    ls.add_argument("--blocked", help="text file of blocked domains")
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(queries.queries())))
        return 0
    spark = SparkSession.builder.appName("leadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        df = queries.queries()[a.name](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=60)
        return 0
    blocked = [r.domain for r in files.read_blocklist(spark, a.blocked).collect()] if a.blocked else []  # a list kept by hand
    made = lead_list(files.read_csv(spark, a.csv), LeadRules(blocked=blocked))
    sinks.write_csv(made.orderBy(F.desc("label_order"), F.desc("score"), "seq"), a.out, columns=["name", "url", "city", "score", "grade", "label"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
