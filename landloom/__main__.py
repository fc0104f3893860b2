"""``python -m landloom FOLDER OUT [--query NAME ...] [--from NAME] [--to NAME] [--overwrite]``: queries over the tables of a
folder, each stored as Parquet; a stored result is used again.  Ends with 1 where a query failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import registry, steps


def main(args: list[str] | None = None) -> int:
    said = argparse.ArgumentParser(prog="landloom", description=__doc__)
    said.add_argument("folder")
    said.add_argument("out")
    said.add_argument("--query", action="append", help="one query; all in their order without it")
    said.add_argument("--from", dest="start")
    said.add_argument("--to", dest="stop")
    said.add_argument("--overwrite", action="store_true")
    said.add_argument("--list", action="store_true", help="only say which queries there are")
    own = said.parse_args(args)
    queries = registry.queries()
    if own.list:
        print("\n".join(sorted(queries)))
        return 0
    if unknown := set(own.query or ()) - set(queries):
        said.error(f"no such query: {', '.join(sorted(unknown))}")
    spark = SparkSession.builder.appName("landloom").getOrCreate()
    plan = {n: (lambda spark, _, f=queries[n]: f(spark, own.folder)) for n in own.query or queries}
    _, status = steps.run(spark, plan, own.out, own.start, own.stop, own.overwrite)
    status.show(len(plan), truncate=120)
    return steps.exit_code(status)


if __name__ == "__main__":
    sys.exit(main())
