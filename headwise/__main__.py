"""Commands over pings and published tables; `python -m headwise COMMAND --help` names the options.

    run         pings to tables, checked and published (also without a command, as `python -m headwise --input ...`)
    check       all checks of the published tables; exit code 2 if one fails
    report      answers to the report questions, stored beside the tables
    reconcile   stored answers against the tables; exit code 2 if a number differs or is missing
    load        published tables into a catalog database, all or none
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from headwise.plans import job
from headwise.sources import tables


def _arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="headwise", description="Transit reliability tables from stop arrivals")
    commands = parser.add_subparsers(dest="command", required=True)
    every = {name: commands.add_parser(name) for name in ("run", "check", "report", "reconcile", "load")}
    for name, command in every.items():
        if name == "run":
            command.add_argument("--input", required=True, help="directory of pings")
        if name == "report":
            command.add_argument("--input", help="directory of pings, for schedules over all of them")
        command.add_argument("--output", required=True, help="directory of the tables")
    every["run"].add_argument("--timing-file", help="write stage seconds to this JSON file")
    every["run"].add_argument("--publish-failed", action="store_true", help="publish even if checks fail")
    every["load"].add_argument("--database", required=True, help="catalog database")
    return parser.parse_args(given if given and given[0] in {*every, "-h", "--help"} else ["run", *given])


def _failures(rows: DataFrame) -> int:
    """Print what doesn't pass (at most 100 rows); 2 if anything doesn't."""
    bad = rows.where("not passed").limit(100).collect()
    for row in bad:
        print(json.dumps(row.asDict()), file=sys.stderr)
    return 2 if bad else 0


def main() -> int:
    args = _arguments(sys.argv[1:])
    spark = SparkSession.builder.appName("headwise").getOrCreate()
    try:
        if args.command == "check":
            return _failures(job.check(spark, args.output))
        if args.command == "report":
            print(json.dumps({"answers": job.write_reports(spark, args.input, args.output)}))
            return 0
        if args.command == "reconcile":
            return _failures(job.reconcile(spark, args.output))
        if args.command == "load":
            print(json.dumps({"loaded": tables.load_catalog(spark, args.output, args.database)}))
            return 0
        seconds = job.run_from_paths(spark, args.input, args.output, publish_failed=args.publish_failed)
    except FileNotFoundError as error:
        print(error, file=sys.stderr)
        return 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"no pings at {args.input}", file=sys.stderr)
        return 1
    except job.QualityError as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps({"stages": seconds, "total": sum(seconds.values())}))
    if args.timing_file:
        with open(args.timing_file, "w") as file:
            json.dump(seconds, file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
