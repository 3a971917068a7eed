"""``python -m sluicelog.cli query|job|cluster|anomaly ...``: read a table from logs, work on it, write the result."""

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import jobs, sinks
from .operators import features
from .session import get_session
from .sources.registry import read_table
from .sql import run_sql


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluicelog")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--tool", required=True, help="the logs' origin, for instance Bro")
        p.add_argument("--table", required=True, choices=["DNS", "HTTP", "NamedFlows"])
        p.add_argument("--input", required=True, help="folder of the logs")
        p.add_argument("--start", required=True, help="first day, YYYY_MM_DD")
        p.add_argument("--end", required=True, help="last day, included")
        return p

    query = command("query")
    query.add_argument("--query", required=True, help="SQL over the view records")
    to = query.add_mutually_exclusive_group(required=True)
    to.add_argument("--output", help="folder for CSV files")
    to.add_argument("--local-output", help="one CSV file on the driver's disk")
    job = command("job")
    job.add_argument("--job", required=True, choices=sorted(jobs.JOBS))
    job.add_argument("--parameters", type=json.loads, default={}, help="JSON object")
    job.add_argument("--output", required=True)
    for name, known in (("cluster", jobs.CLUSTERINGS), ("anomaly", jobs.DETECTORS)):
        p = command(name)
        p.add_argument("--algorithm", required=True, choices=sorted(known))
        p.add_argument("--parameters", type=json.loads, default={}, help="JSON object")
        p.add_argument("--query", help="SQL over the view records, to run first")
        p.add_argument("--output", required=True)
        if name == "cluster":
            p.add_argument("--numerical", type=lambda x: x.split(","), default=[])
            p.add_argument("--categorical", type=lambda x: x.split(","), default=[])
            p.add_argument("--normalize", action="store_true")
            p.add_argument("--normalize-p", type=float, default=2.0)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one command."""
    a = _parser().parse_args(argv)
    spark = spark or get_session()
    df: DataFrame = read_table(spark, a.tool, a.table, a.input, a.start, a.end)
    if a.command == "query":
        out = run_sql(df, a.query)
        sinks.to_csv(out, a.output) if a.output else sinks.to_local_csv(out, a.local_output)
    elif a.command == "job":
        out = jobs.run_job(a.job, df, a.parameters)
        cps = [c for c in out.columns if c.startswith("cp_")]
        sinks.to_visits(out, a.output) if cps else sinks.save(out, a.output) if a.job == "Print" else sinks.to_report(out, a.output)
    elif a.command == "cluster":
        ready = features.transform(df, a.query, a.numerical, a.categorical, a.normalize, a.normalize_p)
        sinks.to_labelled(jobs.CLUSTERINGS[a.algorithm](ready, **a.parameters), a.output)
    else:
        sinks.to_csv(jobs.DETECTORS[a.algorithm](run_sql(df, a.query) if a.query else df, **a.parameters), a.output, header=True)


if __name__ == "__main__":
    main()
