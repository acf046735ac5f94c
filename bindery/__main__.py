"""``python -m bindery scan|enrich|integrate``: the three batch jobs."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from bindery.config import Settings
from bindery.plans import pipeline
from bindery.session import session, ship
from bindery.sources.http import Client
from bindery.operators.survivorship import Policy


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bindery")
    jobs = top.add_subparsers(dest="job", required=True)
    scan = jobs.add_parser("scan", help="search pages to an envelope of records")
    scan.add_argument("--url", required=True, help="address of the search page")
    scan.add_argument("--query", required=True)
    scan.add_argument("--out", required=True)
    scan.add_argument("--max-records", type=int, default=15)
    scan.add_argument("--max-pages", type=int, default=3)
    scan.add_argument("--pause", type=float, default=0.8)
    enrich = jobs.add_parser("enrich", help="look records up; the key is read from the environment")
    enrich.add_argument("--url", required=True, help="address of the volume search")
    enrich.add_argument("--records", required=True)
    enrich.add_argument("--out", required=True)
    enrich.add_argument("--compat", action="store_true")
    integrate = jobs.add_parser("integrate", help="integrate records and volumes")
    integrate.add_argument("--records", required=True)
    integrate.add_argument("--volumes", required=True)
    integrate.add_argument("--out", required=True)
    integrate.add_argument("--compat", action="store_true")
    return top


def main(arguments: list[str] | None = None, env: dict[str, str] | None = None) -> None:
    asked = parser().parse_args(arguments)
    settings = Settings.from_env(env) if asked.job == "enrich" else None
    spark = session()
    ship(spark)
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    if asked.job == "scan":
        pipeline.run_scan(spark, Client(attempts=5, backoff=0.6), asked.url, asked.query, asked.out, now, asked.max_records, asked.max_pages, asked.pause)
    elif asked.job == "enrich":
        pipeline.run_enrich(spark, Client(), asked.url, asked.records, asked.out, settings, asked.compat)
    else:
        pipeline.run(spark, asked.records, asked.volumes, asked.out, now, Policy(compat=asked.compat))


if __name__ == "__main__":
    main()
