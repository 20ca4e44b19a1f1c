"""python -m siftwell.migrate SOURCE DESTINATION [--batch N --report FILE]: copy a corpus between two stores, resumable and verified."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftwell.operators.migration import StoreEndpoint, migrate
from siftwell.session import local_session
from siftwell.sources.store import Store


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftwell.migrate")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("--batch", type=int, default=256)
    p.add_argument("--report", help="also write the report to this file")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    report = migrate(StoreEndpoint(Store(spark, a.source)), StoreEndpoint(Store(spark, a.destination)), a.batch).to_json()
    if a.report:
        with open(a.report, "w") as f:
            f.write(report)
    print(report)


if __name__ == "__main__":
    main()
