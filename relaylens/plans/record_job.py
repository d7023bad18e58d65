"""The daily recording job (E1) as a command:

    spark-submit ... -m relaylens.plans.record_job --tables DIR --out PATH \\
        [--state PATH | --rescan] [--steps view,click,signup,purchase] [--hours 72] [--as-of YYYY-MM-DD] [--backfill]

Builds the metric table (D2) from the tables in ``DIR`` and rewrites, in the
table at ``PATH`` (partitioned by kind of metric and day), what the run has:
the cohorts still open, the last days of the ledger, and the whole-history
figures of the as-of day.  All other partitions stay as recorded.
``--as-of`` is a run on the data up to that day.  ``--backfill`` records
every day the metric table has (a first load).

A run keeps a history in ``--state`` (default: ``PATH-state``), so that later
runs read the days that can still change and fold the rest
(``relaylens.plans.incremental``).  ``--rescan`` works the figures out of all
the tables instead and keeps no history.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from relaylens.params import DEFAULT_HOURS, DEFAULT_STEPS, FunnelSpec


def run(
    spark, tables: str, out: str, spec: FunnelSpec, as_of: dt.date | None = None, backfill: bool = False, state: str | None = None
) -> list[dt.date]:
    """Record the days of a run as of the end of ``as_of`` (default: all the
    data); return them (none for a backfill, which has every day).  With
    ``state`` the run is incremental."""
    from relaylens.plans.incremental import record_daily
    from relaylens.plans.queries import Inputs
    from relaylens.sources import sink

    if state and not backfill:
        return record_daily(spark, tables, out, state, spec, as_of)
    i = Inputs(spark, tables, spec, until=as_of)
    rows, days = (i.overview(), []) if backfill else i.to_record()
    if rows is not None:
        sink.record(rows, out)
    return days


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="relaylens.plans.record_job", description=__doc__.split("\n\n")[0])
    p.add_argument("--tables", required=True, help="folder with events.parquet, orders.parquet, lineitem.parquet, ...")
    p.add_argument("--out", required=True, help="day-partitioned Parquet table to write")
    p.add_argument("--steps", default=",".join(DEFAULT_STEPS))
    p.add_argument("--hours", type=int, default=DEFAULT_HOURS)
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None, help="default: the day of the latest event")
    p.add_argument("--state", default=None, help="folder of the kept history; default: the output's name with -state")
    p.add_argument("--rescan", action="store_true", help="read all the tables, keep no history")
    p.add_argument("--backfill", action="store_true", help="record every day, not only the open ones")
    a = p.parse_args(argv)

    from relaylens.session import build_session

    spark = build_session("relaylens-record")
    spec = FunnelSpec(steps=tuple(a.steps.split(",")), hours=a.hours)
    state = None if a.rescan else a.state or f"{a.out.rstrip('/')}-state"
    days = run(spark, a.tables, a.out, spec, a.as_of, a.backfill, state)
    print(f"recorded {', '.join(map(str, days)) or 'all days' if a.backfill or days else 'nothing'} into {a.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
