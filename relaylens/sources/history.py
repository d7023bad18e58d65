"""What a recorded history keeps between daily runs.

Under one folder per funnel (steps and window are part of its name):

* ``cohorts/start=...``    per closed send day: sends and reach counts;
* ``durations/start=...``  per closed send day: KLL sketches of the seconds to
  convert;
* ``funds/start=...``      per closed ledger day: money and movements each way,
  payers first seen that day, an HLL sketch of the day's payers;
* ``events-N/bucket=...``  the seen-event index: id, type and first day of
  every funnel-step event of the closed days, in N hash buckets, sorted by id;
* ``payers-N/bucket=...``  the seen-payer index: party and first inflow day;
* ``progress``           a row per finished run: how far days are closed.

The day tables hold mergeable partials: counts and money add up, sketches
merge, so whole-history figures are a fold of a few rows per day.  A run
closes the days from where the finished run before it stopped, and its rows
are the partition of that first day; they are written by dynamic partition
overwrite, so a run that is repeated replaces what it wrote before, and no day
lies in two partitions.  The indexes are sets: rows written twice change
nothing, and every read names the day before which rows count, so rows of an
unfinished run are not seen.  ``progress`` is appended last; a run that dies
before leaves the history at the run before it.

Index reads touch only the buckets that the asking ids hash to (folders) and,
inside a file sorted by id, the row groups whose range meets theirs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions import MONEY_TOTAL
from relaylens.operators.funnel import reached_col
from relaylens.params import FunnelSpec

BUCKETS = 32
#: The partition of the first run, which closes days from the beginning.
BEGINNING = dt.date(1900, 1, 1)
PROGRESS = "closed_until date, funds_until date, as_of timestamp_ntz, ledger_day date"
DURATIONS = "step_index int, step string, measure string, n long, secs_sketch binary, day date"
FUNDS = f"inflow {MONEY_TOTAL}, outflow {MONEY_TOTAL}, n_in long, n_out long, new_payers long, payers_sketch binary, day date"


class SeenIndex:
    """Keys with the first day they were seen, in hash buckets on disk.

    ``key`` names the columns; the first is the id files are sorted by."""

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, f"{path}-{buckets}", key, buckets

    @property
    def names(self) -> list[str]:
        return list(self.key)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.names[0]), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, keys: DataFrame) -> None:
        """Append keys (with ``day``): a few sorted files per bucket."""
        rows = keys.where(F.col(self.names[0]).isNotNull()).select(*self.names, "day", self._bucket())
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.names[0]).write.mode("append").partitionBy(
            "bucket"
        ).parquet(self.path)

    def rows(self) -> DataFrame | None:
        schema = ", ".join(f"{k} {t}" for k, t in self.key.items())
        return read_if_there(self.spark, self.path, f"{schema}, day date, bucket int")

    def matching(self, asking: DataFrame, before: dt.date) -> DataFrame | None:
        """The index rows of days before ``before`` that can hold a key of
        ``asking``: only its buckets (at most ``buckets`` numbers come to the
        driver) and only its range of ids."""
        seen = self.rows()
        if seen is None:
            return None
        first = self.names[0]
        met = asking.where(F.col(first).isNotNull()).groupBy(self._bucket()).agg(F.min(first), F.max(first)).collect()
        if not met:
            return None
        low, high = min(r[1] for r in met), max(r[2] for r in met)
        return seen.where(F.col("bucket").isin([r[0] for r in met]) & F.col(first).between(low, high) & (F.col("day") < F.lit(before)))

    def unseen(self, rows: DataFrame, before: dt.date) -> DataFrame:
        """``rows`` whose key was not seen on a day before ``before``."""
        seen = self.matching(rows, before)
        if seen is None:
            return rows
        return rows.join(seen.select(*self.names), self.names, "left_anti").select(rows.columns)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class History:
    def __init__(self, spark: SparkSession, path: str, spec: FunnelSpec, buckets: int = BUCKETS):
        self.spark, self.spec = spark, spec
        self.path = f"{path.rstrip('/')}/{'-'.join(spec.steps)}-{spec.hours}h"
        self.events = SeenIndex(spark, f"{self.path}/events", {"event_id": "long", "event_type": "string"}, buckets)
        self.payers = SeenIndex(spark, f"{self.path}/payers", {"party_id": "long"}, buckets)

    @property
    def _cohorts(self) -> str:
        return ", ".join(f"{c} long" for c in self.count_columns) + ", day date"

    @property
    def count_columns(self) -> list[str]:
        return ["sends"] + [reached_col(s) for s in self.spec.later]

    def progress(self):
        """The last finished run, or None: one row of a table with a row per
        run."""
        rows = read_if_there(self.spark, f"{self.path}/progress", PROGRESS)
        if rows is None:
            return None
        return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).where(F.coalesce("closed_until", "funds_until").isNotNull()).first()

    def advance(self, closed_until, funds_until, as_of, ledger_day) -> None:
        """Mark a run as finished."""
        row = self.spark.createDataFrame([(closed_until, funds_until, as_of, ledger_day)], PROGRESS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/progress")

    def _closed(self, name: str, schema: str, before: dt.date | None) -> DataFrame:
        rows = read_if_there(self.spark, f"{self.path}/{name}", f"{schema}, start date")
        if rows is None or before is None:
            return self.spark.createDataFrame([], schema)
        # partitions from there on are an unfinished run's, about to be replaced
        return rows.where((F.col("start") < F.lit(before)) & (F.col("day") < F.lit(before))).drop("start")

    def cohorts(self, before: dt.date | None) -> DataFrame:
        """Closed send days before a day: a row each."""
        return self._closed("cohorts", self._cohorts, before)

    def durations(self, before: dt.date | None) -> DataFrame:
        return self._closed("durations", DURATIONS, before)

    def funds(self, before: dt.date | None) -> DataFrame:
        """Closed ledger days before a day: a row each."""
        return self._closed("funds", FUNDS, before)

    def keep(self, name: str, rows: DataFrame, first: dt.date | None) -> None:
        """Write the days a run closes from ``first`` on (None: from the
        beginning), replacing what an unfinished run wrote: a row or a few per
        day of the calendar, so one file."""
        start = F.lit(first or BEGINNING).alias("start")
        rows.select("*", start).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "start"
        ).parquet(f"{self.path}/{name}")
