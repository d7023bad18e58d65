"""Results do not depend on the session time zone: event times are
timestamp_ntz and every conversion to micro-seconds is zone-free."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

NAMES = ["funnel_sends", "time_to_convert", "last_touch", "funnel_by_day", "daily_funds", "funds_trend", "stream_step_counts"]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_same_results_in_other_zones(spark, zone):
    q = E.queries()
    key = "spark.sql.session.timeZone"
    base = {n: sorted(map(tuple, q[n](spark, SF001).collect())) for n in NAMES}
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, zone)
        other = {n: sorted(map(tuple, q[n](spark, SF001).collect())) for n in NAMES}
    finally:
        spark.conf.set(key, old)
    for n in NAMES:
        assert other[n] == base[n], n
