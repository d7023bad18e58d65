"""The skew-safe as-of lookup on hand-made rows, across slice boundaries."""

import pytest
from pyspark.sql import functions as F

from relaylens.operators.asof import next_after

H = 3_600_000_000  # one hour in micro-seconds


def frames(spark, queries, events):
    q = spark.createDataFrame(queries, "qid int, user_id long, t long")
    e = spark.createDataFrame(events, "user_id long, us long")
    return q, e


@pytest.mark.parametrize("slice_h", [1, 3, 1000])
def test_forward_and_backward(spark, slice_h):
    # user 1: events at 0.5h, 1.0h (slice boundary), 5.5h; nothing in slices 2-4
    events = [(1, int(0.5 * H)), (1, 1 * H), (1, int(5.5 * H)), (2, 3 * H)]
    queries = [
        (1, 1, 0),  # next 0.5h, prev none
        (2, 1, int(0.5 * H)),  # tie with an event: strictly after -> 1.0h; before -> none
        (3, 1, int(1.5 * H)),  # empty slices ahead -> 5.5h; before -> 1.0h
        (4, 1, 6 * H),  # none after; before -> 5.5h
        (5, 2, 4 * H),  # other user: none after; before -> 3h
    ]
    q, e = frames(spark, queries, events)
    fwd = {r.qid: r.nxt for r in next_after(q, e, "t", F.col("us"), slice_h * H).collect()}
    bwd = {r.qid: r.nxt for r in next_after(q, e, "t", F.col("us"), slice_h * H, forward=False).collect()}
    assert fwd == {1: int(0.5 * H), 2: 1 * H, 3: int(5.5 * H), 4: None, 5: None}
    assert bwd == {1: None, 2: None, 3: 1 * H, 4: int(5.5 * H), 5: 3 * H}


def test_struct_values_break_ties_by_value(spark):
    q = spark.createDataFrame([(1, 1, 10 * H)], "qid int, user_id long, t long")
    e = spark.createDataFrame([(1, 2 * H, 7), (1, 2 * H, 3), (1, H, 9)], "user_id long, us long, id long")
    got = next_after(q, e, "t", F.struct("us", "id"), H, forward=False).first().nxt
    assert (got.us, got.id) == (2 * H, 7)
