"""Continuous versions of the event-side jobs.

All take the stream from ``event_stream`` (with ``event_time``) and use the
watermark for completeness: a result is emitted once the watermark (latest
event time seen minus ``delay``) has passed the end of its window, and
events older than the watermark are dropped as late.

Every watermark is taken over all events, of whatever type: a stream that has
gone quiet on funnel steps still closes its windows.  A condition on the type
alone would be moved below the watermark by the optimizer, so ``of_types``
names the event time in it, and such a condition stays where it is written.

Repeated deliveries are dropped by ``once``, a stateful operator of its own in
front of the funnel or the join (Spark hands each operator the watermark of
the one before it).  A copy equal to the first always meets the first one's
state or is late: the state lasts until the watermark has passed the event's
time by ``delay``, and from the event's time on copies are late.

F2 (each send with its first click, unmatched sends kept) comes in two forms
with the same rows: ``stream_funnel`` with the two steps send and click, and
``stream_send_to_click``, a stream-stream left outer join on the time interval
whose pairs go straight into a minimum per send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.functions import epoch_micros, floor_div, micros_to_ts
from relaylens.operators.funnel import micros_col, step_col
from relaylens.params import FunnelSpec
from relaylens.sources.events import campaign_of
from relaylens.streaming.funnel_state import FunnelProcessor
from relaylens.streaming.source import instant_to_ts

DEFAULT_DELAY = "1 hour"
#: Stands for a missing send id in the funnel's state (arrays of whole numbers
#: hold no nulls); put back to null in the output.
NO_ID = -(1 << 63)
#: The funnel's number among its query's stateful operators; ``once`` is 1.
FUNNEL_OPERATOR = 0
#: Users share this many state keys per time slice.  Part of the state's key:
#: a stream that has started can't go on with another number.
USER_BUCKETS = 1024


def user_bucket() -> Column:
    """The lot of a row's user among the state keys of a slice."""
    return F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int")


def of_types(stream: DataFrame, types, delay: str = DEFAULT_DELAY) -> DataFrame:
    """The events of ``types`` under a watermark over all events."""
    any_time = F.col("event_time") >= F.timestamp_micros(F.lit(-62_135_596_800_000_000))  # 0001-01-01
    return stream.withWatermark("event_time", delay).where(F.when(any_time, F.col("event_type").isin(list(types))))


def once(events: DataFrame) -> DataFrame:
    """The first delivery of each event: by A4's rule an event is its id and
    type, or without an id its whole contents (the columns at hand).  Needs a
    watermark; state per event ends with it."""
    contents = F.struct(*[F.col(c) for c in events.columns if c not in ("event_id", "event_type")])
    keyed = events.withColumn("_no_id", F.when(F.col("event_id").isNull(), contents))
    return keyed.dropDuplicatesWithinWatermark(["event_id", "event_type", "_no_id"]).drop("_no_id")


def stream_step_counts(stream: DataFrame, window: str = "1 day", delay: str = DEFAULT_DELAY) -> DataFrame:
    """events per type per event-time window; append mode emits each
    window once the watermark passes its end; late events are dropped."""
    agg = stream.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "event_type").count()
    return agg.select(
        instant_to_ts(F.col("window.start")).alias("window_start"),
        instant_to_ts(F.col("window.end")).alias("window_end"),
        "event_type",
        F.col("count").alias("n"),
    )


def stream_dedupe(stream: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """the first delivery of each event by the batch jobs' rule (id and
    type; contents where there is no id).  Repeats that equal the first are
    all dropped.  Of copies that differ the batch keeps the smallest, a stream
    the first to arrive; one whose time lies more than ``delay`` after the
    first one's may pass as an event of its own once the state has ended."""
    d = once(stream.withWatermark("event_time", delay))
    return d.select("event_id", "user_id", "ts", "event_type", "value", "props")


def stream_funnel(
    stream: DataFrame,
    spec: FunnelSpec = FunnelSpec(),
    delay: str = DEFAULT_DELAY,
    open_sends: DataFrame | None = None,
) -> DataFrame:
    """B1 as events arrive.  One row per send, emitted once the
    watermark has passed the end of its window; same columns as B1.  Repeated
    deliveries count once: two chained stateful operators, ``once`` and the
    funnel.

    The state key is (user bucket, time slice), the slice by the same fixed
    rule as the batch window plan: a send belongs to its own slice, a later
    step is copied to the slices whose sends can reach it.  A busy user's
    sends and events are thus spread over keys, a key's state ends with its
    slice, and the rule knows nothing of history, so a restart cannot change
    it.  The users of a bucket share a key (``USER_BUCKETS`` of them a slice),
    so that calls into the state and timers don't grow with the users.

    ``open_sends`` (``open_sends_at``) are sends of a batch run up to some
    instant that later events can still move on: the stream, then of the
    events from that instant, starts with them as its state."""
    k = len(spec.later)
    step_index = F.lit(None).cast("int")
    for i, s in enumerate(spec.steps):
        step_index = F.when(F.col("event_type") == s, F.lit(i)).otherwise(step_index)
    campaign = F.when(F.col("event_type") == spec.send, campaign_of()).alias("campaign_id")
    ev = once(of_types(stream, spec.steps, delay).select("event_id", "event_type", "user_id", "event_time", "ts", campaign))
    ev = ev.select(
        "user_id",
        "event_time",
        F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"),
        epoch_micros("ts").alias("us"),
        step_index.alias("step"),
        "campaign_id",
    )
    out_schema = T.StructType(
        [
            T.StructField("send_id", T.LongType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("campaign_id", T.IntegerType()),
            T.StructField("send_us", T.LongType()),
            *[T.StructField(f"u{j}", T.LongType()) for j in range(1, k + 1)],
            T.StructField("depth", T.IntegerType()),
        ]
    )
    own = floor_div(F.col("us"), spec.split_us)
    first = floor_div(F.col("us") - F.lit(spec.window_us), spec.split_us)
    slices = F.when(F.col("step") == 0, F.array(own)).otherwise(F.sequence(first, own))
    ev = ev.withColumn("slice", F.explode(slices)).withColumn("bucket", user_bucket())
    raw = ev.groupBy("bucket", "slice").transformWithStateInPandas(
        statefulProcessor=FunnelProcessor(len(spec.steps), spec.window_us),
        outputStructType=out_schema,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if open_sends is None else open_sends.withColumn("bucket", user_bucket()).groupBy("bucket", "slice"),
    )
    return raw.select(
        F.when(F.col("send_id") != NO_ID, F.col("send_id")).alias("send_id"),
        "user_id",
        "campaign_id",
        micros_to_ts(F.col("send_us")).alias("send_ts"),
        *[micros_to_ts(F.col(f"u{j}")).alias(step_col(s)) for j, s in enumerate(spec.later, start=1)],
        "depth",
    )


def open_sends_at(funnel: DataFrame, spec: FunnelSpec, cut_us: int) -> DataFrame:
    """The sends of a batch funnel (B1 with micro-seconds, over the events
    before the instant ``cut_us``) whose window reaches the instant, as F4's
    state holds them."""
    t0 = F.col("send_us")
    steps = [F.col(micros_col(s)).alias(f"u{j}") for j, s in enumerate(spec.later, start=1)]
    return funnel.where(t0 + F.lit(spec.window_us) >= F.lit(cut_us)).select(
        "user_id",
        floor_div(t0, spec.split_us).alias("slice"),
        F.coalesce("send_id", F.lit(NO_ID)).alias("send_id"),
        t0.alias("t0"),
        "campaign_id",
        F.col("depth").alias("stage"),
        *steps,
    )


def held_sends(spark: SparkSession, checkpoint: str, spec: FunnelSpec) -> DataFrame:
    """B7 while F4 runs: the open sends in its state, from the stream's
    checkpoint (Spark's state data source), as of the watermark of its last
    batch: ``send_id, user_id, send_ts, depth, last_step``."""
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", FUNNEL_OPERATOR)
    sends = state.option("stateVarName", "sends").load().select("value.*")
    rows = sends.select(F.inline(F.arrays_zip("send_id", "user_id", "t0", "stage")))
    last = F.element_at(F.array(*[F.lit(s) for s in spec.steps]), F.col("depth") + 1)
    held = rows.select(
        F.when(F.col("send_id") != NO_ID, F.col("send_id")).alias("send_id"),
        "user_id",
        micros_to_ts(F.col("t0")).alias("send_ts"),
        F.col("stage").cast("int").alias("depth"),
    )
    return held.withColumn("last_step", last)


def stream_send_to_click(
    sends: DataFrame,
    clicks: DataFrame,
    hours: int = 24,
    delay: str = DEFAULT_DELAY,
    send: str = "view",
    click: str = "click",
) -> DataFrame:
    """F2 as a join: each send with its first click within ``hours``,
    unmatched sends kept, emitted once the watermark has passed the window.

    Four chained stateful operators: each side is deduplicated under its own
    watermark, a left outer join matches a send to the clicks of its user in
    ``(send, send + hours]`` (the interval bounds both sides' state), and a
    minimum per send, which the join's delayed watermark closes, takes the
    first.  Pairs exist between those two operators only: the aggregate
    combines them within the task before its shuffle."""
    campaign = campaign_of().alias("campaign_id")
    s = once(of_types(sends, [send], delay).select("event_id", "event_type", "user_id", "event_time", "ts", campaign))
    c = once(of_types(clicks, [click], delay).select("event_id", "event_type", "user_id", "event_time", "ts"))
    s = s.select(F.col("event_id").alias("send_id"), "user_id", "campaign_id", F.col("event_time").alias("send_time"))
    c = c.select(F.col("user_id").alias("click_user"), F.col("event_time").alias("click_time"))
    later = (F.col("click_time") > F.col("send_time")) & (
        F.col("click_time") <= F.col("send_time") + F.expr(f"INTERVAL {int(hours)} HOURS")
    )
    pairs = s.join(c, (F.col("user_id") == F.col("click_user")) & later, "leftOuter")
    pairs = pairs.select("send_id", "user_id", "campaign_id", "send_time", F.unix_micros("click_time").alias("click_us"))
    first = pairs.groupBy("send_time", "send_id", "user_id", "campaign_id").agg(F.min("click_us").alias("click_us"))
    return first.select(
        "send_id",
        "user_id",
        "campaign_id",
        instant_to_ts(F.col("send_time")).alias("send_ts"),
        micros_to_ts(F.col("click_us")).alias(step_col(click)),
        F.when(F.col("click_us").isNull(), 0).otherwise(1).alias("depth"),
    )
