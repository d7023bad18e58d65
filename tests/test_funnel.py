"""Funnel semantics on hand-made events (FIXTURES.md part 3) and against a
brute-force chain search on random events."""

import datetime as dt
import random

import pytest

from relaylens.operators.attribution import last_touch, last_touch_skew_safe
from relaylens.operators.funnel import drop_off, funnel_by_day, funnel_summary, ordered_funnel, ordered_funnel_skew_safe
from relaylens.params import FunnelSpec
from relaylens.sources.events import as_of_ts, dedupe_events, load_events

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
H = dt.timedelta(hours=1)
US = dt.timedelta(microseconds=1)
SPEC = FunnelSpec()


def ev(i, t, typ, user=1, value=1.0, k=7):
    return (i, t, user, typ, value, f'{{"k": {k}}}')


def depths(spark, events_dir, rows, spec=SPEC):
    d = events_dir(rows)
    f = ordered_funnel(dedupe_events(load_events(spark, d, spec.steps)), spec)
    return {r.send_id: r.depth for r in f.collect()}


def test_tie_does_not_chain(spark, events_dir):
    assert depths(spark, events_dir, [ev(1, T0, "view"), ev(2, T0, "click")]) == {1: 0}


def test_window_end_inclusive(spark, events_dir):
    rows = [ev(1, T0, "view", user=1), ev(2, T0 + 72 * H, "click", user=1)]
    rows += [ev(3, T0, "view", user=2), ev(4, T0 + 72 * H + US, "click", user=2)]
    assert depths(spark, events_dir, rows) == {1: 1, 3: 0}


def test_wrong_order_reaches_first_step_only(spark, events_dir):
    rows = [ev(1, T0, "view"), ev(2, T0 + H, "signup"), ev(3, T0 + 2 * H, "click")]
    assert depths(spark, events_dir, rows) == {1: 1}


def test_repeat_step(spark, events_dir):
    rows = [ev(1, T0, "view"), ev(2, T0 + H, "click"), ev(3, T0 + 2 * H, "click"), ev(4, T0 + 3 * H, "signup")]
    assert depths(spark, events_dir, rows) == {1: 2}


def test_two_sends_one_purchase(spark, events_dir):
    rows = [
        ev(1, T0, "view", k=1),
        ev(2, T0 + H, "view", k=2),
        ev(3, T0 + 2 * H, "click"),
        ev(4, T0 + 3 * H, "signup"),
        ev(5, T0 + 4 * H, "purchase", value=9.99),
    ]
    d = events_dir(rows)
    events = dedupe_events(load_events(spark, d, SPEC.steps))
    assert {r.send_id: r.depth for r in ordered_funnel(events, SPEC).collect()} == {1: 3, 2: 3}
    lt = last_touch(events, "view", "purchase", 72).collect()
    assert [(r.conversion_id, r.send_id, r.campaign_id, str(r.amount)) for r in lt] == [(5, 2, 2, "9.99")]


def test_conversion_before_any_send_not_credited(spark, events_dir):
    rows = [ev(1, T0, "purchase"), ev(2, T0 + H, "view")]
    d = events_dir(rows)
    assert last_touch(load_events(spark, d), "view", "purchase", 72).count() == 0


def test_last_touch_window_and_users(spark, events_dir):
    rows = [
        ev(1, T0, "view", user=1),
        ev(2, T0 + 72 * H + US, "purchase", user=1),  # one microsecond too late
        ev(3, T0, "view", user=2),
        ev(4, T0 + 72 * H, "purchase", user=2),  # exactly at the end: credited
        ev(5, T0 + H, "purchase", user=3),  # other user's send does not count
    ]
    d = events_dir(rows)
    got = [(r.conversion_id, r.send_id) for r in last_touch(load_events(spark, d), "view", "purchase", 72).collect()]
    assert got == [(4, 3)]


def test_immature_send_kept_and_flagged(spark, events_dir):
    rows = [ev(1, T0, "view"), ev(2, T0 + 100 * H, "view"), ev(3, T0 + 101 * H, "error")]
    d = events_dir(rows)
    f = ordered_funnel(load_events(spark, d, SPEC.steps), SPEC)
    by_day = {r.day: (r.sends, r.open_sends, r.is_open) for r in funnel_by_day(f, SPEC, as_of_ts(spark, d)).collect()}
    assert by_day == {T0.date(): (1, 0, False), (T0 + 100 * H).date(): (1, 1, True)}
    stalled = [r.send_id for r in drop_off(f, SPEC, as_of_ts(spark, d)).collect()]
    assert stalled == [1]


def test_duplicate_delivery_counted_once(spark, events_dir):
    rows = [ev(1, T0, "view"), ev(1, T0, "view"), ev(2, T0 + H, "click"), ev(2, T0 + H, "click")]
    d = events_dir(rows)
    f = ordered_funnel(dedupe_events(load_events(spark, d, SPEC.steps)), SPEC)
    assert [(r.send_id, r.depth) for r in f.collect()] == [(1, 1)]


def test_duplicate_copies_that_differ_keep_smallest(spark, events_dir):
    rows = [ev(1, T0 + H, "view", k=5), ev(1, T0, "view", k=6)]
    d = events_dir(rows)
    got = dedupe_events(load_events(spark, d)).collect()
    assert len(got) == 1 and got[0].ts == T0 and got[0].props == '{"k": 6}'


def test_null_user_or_time_dropped(spark, events_dir):
    rows = [ev(1, T0, "view"), (2, None, 1, "view", 1.0, "{}"), (3, T0, None, "view", 1.0, "{}")]
    d = events_dir(rows)
    assert [r.event_id for r in load_events(spark, d).collect()] == [1]


def test_no_sends(spark, events_dir):
    d = events_dir([ev(1, T0, "click")])
    rows = funnel_summary(ordered_funnel(load_events(spark, d, SPEC.steps), SPEC), SPEC).collect()
    assert [(r.step, r.reached, r.rate_prev, r.rate_send) for r in rows] == [
        ("view", 0, None, None),
        ("click", 0, None, None),
        ("signup", 0, None, None),
        ("purchase", 0, None, None),
    ]


def brute_depth(events, send, spec):
    """Largest j such that an ordered chain send < t1 < ... < tj <= send + window exists."""
    t0 = send[1]
    end = t0 + dt.timedelta(hours=spec.hours)
    by_type = {s: sorted(t for (_, t, u, typ) in events if u == send[2] and typ == s) for s in spec.later}

    def longest(prev_t, j):
        if j > len(spec.later):
            return 0
        best = 0
        for t in by_type[spec.later[j - 1]]:
            if prev_t < t <= end:
                best = max(best, 1 + longest(t, j + 1))
                if best == len(spec.later) - j + 1:
                    break
        return best

    return longest(t0, 1)


@pytest.mark.parametrize("seed,split_hours", [(1, None), (2, 1), (3, 5), (4, 1000)])
def test_against_brute_force(spark, events_dir, seed, split_hours):
    rnd = random.Random(seed)
    spec = FunnelSpec(hours=6, split_hours=split_hours)
    types = list(spec.steps) + ["error"]
    rows, plain = [], []
    for i in range(300):
        t = T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 48))
        u = rnd.randrange(3)  # few users: every user is "hot"
        typ = rnd.choice(types)
        rows.append(ev(i, t, typ, user=u))
        plain.append((i, t, u, typ))
    d = events_dir(rows)
    got = {r.send_id: r.depth for r in ordered_funnel(load_events(spark, d, spec.steps), spec).collect()}
    want = {i: brute_depth(plain, (i, t, u, typ), spec) for (i, t, u, typ) in plain if typ == spec.send}
    assert got == want
    # the skew-safe plan, slices from 10 minutes to 2 days
    for slice_hours in (1 / 6, 1, 48):
        safe = ordered_funnel_skew_safe(load_events(spark, d, spec.steps), spec, slice_hours=slice_hours)
        assert {r.send_id: r.depth for r in safe.collect()} == want


def test_last_touch_against_brute_force(spark, events_dir):
    rnd = random.Random(11)
    rows, plain = [], []
    for i in range(300):
        t = T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 200))
        u = rnd.randrange(3)
        typ = rnd.choice(["view", "purchase", "click"])
        rows.append(ev(i, t, typ, user=u))
        plain.append((i, t, u, typ))
    d = events_dir(rows)
    got = {
        r.conversion_id: r.send_id
        for r in last_touch(load_events(spark, d), "view", "purchase", 24, split_hours=7).collect()
    }
    for slice_hours in (0.5, 5, 100):
        safe = last_touch_skew_safe(load_events(spark, d), "view", "purchase", 24, slice_hours=slice_hours)
        assert {r.conversion_id: r.send_id for r in safe.collect()} == got
    want = {}
    for i, t, u, typ in plain:
        if typ != "purchase":
            continue
        before = [(s_t, s_i) for (s_i, s_t, s_u, s_typ) in plain if s_u == u and s_typ == "view" and s_t < t]
        if before:
            s_t, s_i = max(before)
            if t - s_t <= dt.timedelta(hours=24):
                want[i] = s_i
    assert got == want


def test_last_touch_same_instant_sends_is_deterministic(spark, events_dir):
    rows = [ev(7, T0, "view", k=1), ev(3, T0, "view", k=2), ev(9, T0 + H, "purchase")]
    d = events_dir(rows)
    for split in (None, 1):
        got = [(r.conversion_id, r.send_id) for r in last_touch(load_events(spark, d), "view", "purchase", 72, split).collect()]
        assert got == [(9, 7)]
    safe = last_touch_skew_safe(load_events(spark, d), "view", "purchase", 72)
    assert [(r.conversion_id, r.send_id) for r in safe.collect()] == [(9, 7)]


def _campaigns(spark, d):
    from relaylens.sources.events import step_events

    return {r.send_id: r.campaign_id for r in ordered_funnel(step_events(spark, d, SPEC.steps), SPEC).collect()}


def test_bad_campaign_values_give_null(spark, events_dir):
    d = events_dir(
        [
            (1, T0, 1, "view", 1.0, '{"k": "abc"}'),
            (2, T0 + H, 1, "view", 1.0, '{"x": 3}'),
            (3, T0 + 2 * H, 1, "view", 1.0, '{"k": 99999999999}'),
            (4, T0 + 3 * H, 1, "view", 1.0, "not json"),
            (5, T0 + 4 * H, 1, "view", 1.0, None),
            (6, T0 + 5 * H, 1, "view", 1.0, '{"k": 12}'),
        ]
    )
    assert _campaigns(spark, d) == {1: None, 2: None, 3: None, 4: None, 5: None, 6: 12}


def test_one_rule_for_copies_of_different_type(spark, events_dir):
    """A4 and the funnel agree: the type is part of an event's identity."""
    from relaylens.sources.events import step_events

    d = events_dir([ev(1, T0, "error"), ev(1, T0 + H, "view"), ev(1, T0 + 2 * H, "view"), ev(2, T0 + 3 * H, "click")])
    kept = sorted((r.event_id, r.event_type, r.ts) for r in dedupe_events(load_events(spark, d)).collect())
    assert kept == [(1, "error", T0), (1, "view", T0 + H), (2, "click", T0 + 3 * H)]
    used = sorted((r.event_id, r.event_type, r.ts) for r in step_events(spark, d, SPEC.steps).collect())
    assert used == [r for r in kept if r[1] in SPEC.steps]


def test_copies_keep_the_same_row_whatever_is_read(spark, events_dir):
    from relaylens.sources.events import step_events

    d = events_dir([ev(1, T0, "view", value=5.0, k=2), ev(1, T0, "view", value=1.0, k=9), ev(1, T0, "view", value=3.0, k=2)])
    (full,) = dedupe_events(load_events(spark, d)).collect()
    (slim,) = step_events(spark, d, SPEC.steps).collect()
    (paid,) = step_events(spark, d, SPEC.steps, value=True).collect()
    assert full.props == '{"k": 2}' and full.value == 3
    assert slim.campaign_id == 2 and (paid.campaign_id, paid.value) == (2, 3)


def test_rows_without_an_id_stay(spark, events_dir):
    rows = [ev(None, T0 + i * H, "view", user=i % 2) for i in range(5)] + [ev(None, T0, "view", user=0)]
    d = events_dir(rows)
    assert dedupe_events(load_events(spark, d)).count() == 5
    assert len(ordered_funnel(dedupe_events(load_events(spark, d)), SPEC).collect()) == 5


def test_duplicates_match_the_oracle(spark, events_dir):
    """A4 with repeats, differing copies and missing ids, against DuckDB."""
    import duckdb

    import __spark_entry__ as E
    from tools.parity import rows_of

    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        k = rnd.choice([1, 2, "abc", None])
        rows.append(
            (
                rnd.choice([None, *range(60)]), T0 + rnd.randrange(6) * H, rnd.randrange(3), rnd.choice(["view", "click", "error"]),
                float(rnd.randrange(3)), f'{{"k": {"null" if k is None else repr(k).replace(chr(39), chr(34))}}}',
            )
        )
    d = events_dir(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    for name in ("events_dedup", "events_campaign", "funnel_sends", "funnel_sends_skew_safe"):
        df = E.queries()[name](spark, d)
        cur = con.execute(E.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall()), name


def test_conversion_without_an_amount_is_counted(spark, events_dir):
    from relaylens.operators.attribution import funds_per_send

    d = events_dir([ev(1, T0, "view"), ev(2, T0 + H, "purchase", value=None), ev(3, T0 + 2 * H, "purchase", value=4.0)])
    touches = last_touch(load_events(spark, d), "view", "purchase", 72).count()
    per_send = funds_per_send(load_events(spark, d)).collect()
    assert sum(r.conversions for r in per_send) == touches == 2
    assert sum(r.credited for r in per_send) == 4
