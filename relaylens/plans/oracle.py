"""DuckDB SQL for every batch query: the independent check.

Written against the raw views ``events orders lineitem customer`` and in
plain SQL forms that do not share the Spark plans' tricks: the funnel is
correlated minima per step, last touch is ``ASOF JOIN``, quantiles are
``quantile_cont`` over raw values.  Types are cast to what Spark returns
(``count`` -> BIGINT, decimal sums -> DECIMAL(38,2), ``GROUPING`` -> INTEGER).
"""

from __future__ import annotations

from relaylens.params import CAMPAIGN_JSON_PATH, INFLOW, OUTFLOW, RETURN_FLAG, FunnelSpec
from relaylens.plans.queries import ANCHOR, SPEC, TARGET, TOP_K


def _lit_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _campaign(props: str = "props") -> str:
    text = f"trim(json_extract_string({props}, '{CAMPAIGN_JSON_PATH}'))"
    return f"CASE WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN TRY_CAST({text} AS INTEGER) END"


def events_cte(spec: FunnelSpec = SPEC, types=True) -> str:
    where = "user_id IS NOT NULL AND ts IS NOT NULL"
    if types:
        where += f" AND event_type IN ({_lit_list(spec.steps)})"
    return f"""ev AS (
  SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS value, props
  FROM events WHERE {where}
  QUALIFY row_number() OVER (
    PARTITION BY event_id, event_type, CASE WHEN event_id IS NULL THEN struct_pack(ts, user_id, value, props) END
    ORDER BY ts, user_id, {_campaign()} NULLS FIRST, value NULLS FIRST, props NULLS FIRST) = 1
)"""


def funnel_ctes(spec: FunnelSpec = SPEC) -> str:
    """``f``: one row per send, the greedy chain as correlated minima."""
    later = spec.later
    parts = [
        events_cte(spec),
        f"""c0 AS (
  SELECT event_id AS send_id, user_id, {_campaign()} AS campaign_id, ts AS send_ts, ts AS t0
  FROM ev WHERE event_type = '{spec.send}'
)""",
    ]
    for j, step in enumerate(later, start=1):
        parts.append(
            f"""c{j} AS (
  SELECT c.*, (SELECT min(e.ts) FROM ev e WHERE e.user_id = c.user_id AND e.event_type = '{step}'
               AND e.ts > c.t{j - 1}) AS t{j}
  FROM c{j - 1} c
)"""
        )
    end = f"send_ts + INTERVAL {spec.hours} HOUR"
    cols = [f"CASE WHEN t{j} <= {end} THEN t{j} END AS {s}_ts" for j, s in enumerate(later, start=1)]
    depth = " + ".join(f"(CASE WHEN t{j} <= {end} THEN 1 ELSE 0 END)" for j in range(1, len(later) + 1))
    parts.append(
        f"""f AS (
  SELECT send_id, user_id, campaign_id, send_ts, {", ".join(cols)}, CAST({depth} AS INTEGER) AS depth
  FROM c{len(later)}
)"""
    )
    return ",\n".join(parts)


AS_OF = "(SELECT max(ts) FROM events)"
AS_OF_DAY = f"CAST({AS_OF} AS DATE)"


def _reach_aggs(spec: FunnelSpec) -> str:
    return ", ".join(
        ["CAST(count(*) AS BIGINT) AS sends"]
        + [f"CAST(count_if(depth >= {j}) AS BIGINT) AS reached_{s}" for j, s in enumerate(spec.later, start=1)]
    )


def _open(spec: FunnelSpec) -> str:
    return f"(send_ts + INTERVAL {spec.hours} HOUR > {AS_OF})"


def _rate(num: str, den: str, digits: int = 6) -> str:
    return f"round(CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE), {digits})"


def funnel_summary_sql(spec: FunnelSpec = SPEC) -> str:
    names = ["sends"] + [f"reached_{s}" for s in spec.later]
    rows = []
    for i, step in enumerate(spec.steps):
        prev = names[i - 1] if i else names[i]
        rows.append(
            f"SELECT {i} AS step_index, '{step}' AS step, {names[i]} AS reached, "
            f"{_rate(names[i], prev)} AS rate_prev, {_rate(names[i], 'sends')} AS rate_send FROM agg"
        )
    return f"WITH {funnel_ctes(spec)},\nagg AS (SELECT {_reach_aggs(spec)} FROM f)\n" + "\nUNION ALL\n".join(rows)


def funnel_by_day_sql(spec: FunnelSpec = SPEC) -> str:
    return f"""WITH {funnel_ctes(spec)}
SELECT day, sends, {", ".join(f"reached_{s}" for s in spec.later)}, open_sends, open_sends > 0 AS is_open
FROM (SELECT CAST(send_ts AS DATE) AS day, {_reach_aggs(spec)},
             CAST(count_if({_open(spec)}) AS BIGINT) AS open_sends
      FROM f GROUP BY 1)"""


def funnel_by_segment_sql(spec: FunnelSpec = SPEC) -> str:
    names = ["sends"] + [f"reached_{s}" for s in spec.later]
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    return f"""WITH {funnel_ctes(spec)},
per_user AS (SELECT user_id, campaign_id, {_reach_aggs(spec)} FROM f GROUP BY user_id, campaign_id)
SELECT c.c_mktsegment AS segment, p.campaign_id, {sums},
       CAST(GROUPING(c.c_mktsegment, p.campaign_id) AS INTEGER) AS level
FROM per_user p LEFT JOIN customer c ON p.user_id = c.c_custkey
GROUP BY ROLLUP (c.c_mktsegment, p.campaign_id)"""


def time_to_convert_sql(spec: FunnelSpec = SPEC) -> str:
    prev = ["send_ts"] + [f"{s}_ts" for s in spec.later]
    legs = []
    for j, s in enumerate(spec.later, start=1):
        for measure, base in (("from_prev", prev[j - 1]), ("from_send", "send_ts")):
            legs.append(
                f"SELECT {j} AS step_index, '{s}' AS step, '{measure}' AS measure, "
                f"(epoch_us({s}_ts) - epoch_us({base})) // 1000000 AS secs FROM f WHERE {s}_ts IS NOT NULL"
            )
    return f"""WITH {funnel_ctes(spec)},
legs AS ({" UNION ALL ".join(legs)})
SELECT step_index, step, measure, CAST(count(*) AS BIGINT) AS n,
       round(quantile_cont(secs, 0.5), 3) AS p50_secs, round(quantile_cont(secs, 0.9), 3) AS p90_secs
FROM legs GROUP BY step_index, step, measure"""


def drop_off_sql(spec: FunnelSpec = SPEC) -> str:
    names = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(spec.steps))
    return f"""WITH {funnel_ctes(spec)}
SELECT send_id, user_id, campaign_id, send_ts, depth, CASE depth {names} END AS last_step
FROM f WHERE NOT {_open(spec)} AND depth < {len(spec.later)}"""


def last_touch_ctes(spec: FunnelSpec = SPEC, anchor: str = ANCHOR, target: str = TARGET) -> str:
    return f"""{events_cte(spec)},
sends AS (SELECT event_id AS send_id, user_id, ts AS send_ts, {_campaign()} AS campaign_id
          FROM ev WHERE event_type = '{anchor}'),
conv AS (SELECT event_id AS conversion_id, user_id, ts AS conversion_ts, value AS amount
         FROM ev WHERE event_type = '{target}'),
lt AS (
  SELECT c.conversion_id, c.user_id, c.conversion_ts, c.amount, s.send_id, s.send_ts, s.campaign_id
  FROM conv c ASOF JOIN sends s ON c.user_id = s.user_id AND c.conversion_ts > s.send_ts
  WHERE c.conversion_ts <= s.send_ts + INTERVAL {spec.hours} HOUR
)"""


def funds_per_send_sql(spec: FunnelSpec = SPEC) -> str:
    return f"""WITH {last_touch_ctes(spec)},
s AS (SELECT CAST(send_ts AS DATE) AS day, campaign_id, CAST(count(*) AS BIGINT) AS sends FROM sends GROUP BY 1, 2),
c AS (SELECT CAST(send_ts AS DATE) AS day, campaign_id, CAST(count(*) AS BIGINT) AS conversions,
             CAST(sum(amount) AS DECIMAL(38,2)) AS credited FROM lt GROUP BY 1, 2)
SELECT s.day, s.campaign_id, s.sends, coalesce(c.conversions, 0) AS conversions,
       CAST(coalesce(c.credited, 0) AS DECIMAL(38,2)) AS credited,
       {_rate("coalesce(c.credited, 0)", "s.sends", 4)} AS credited_per_send
FROM s LEFT JOIN c ON s.day = c.day AND s.campaign_id = c.campaign_id"""


def ledger_cte(with_party: bool = True) -> str:
    net = "CAST(round(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))"
    party = "o.o_custkey" if with_party else "CAST(NULL AS BIGINT)"
    join = "LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey" if with_party else ""
    return f"""ledger AS (
  SELECT o_custkey AS party_id, CAST(o_orderdate AS DATE) AS day, '{INFLOW}' AS direction,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
  UNION ALL
  SELECT {party}, CAST(l.l_shipdate AS DATE), '{OUTFLOW}', {net}
  FROM lineitem l {join} WHERE l.l_returnflag = '{RETURN_FLAG}'
)"""


_IN = f"CASE WHEN direction = '{INFLOW}' THEN amount ELSE 0 END"
_OUT = f"CASE WHEN direction = '{OUTFLOW}' THEN amount ELSE 0 END"


def daily_cte(where: str = "") -> str:
    return f"""daily AS (
  SELECT day, inflow, outflow, n_in, n_out, CAST(inflow - outflow AS DECIMAL(38,2)) AS net FROM (
    SELECT day, CAST(sum({_IN}) AS DECIMAL(38,2)) AS inflow, CAST(sum({_OUT}) AS DECIMAL(38,2)) AS outflow,
           CAST(count_if(direction = '{INFLOW}') AS BIGINT) AS n_in,
           CAST(count_if(direction = '{OUTFLOW}') AS BIGINT) AS n_out
    FROM ledger {where} GROUP BY day))"""


def funds_trend_sql(where: str = "") -> str:
    return f"""WITH {ledger_cte(False)}, {daily_cte(where)},
cal AS (SELECT CAST(g AS DATE) AS day
        FROM (SELECT min(day) AS lo, max(day) AS hi FROM daily) b, generate_series(b.lo, b.hi, INTERVAL 1 DAY) t(g)),
filled AS (
  SELECT cal.day, coalesce(d.inflow, 0) AS inflow, coalesce(d.outflow, 0) AS outflow, coalesce(d.net, 0) AS net
  FROM cal LEFT JOIN daily d ON cal.day = d.day)
SELECT day, CAST(inflow AS DECIMAL(38,2)) AS inflow, CAST(outflow AS DECIMAL(38,2)) AS outflow,
       CAST(net AS DECIMAL(38,2)) AS net,
       CAST(sum(net) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running_net,
       CAST(sum(net) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS net_7d,
       CAST(net - lag(net, 7) OVER (ORDER BY day) AS DECIMAL(38,2)) AS net_change_7d
FROM filled"""


def per_party_cte() -> str:
    return f"""per_party AS (
  SELECT party_id, CAST(sum({_IN}) AS DECIMAL(38,2)) AS inflow, CAST(sum({_OUT}) AS DECIMAL(38,2)) AS outflow,
         CAST(count_if(direction = '{INFLOW}') AS BIGINT) AS n_in, CAST(count_if(direction = '{OUTFLOW}') AS BIGINT) AS n_out
  FROM ledger GROUP BY party_id)"""


def headline_sql_body() -> str:
    return f"""SELECT total_in, total_out, CAST(total_in - total_out AS DECIMAL(38,2)) AS net, movements, payers,
       {_rate("total_in", "payers", 4)} AS avg_in_per_payer
FROM (SELECT CAST(sum({_IN}) AS DECIMAL(38,2)) AS total_in, CAST(sum({_OUT}) AS DECIMAL(38,2)) AS total_out,
             CAST(count(*) AS BIGINT) AS movements,
             CAST(count(DISTINCT CASE WHEN direction = '{INFLOW}' THEN party_id END) AS BIGINT) AS payers
      FROM ledger)"""


def overview_sql(spec: FunnelSpec = SPEC, days_filter: str = "") -> str:
    names = ["sends"] + [f"reached_{s}" for s in spec.later]
    summary_rows = []
    cohort_rows = []
    for i, step in enumerate(spec.steps):
        prev = names[i - 1] if i else names[i]
        for metric, val in (
            ("funnel_reached", names[i]),
            ("funnel_rate_prev", _rate(names[i], prev)),
            ("funnel_rate_send", _rate(names[i], "sends")),
        ):
            summary_rows.append(f"SELECT {AS_OF_DAY} AS day, '{metric}' AS metric, '{step}' AS dim, {val} AS v FROM agg")
        cohort_rows.append(f"SELECT day, 'cohort_reached', '{step}', {names[i]} FROM by_day")
    cohort_rows.append("SELECT day, 'cohort_open_sends', 'all', open_sends FROM by_day")
    daily_rows = [
        f"SELECT day, '{m}', 'all', {c} FROM daily"
        for m, c in (
            ("funds_in", "inflow"),
            ("funds_out", "outflow"),
            ("funds_net", "net"),
            ("funds_moves_in", "n_in"),
            ("funds_moves_out", "n_out"),
        )
    ]
    head_rows = [
        f"SELECT {AS_OF_DAY}, '{m}', 'all', {c} FROM headline"
        for m, c in (
            ("headline_in", "total_in"),
            ("headline_out", "total_out"),
            ("headline_net", "net"),
            ("headline_movements", "movements"),
            ("headline_payers", "payers"),
            ("headline_avg_in_per_payer", "avg_in_per_payer"),
        )
    ]
    union = "\nUNION ALL ".join(summary_rows + cohort_rows + daily_rows + head_rows)
    return f"""WITH {funnel_ctes(spec)}, {ledger_cte(True)},
agg AS (SELECT {_reach_aggs(spec)} FROM f),
by_day AS (SELECT CAST(send_ts AS DATE) AS day, {_reach_aggs(spec)},
                  CAST(count_if({_open(spec)}) AS BIGINT) AS open_sends FROM f GROUP BY 1),
{daily_cte()},
headline AS ({headline_sql_body()}),
u AS ({union})
SELECT day, metric, dim, CAST(v AS DECIMAL(38,6)) AS value FROM u {days_filter}"""


def recorded_sql(spec: FunnelSpec = SPEC) -> str:
    """The overview's undated rows, its rows of the days still open by the
    clock of each input, and zeros for such days without rows."""
    back = -(-spec.hours // 24)
    clocks = {"cohort": AS_OF_DAY, "funds": "(SELECT max(day) FROM ledger)"}
    names = {
        "cohort": [("cohort_reached", s) for s in spec.steps] + [("cohort_open_sends", "all")],
        "funds": [(f"funds_{m}", "all") for m in ("in", "out", "net", "moves_in", "moves_out")],
    }
    zeros = [
        f"""SELECT CAST(d AS DATE) AS day, m.metric, m.dim FROM (SELECT unnest(generate_series(
          {clock} - INTERVAL {back} DAY, {clock}, INTERVAL 1 DAY)) AS d),
          (VALUES {", ".join(f"('{m}', '{x}')" for m, x in names[kind])}) m(metric, dim)"""
        for kind, clock in clocks.items()
    ]
    return f"""WITH {ledger_cte(True)}, o AS ({overview_sql(spec)}),
wanted AS ({" UNION ALL ".join(zeros)})
SELECT w.day, w.metric, w.dim, coalesce(o.value, CAST(0 AS DECIMAL(38,6))) AS value
FROM wanted w LEFT JOIN o ON o.day = w.day AND o.metric = w.metric AND o.dim = w.dim
UNION ALL SELECT day, metric, dim, value FROM o WHERE split_part(metric, '_', 1) IN ('funnel', 'headline')"""


def sql_for(spec: FunnelSpec = SPEC) -> dict[str, str]:
    later = spec.later
    return {
        "events_steps": f"""SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events
WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ({_lit_list(spec.steps)})""",
        "events_campaign": f"""SELECT event_id, event_type, {_campaign()} AS campaign_id FROM events
WHERE user_id IS NOT NULL AND ts IS NOT NULL""",
        "ledger": f"WITH {ledger_cte(True)} SELECT party_id, day, direction, amount FROM ledger",
        "events_dedup": f"WITH {events_cte(spec, types=False)} SELECT event_id, user_id, ts, event_type, value, props FROM ev",
        "funnel_sends": f"WITH {funnel_ctes(spec)} SELECT send_id, user_id, campaign_id, send_ts, "
        + ", ".join(f"{s}_ts" for s in later)
        + ", depth FROM f",
        "funnel_sends_skew_safe": f"WITH {funnel_ctes(spec)} SELECT send_id, user_id, campaign_id, send_ts, "
        + ", ".join(f"{s}_ts" for s in later)
        + ", depth FROM f",
        "funnel_summary": funnel_summary_sql(spec),
        "funnel_by_day": funnel_by_day_sql(spec),
        "funnel_by_segment": funnel_by_segment_sql(spec),
        "time_to_convert": time_to_convert_sql(spec),
        "last_touch": f"WITH {last_touch_ctes(spec)} SELECT * FROM lt",
        "last_touch_skew_safe": f"WITH {last_touch_ctes(spec)} SELECT * FROM lt",
        "drop_off": drop_off_sql(spec),
        "daily_funds": f"WITH {ledger_cte(False)}, {daily_cte()} SELECT day, inflow, outflow, n_in, n_out, net FROM daily",
        "funds_trend": funds_trend_sql(),
        "funds_trend_inflow": funds_trend_sql(f"WHERE direction = '{INFLOW}'"),
        "funds_by_segment": f"""WITH {ledger_cte(True)}, {per_party_cte()},
j AS (SELECT c.c_mktsegment AS segment, p.* FROM per_party p LEFT JOIN customer c ON p.party_id = c.c_custkey),
legs AS (SELECT segment, '{INFLOW}' AS direction, inflow AS amount, n_in AS n FROM j WHERE n_in > 0
         UNION ALL SELECT segment, '{OUTFLOW}', outflow, n_out FROM j WHERE n_out > 0)
SELECT segment, direction, CAST(sum(amount) AS DECIMAL(38,2)) AS amount,
       CAST(sum(CASE WHEN direction = '{OUTFLOW}' THEN -amount ELSE amount END) AS DECIMAL(38,2)) AS net,
       CAST(sum(n) AS BIGINT) AS entries, CAST(GROUPING(segment, direction) AS INTEGER) AS level
FROM legs GROUP BY ROLLUP (segment, direction)""",
        "funds_headline": f"WITH {ledger_cte(True)} {headline_sql_body()}",
        "top_parties": f"""WITH {ledger_cte(True)}, {per_party_cte()}
SELECT party_id, inflow, outflow, CAST(inflow - outflow AS DECIMAL(38,2)) AS net FROM per_party
WHERE party_id IS NOT NULL ORDER BY net DESC, party_id LIMIT {TOP_K}""",
        "funds_by_month": f"""WITH {ledger_cte(False)}, {daily_cte()},
m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(inflow) AS DECIMAL(38,2)) AS inflow,
             CAST(sum(outflow) AS DECIMAL(38,2)) AS outflow, CAST(count(*) AS BIGINT) AS active_days
      FROM daily GROUP BY 1)
SELECT month, inflow, outflow, CAST(inflow - outflow AS DECIMAL(38,2)) AS net, active_days,
       CAST((inflow - outflow) - lag(inflow - outflow) OVER (ORDER BY month) AS DECIMAL(38,2)) AS net_change
FROM m""",
        "month_to_date": f"""WITH {ledger_cte(False)}, {daily_cte()}
SELECT day, CAST(date_trunc('month', day) AS DATE) AS month, net,
       CAST(sum(inflow) OVER w AS DECIMAL(38,2)) AS mtd_in, CAST(sum(outflow) OVER w AS DECIMAL(38,2)) AS mtd_out,
       CAST(sum(net) OVER w AS DECIMAL(38,2)) AS mtd_net
FROM daily
WINDOW w AS (PARTITION BY date_trunc('month', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "funds_per_send": funds_per_send_sql(spec),
        "metrics_overview": overview_sql(spec),
        "recorded_metrics": recorded_sql(spec),
        "recorded_incrementally": recorded_sql(spec),
        # exact: sketches list up to LG_K's and KLL_K's count of values as they are
        "payers_by_month_sketched": f"""WITH {ledger_cte(False)} SELECT CAST(date_trunc('month', day) AS DATE) AS month,
CAST(count(DISTINCT party_id) AS BIGINT) AS payers FROM ledger WHERE direction = '{INFLOW}' GROUP BY 1""",
        "time_to_convert_sketched": time_to_convert_sql(spec)
        .replace("round(quantile_cont(secs, 0.5), 3)", "CAST(quantile_disc(secs, 0.5) AS BIGINT)")
        .replace("round(quantile_cont(secs, 0.9), 3)", "CAST(quantile_disc(secs, 0.9) AS BIGINT)"),
    }
